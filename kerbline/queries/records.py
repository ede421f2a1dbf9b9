"""C, E, F, G and H: lists, aggregates, ordered rows and sets over the fixture records."""

from pyspark.sql import functions as F

from kerbline.operators import listing, sequences, summaries
from kerbline.queries.registry import Registry, table, view

reg = Registry()
c = F.col
REC = "fx_records"


@reg.add("c1_list", """
with t as (select count(*) as total from fx_records where evaluation_status = 'EVALUATED' and evidence_confidence = 'LOW')
select restriction_id, impact_severity, total, ceil(total / 25)::bigint as pages from fx_records cross join t
where evaluation_status = 'EVALUATED' and evidence_confidence = 'LOW' order by restriction_id limit 25 offset 50""")
def c1(spark, d):
    return listing.page(view(spark, d, REC), 50, 25, evaluation_status="EVALUATED", evidence_confidence="LOW", impact_severity=None).select("restriction_id", "impact_severity", "total", "pages")


FIELDS = ["restriction_id", "evaluation_status", "evidence_confidence", "impact_severity", "road", "name", "from_road", "to_road"]
_HAY = " || ' ' || ".join(f"coalesce({f}, '')" for f in FIELDS)


@reg.add("c2_search", f"select restriction_id, road, to_road from fx_records where contains(lower({_HAY}), 'major art') and impact_severity = 'HIGH'")
def c2(spark, d):
    return listing.search(view(spark, d, REC), FIELDS, "Major ART", "to_road", impact_severity="HIGH", evaluation_status="").select("restriction_id", "road", "to_road")


@reg.add("g2_sorted", f"select restriction_id, row_number() over (order by coalesce(nullif(to_road, ''), ''), restriction_id)::int as place from fx_records where contains(lower({_HAY}), 'contractor 7')")
def g2(spark, d):
    return listing.search_rank(view(spark, d, REC), FIELDS, "contractor 7", "to_road").select("restriction_id", "place")


@reg.add("c3_lookup", "select w.id as restriction_id, r.restriction_id is not null as found, r.impact_severity from (select restriction_id as id from fx_records where k % 20 = 0 union all select 'R-none') w left join fx_records r on r.restriction_id = w.id")
def c3(spark, d):
    r = view(spark, d, REC)
    ids = r.where("k % 20 = 0").select("restriction_id").union(spark.sql("select 'R-none' as restriction_id"))
    return listing.lookup(r, ids).select("restriction_id", "found", "impact_severity")


@reg.add("c4_threshold", "select restriction_id, segment_id, pos from fx_matches where threshold_m is null or threshold_m = 5")
def c4(spark, d):
    return listing.at_threshold(view(spark, d, "fx_matches"), 5.0).select("restriction_id", "segment_id", "pos")


@reg.add("c5_scenarios", "select scenario, count(*) as n, count(distinct restriction_id) as r from fx_matches m join (values ('HIGH_ONLY', 'HIGH'), ('HIGH_MEDIUM', 'HIGH'), ('HIGH_MEDIUM', 'MEDIUM')) s(scenario, conf) on m.confidence = s.conf group by scenario")
def c5(spark, d):
    return listing.by_scenario(view(spark, d, "fx_matches")).groupBy("scenario").agg(F.count("*").alias("n"), F.count_distinct("restriction_id").alias("r"))


@reg.add("c6_active", "select t::double as t, count(*) filter (t <= 0 or (duration_hours is not null and t <= duration_hours)) as active from fx_records, (values (0), (24), (200), (900)) as s(t) group by t")
def c6(spark, d):
    return listing.active_counts(view(spark, d, REC), [0, 24, 200, 900])


@reg.add("c7_heights", "select count(*) as n, count(*) filter (h <= 0) as flat, count(*) filter (h > 0 and not ok) as outside, count(*) filter (h > 0 and ok) as kept from (select k % 4 - 1 as h, lon between -79.42e0 and -79.36e0 and lat between 43.62e0 and 43.7e0 as ok from fx_restrictions)")
def c7(spark, d):
    from kerbline.operators.massing import clip_counts

    rings = view(spark, d, "fx_restrictions").select((c("k") % 4 - 1).alias("h"), F.array(F.struct(c("lon").alias("x"), c("lat").alias("y"))).alias("ring"))
    return clip_counts(rings, {"west": -79.42, "east": -79.36, "south": 43.62, "north": 43.7})


@reg.add("c8_bounded_days", "select restriction_id, duration_hours / 24 as days from fx_records where duration_hours > 0 and duration_hours / 24 < 365")
def c8(spark, d):
    days = c("duration_hours") / 24
    return view(spark, d, REC).where((days > 0) & (days < 365)).select("restriction_id", days.alias("days"))


@reg.add("c9_complete", "select restriction_id from fx_records where duration_hours is not null and added_distance_m is not null")
def c9(spark, d):
    return view(spark, d, REC).dropna(subset=["duration_hours", "added_distance_m"]).select("restriction_id")


@reg.add("c10_geometry_available", "select m.restriction_id, m.segment_id, m.k % 2 = 0 as has_geometry from fx_matches m where m.k % 2 = 0")
def c10(spark, d):
    m = view(spark, d, "fx_matches")
    geom = m.where("k % 2 = 0").select("restriction_id", "segment_id", "pos", F.lit("line").alias("geom"))
    return m.join(geom.distinct(), ["restriction_id", "segment_id", "pos"], "left").where("geom is not null").select("restriction_id", "segment_id", F.lit(True).alias("has_geometry"))


@reg.add("c11_list_shape", "select restriction_id, coalesce(evaluation_status, 'NOT_EVALUATED') as state, candidate_edge_count::int as candidates, case when replacement_available then 'AVAILABLE' else 'NOT_AVAILABLE' end as replacement from fx_records")
def c11(spark, d):
    from kerbline.plans.shapes import list_items

    return list_items(view(spark, d, REC)).select("restriction_id", "state", c("candidates").cast("int").alias("candidates"), "replacement")


@reg.add("c12_map_features", "select restriction_id, 'point' as role, lon as x, lat as y from fx_records where k % 5 <> 0 union all select restriction_id, 'segment' as role, lon as x, lat as y from fx_matches join fx_restrictions using (restriction_id, k)")
def c12(spark, d):
    from kerbline.plans.shapes import map_features

    points = view(spark, d, REC).where("k % 5 <> 0").select("restriction_id", c("lon").alias("x"), c("lat").alias("y"))
    seg = view(spark, d, "fx_matches").join(view(spark, d, "fx_restrictions").select("restriction_id", c("lon").alias("x"), c("lat").alias("y")), "restriction_id")
    return map_features(points, seg)


@reg.add("c13_counters", "select count(*) as total, count(*) filter (evaluation_status = 'EVALUATED') as evaluated, count(*) filter (impact_severity in ('HIGH', 'SEVERE')) as serious, count(*) filter (evidence_confidence = 'INSUFFICIENT_EVIDENCE') as insufficient from fx_records")
def c13(spark, d):
    return view(spark, d, REC).agg(F.count("*").alias("total"), F.count_if(c("evaluation_status") == "EVALUATED").alias("evaluated"), F.count_if(c("impact_severity").isin("HIGH", "SEVERE")).alias("serious"), F.count_if(c("evidence_confidence") == "INSUFFICIENT_EVIDENCE").alias("insufficient"))


TILES = "select l_linenumber as zoom, (l_partkey % 64)::int as col, (l_suppkey % 32)::int as row_, (l_quantity * 1000)::bigint as bytes from lineitem"


def _tiles(spark, d):
    return table(spark, d, "lineitem").select(c("l_linenumber").alias("zoom"), (c("l_partkey") % 64).cast("int").alias("col"), (c("l_suppkey") % 32).cast("int").alias("row_"), (c("l_quantity") * 1000).cast("long").alias("bytes"))


@reg.add("c14_tile_window", f"select zoom, col, row_, sum(bytes)::bigint as bytes from ({TILES}) where zoom between 3 and 5 and col between 10 and 20 and row_ between 4 and 9 group by all")
def c14(spark, d):
    from kerbline.operators.massing import tile_window

    return tile_window(_tiles(spark, d), (3, 5), (10, 20), (4, 9)).groupBy("zoom", "col", "row_").agg(F.sum("bytes").alias("bytes"))


@reg.add("e16_tile_stats", f"select zoom, count(*) as n, sum(bytes) / 1048576e0 as mb from ({TILES}) group by zoom")
def e16(spark, d):
    from kerbline.operators.massing import tile_stats

    return tile_stats(_tiles(spark, d))


@reg.add("a25_tiles", f"select zoom, col, row_, bytes, (pow(2, zoom) - 1 - row_)::bigint as xyz_row from ({TILES}) where row_ < pow(2, zoom)")
def a25(spark, d):
    from kerbline.functions.geo import tile_row

    return _tiles(spark, d).where(c("row_") < F.pow(F.lit(2), c("zoom"))).withColumn("xyz_row", tile_row(c("zoom"), c("row_")))


@reg.add("c15_scatter", "select lon, lat, type from fx_restrictions where type in ('ROAD_CLOSED', 'HAZARD')")
def c15(spark, d):
    return view(spark, d, "fx_restrictions").where(c("type").isin("ROAD_CLOSED", "HAZARD")).select("lon", "lat", "type")


@reg.add("c16_topology_columns", "select column_name as name from (describe lineitem) where contains(lower(column_name), 'key') or contains(lower(column_name), 'line')")
def c16(spark, d):
    from kerbline.operators.profile import columns_named

    return columns_named(table(spark, d, "lineitem"), ["key", "line"])


@reg.add("c17_provenance", "select restriction_id, 'open-data' as publisher, 'v1' as schema_version, 'snap-' || (k % 3) as source_snapshot from fx_records")
def c17(spark, d):
    return listing.with_provenance(view(spark, d, REC), F.concat(F.lit("snap-"), (c("k") % 3).cast("string")), publisher="open-data", schema_version="v1").select("restriction_id", "publisher", "schema_version", "source_snapshot")


_DOM = """(select restriction_id, signal as match_type from (select restriction_id, signal, count(*) as n, min(pos) as f from fx_matches group by all)
  qualify row_number() over (partition by restriction_id order by n desc, f, signal) = 1)"""


@reg.add("e9_dominant_match", f"select * from {_DOM}")
def e9(spark, d):
    return listing.dominant_match(view(spark, d, "fx_matches").withColumnRenamed("signal", "match_type"))


@reg.add("c18_summary_rows", f"select r.restriction_id, r.evaluation_status, r.candidate_edge_count::int as n, r.duration_hours, m.match_type from fx_records r left join {_DOM} m using (restriction_id)")
def c18(spark, d):
    m = listing.dominant_match(view(spark, d, "fx_matches").withColumnRenamed("signal", "match_type"))
    return view(spark, d, REC).join(m, "restriction_id", "left").select("restriction_id", "evaluation_status", c("candidate_edge_count").cast("int").alias("n"), "duration_hours", "match_type")


@reg.add("c19_spatial_lookup", "select w.id as restriction_id, r.restriction_id is not null as known, m.n from (select restriction_id as id from fx_records where k % 20 = 0 union all select 'R-none') w left join fx_records r on r.restriction_id = w.id left join (select restriction_id, count(*) as n from fx_matches group by 1) m on m.restriction_id = w.id")
def c19(spark, d):
    r = view(spark, d, REC)
    ids = r.where("k % 20 = 0").select("restriction_id").union(spark.sql("select 'R-none' as restriction_id"))
    m = view(spark, d, "fx_matches").groupBy("restriction_id").agg(F.count("*").alias("n"))
    return listing.lookup(r.select("restriction_id"), ids).withColumnRenamed("found", "known").join(m, "restriction_id", "left")


@reg.add("c20_catalogue", "select p_partkey, p_name as resource_name, upper(p_type) as format, p_brand as title from part")
def c20(spark, d):
    from kerbline.plans.shapes import catalogue_metadata

    rows = table(spark, d, "part").select("p_partkey", c("p_brand").alias("title"), c("p_name").alias("name"), c("p_type").alias("format"))
    return catalogue_metadata(rows).select("p_partkey", c("resource.name").alias("resource_name"), c("resource.format").alias("format"), c("dataset.title").alias("title"))


@reg.add("c21_cells", "select 'cell_' || i || '_' || j as cell, count(*) as n from (select floor((lon + 79.5e0) / 0.02e0)::bigint as i, floor((lat - 43.6e0) / 0.015e0)::bigint as j from fx_restrictions) where i between 2 and 4 group by all")
def c21(spark, d):
    from kerbline.operators.massing import fetch_cells, with_cell

    rows = with_cell(view(spark, d, "fx_restrictions"), c("lon"), c("lat"), (-79.5, 43.6))
    manifest = rows.where("i between 2 and 4").select("cell").distinct()
    return fetch_cells(rows, manifest).groupBy("cell").agg(F.count("*").alias("n"))


@reg.add("e17_cell_manifest", "select 'cell_' || i || '_' || j as cell, count(*) as n, -79.5e0 + i * 0.02e0 as west, -79.5e0 + (i + 1) * 0.02e0 as east, 43.6e0 + j * 0.015e0 as south, 43.6e0 + (j + 1) * 0.015e0 as north, sum(count(*)) over ()::bigint as total from (select floor((lon + 79.5e0) / 0.02e0)::bigint as i, floor((lat - 43.6e0) / 0.015e0)::bigint as j from fx_restrictions) group by i, j")
def e17(spark, d):
    from kerbline.operators.massing import cell_manifest, with_cell

    return cell_manifest(with_cell(view(spark, d, "fx_restrictions"), c("lon"), c("lat"), (-79.5, 43.6)), (-79.5, 43.6))


@reg.add("d6_cohort_semi", "select r.restriction_id from fx_records r where exists (select 1 from fx_matches m where m.k = r.k and m.signal = 'direct_intersection')")
def d6(spark, d):
    return view(spark, d, REC).join(view(spark, d, "fx_matches").where("signal = 'direct_intersection'"), "restriction_id", "left_semi").select("restriction_id")


@reg.add("d9_sidecars", "select restriction_id, case when k % 2 = 0 then lon end as x, case when k % 3 = 0 then road end as place from fx_records")
def d9(spark, d):
    r = view(spark, d, REC)
    xy = r.where("k % 2 = 0").select("restriction_id", c("lon").alias("x"))
    loc = r.where("k % 3 = 0").select("restriction_id", c("road").alias("place"))
    return listing.with_sidecars(r.select("restriction_id"), xy, loc)


@reg.add("d10_matches", """
with f as (select * from fx_matches qualify row_number() over (partition by restriction_id, segment_id order by pos, signal, distance_m) = 1)
select restriction_id, segment_id, signal, row_number() over (partition by restriction_id order by pos, segment_id)::int as rank, case when k % 2 = 0 then 'g' end as geom from f""")
def d10(spark, d):
    m = view(spark, d, "fx_matches")
    spatial = m.where("k % 2 = 0").select("restriction_id", "segment_id").distinct()
    one = listing.matches_with_geometry(m, m.select("segment_id").distinct()).join(spatial.withColumn("geom", F.lit("g")), ["restriction_id", "segment_id"], "left")
    return one.select("restriction_id", "segment_id", "signal", "rank", "geom")


@reg.add("d20_barriers", "select restriction_id, list_sort(list_distinct(list(segment_id))) as segments from fx_matches where signal = 'direct_intersection' group by restriction_id")
def d20(spark, d):
    from kerbline.operators.network import barrier_sets

    return barrier_sets(view(spark, d, "fx_matches").where("signal = 'direct_intersection'"))


@reg.add("d21_compare", "with a as (select * from fx_records where restriction_id = 'R-0000012'), b as (select * from fx_records where restriction_id = 'R-0000015') select f as field, l as left, r as right, l is not distinct from r as same from (select unnest(['road', 'impact_severity', 'evidence_confidence']) as f, unnest([a.road, a.impact_severity, a.evidence_confidence]) as l, unnest([b.road, b.impact_severity, b.evidence_confidence]) as r from a, b)")
def d21(spark, d):
    return listing.compared(view(spark, d, REC), "R-0000012", "R-0000015", ["road", "impact_severity", "evidence_confidence"])


@reg.add("d22_resource", "select p_brand as package, p_name as name, count(*) over (partition by p_brand, p_name) = 1 as exactly_one from part where p_type = (select min(p_type) from part)")
def d22(spark, d):
    from kerbline.plans.shapes import select_resources

    parts = table(spark, d, "part")
    kind = parts.agg(F.min("p_type").alias("format"))
    return select_resources(parts.select(c("p_brand").alias("package"), c("p_name").alias("name"), c("p_type").alias("format")), kind).select("package", "name", "exactly_one")


SUMMARY = ["evaluation_status", "impact_severity", "evidence_confidence"]


@reg.add("e1_summary", """
select count(*) as total, count(*) filter (evaluation_status = 'EVALUATED') as evaluated,
  (select string_agg(v || '=' || n, ',' order by v) from (select evaluation_status as v, count(*) as n from fx_records group by 1)) as status,
  (select string_agg(v || '=' || n, ',' order by v) from (select impact_severity as v, count(*) as n from fx_records group by 1)) as severity,
  (select string_agg(v || '=' || n, ',' order by v) from (select evidence_confidence as v, count(*) as n from fx_records group by 1)) as confidence from fx_records""")
def e1(spark, d):
    s = summaries.summary(view(spark, d, REC), SUMMARY, c("evaluation_status") == "EVALUATED")
    text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("total", "evaluated", text(c("evaluation_status_counts")).alias("status"), text(c("impact_severity_counts")).alias("severity"), text(c("evidence_confidence_counts")).alias("confidence"))


@reg.add("e1_distributions", " union all ".join(f"select '{f}' as field, {f} as value, count(*) as n from fx_records group by {f}" for f in SUMMARY) + " union all select null, null, count(*) from fx_records")
def e1b(spark, d):
    return summaries.distributions(view(spark, d, REC), SUMMARY)


@reg.add("e2_crosstab", "select impact_severity || '|' || evidence_confidence as pair, count(*) as n from fx_records group by 1")
def e2(spark, d):
    return summaries.crosstab(view(spark, d, REC), "impact_severity", "evidence_confidence")


METRICS = ["affected_edge_length_m", "added_distance_m", "detour_ratio", "duration_hours", "candidate_edge_count"]


@reg.add("e3_distribution", " union all ".join(
    f"select '{m}' as metric, count({m}) as count, count(*) - count({m}) as missing, min({m})::double as min, avg({m}) as mean, "
    + ", ".join(f"quantile_cont({m}, {q})::double as {n}" for n, q in summaries.QUANTILES.items()) + f", max({m})::double as max from fx_records" for m in METRICS))
def e3(spark, d):
    return summaries.distribution_summary(view(spark, d, REC), METRICS)


_COUNTS = "count(*) as candidates, count(*) filter (signal = 'direct_intersection') as direct, count(*) filter (signal = 'proximity') as proximity, count(*) filter (signal = 'point_fallback') as fallback"


@reg.add("e4_match_summary", f"""
select * from (select count(*) as processed, count(*) filter (valid_polyline) as valid, count(*) filter (not valid_polyline) as using_fallback from fx_records)
cross join (select count(distinct restriction_id) as with_candidate, {_COUNTS}, count(*) filter (confidence = 'HIGH') as high, count(*) filter (confidence = 'MEDIUM') as medium, count(*) filter (confidence = 'LOW') as low
            from fx_matches where threshold_m is null or threshold_m = 5)""")
def e4(spark, d):
    return summaries.match_summary(view(spark, d, REC).select("restriction_id", (~c("valid_polyline")).alias("malformed")), view(spark, d, "fx_matches"), 5.0)


@reg.add("e5_threshold_sweep", f"select t::double as threshold_m, count(distinct restriction_id) as with_candidates, {_COUNTS} from fx_matches, (values (2), (5), (10)) s(t) where threshold_m is null or threshold_m = t group by t")
def e5(spark, d):
    return summaries.threshold_sweep(view(spark, d, "fx_matches"), [2, 5, 10])


EDGES = """select k, case when k % 6 = 0 then 'NOT_EVALUATED' else 'EVALUATED' end as evaluation_state, signal, pos, case when pos % 3 = 0 then null else 1e0 + pos / 4e0 + (k % 10) end as replacement_ratio,
  case when pos % 3 = 0 then null else distance_m + k % 50 end as added_m, pos % 3 = 0 as lost, distance_m + 1 as length_m from fx_matches"""


@reg.add("e6_impact", f"""
select k, count(*) as candidate_edge_count, count(*) filter (ev) as evaluated_edge_count, count(r) as alternative_path_edge_count, count(*) filter (ev and lost) as loss_count,
  median(r) as median_ratio, max(r) as max_ratio, quantile_cont(r, 0.9) as p90_ratio, median(a) as median_added_m, max(a) as max_added_m, sum(length_m) as affected_edge_length_m,
  case when count(*) filter (ev) > 0 then count(*) filter (ev and lost)::double / count(*) filter (ev) end as loss_fraction,
  case when count(*) filter (ev) = count(*) then 'EVALUATED' else 'PARTIALLY_EVALUATED' end as evaluation_state
from (select *, evaluation_state = 'EVALUATED' as ev, case when evaluation_state = 'EVALUATED' then replacement_ratio end as r, case when evaluation_state = 'EVALUATED' then added_m end as a from ({EDGES})) group by k""")
def e6(spark, d):
    m = view(spark, d, "fx_matches")
    odd = c("pos") % 3 == 0
    e = m.select("k", F.when(c("k") % 6 == 0, "NOT_EVALUATED").otherwise("EVALUATED").alias("evaluation_state"), F.when(~odd, 1.0 + c("pos") / 4.0 + c("k") % 10).alias("replacement_ratio"), F.when(~odd, c("distance_m") + c("k") % 50).alias("added_m"), odd.alias("lost"), (c("distance_m") + 1).alias("length_m"))
    return summaries.impact_aggregate(e, ["k"])


@reg.add("e7_affected_length", "select m.k, sum(p.p_size)::bigint as length_m from fx_matches m join part p on split_part(m.segment_id, '-', 2)::bigint = p.p_partkey group by m.k")
def e7(spark, d):
    from kerbline.operators.network import affected_length

    m = view(spark, d, "fx_matches").withColumn("part", F.split("segment_id", "-")[1].cast("long"))
    return affected_length(m.select(c("k").alias("restriction_id"), c("part").alias("segment_id")), table(spark, d, "part").select(c("p_partkey").alias("segment_id"), c("p_size").alias("length_m"))).select(c("restriction_id").alias("k"), "length_m")


_GROUPS = """select r.restriction_id, coalesce(direct, 0) as direct, coalesce(proximity, 0) as proximity, coalesce(fallback, 0) as fallback,
  case when not valid_polyline then 'FALLBACK' when direct > 0 then 'DIRECT' when proximity > 0 then 'PROXIMITY_ONLY' else 'NO_CANDIDATE' end as evidence_group, r.lon, r.lat, r.candidate_edge_count
  from fx_records r left join (select restriction_id, count(*) filter (signal = 'direct_intersection') as direct, count(*) filter (signal = 'proximity') as proximity, count(*) filter (signal = 'point_fallback') as fallback from fx_matches group by 1) m using (restriction_id)"""


def _groups(spark, d):
    r = view(spark, d, REC).select("restriction_id", (~c("valid_polyline")).alias("malformed"), "lon", "lat", "candidate_edge_count")
    return summaries.evidence_groups(r, view(spark, d, "fx_matches"))


@reg.add("e8_evidence_groups", f"select restriction_id, direct, proximity, fallback, evidence_group from ({_GROUPS})")
def e8(spark, d):
    return _groups(spark, d).select("restriction_id", "direct", "proximity", "fallback", "evidence_group")


@reg.add("f6_cohort", f"""
with g as (select *, lon between -79.41e0 and -79.36e0 and lat between 43.63e0 and 43.68e0 as downtown from ({_GROUPS})),
s as (select *, row_number() over (partition by evidence_group, downtown order by candidate_edge_count, restriction_id) - 1 as i, count(*) over (partition by evidence_group, downtown) as n from g where evidence_group in ('DIRECT', 'PROXIMITY_ONLY')),
p as (select evidence_group, downtown, round(step * (max(n) - 1) / 11e0)::bigint as i from s, range(0, 12) t(step) group by evidence_group, downtown, step)
select restriction_id, evidence_group from s where n <= 12 or exists (select 1 from p where p.evidence_group = s.evidence_group and p.downtown = s.downtown and p.i = s.i)
union all select restriction_id, evidence_group from g where evidence_group = 'FALLBACK'
union all select * from (select restriction_id, evidence_group from g where evidence_group = 'NO_CANDIDATE' order by restriction_id limit 24)""")
def f6(spark, d):
    return sequences.cohort(_groups(spark, d)).select("restriction_id", "evidence_group")


@reg.add("g6_no_candidates", f"select restriction_id from ({_GROUPS}) where evidence_group = 'NO_CANDIDATE' order by restriction_id limit 24")
def g6(spark, d):
    return _groups(spark, d).where("evidence_group = 'NO_CANDIDATE'").orderBy("restriction_id").limit(24).select("restriction_id")


TOP = {"type": 5, "road_class": 10, "work_period": 10, "district": 10, "contractor": 15}


@reg.add("e10_top_values", " union all ".join(f"select * from (select '{f}' as field, {f} as value, count(*) as n, row_number() over (order by count(*) desc, {f})::int as place from fx_restrictions where {f} is not null group by {f} order by place limit {n})" for f, n in TOP.items()))
def e10(spark, d):
    return summaries.top_values(view(spark, d, "fx_restrictions"), TOP)


@reg.add("e11_calendar_counts", "select 'month' as unit, month(start_ts)::int as at, count(*) as n from fx_restrictions group by all union all select 'weekday', (isodow(start_ts) - 1)::int, count(*) from fx_restrictions group by all union all select 'hour', hour(end_ts)::int, count(*) from fx_restrictions where end_ts is not null group by all")
def e11(spark, d):
    r = view(spark, d, "fx_restrictions")
    units = F.array(*[F.struct(F.lit(u).alias("unit"), e.alias("at")) for u, e in (("month", F.month("start_ts")), ("weekday", F.weekday("start_ts")), ("hour", F.hour("end_ts")))])
    return r.select(F.inline(units)).where("at is not null").groupBy("unit", "at").agg(F.count("*").alias("n"))


@reg.add("e12_histogram", "with e as (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) select least(29, floor((o_totalprice - lo) / ((hi - lo) / 30)))::bigint as bin, count(*) as n from orders, e group by 1")
def e12(spark, d):
    return summaries.histogram(table(spark, d, "orders"), "o_totalprice", 30).select("bin", "n")


@reg.add("e13_numeric", "select avg(duration_hours) as mean, median(duration_hours) as median, min(duration_hours) as min, max(duration_hours) as max, min(lon) as west, max(lon) as east, min(lat) as south, max(lat) as north from fx_records")
def e13(spark, d):
    h = "duration_hours"
    rows = view(spark, d, REC)
    median = summaries.exact_quantiles(rows.select(F.lit(h).alias("of"), c(h).cast("double").alias("v")), "of", "v", {"median": 0.5}).select("median")
    whole = rows.agg(F.avg(h).alias("mean"), F.min(h).alias("min"), F.max(h).alias("max"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    return whole.join(F.broadcast(median), F.lit(True), "left")  # one row each


@reg.add("e14_shares", "select curr_impact as value, count(*) as n, count(*) / sum(count(*)) over () as share from fx_restrictions group by 1")
def e14(spark, d):
    return summaries.shares(view(spark, d, "fx_restrictions"), "curr_impact")


@reg.add("e15_by_impact", "select curr_impact as impact, count(*) as n, avg(case when type = 'ROAD_CLOSED' then 1e0 else 0e0 end) as closed, avg(case when work_period = 'Continuous' then 1e0 else 0e0 end) as continuous, avg(case when road_class = 'Local Road' then 1e0 else 0e0 end) as local from fx_restrictions group by 1")
def e15(spark, d):
    share = lambda col, v: F.avg(F.when(c(col) == v, 1.0).otherwise(0.0))
    return view(spark, d, "fx_restrictions").groupBy(c("curr_impact").alias("impact")).agg(F.count("*").alias("n"), share("type", "ROAD_CLOSED").alias("closed"), share("work_period", "Continuous").alias("continuous"), share("road_class", "Local Road").alias("local"))


@reg.add("e20_overview", "select count(*) as total, count(*) filter (impact_evaluable) as evaluated, count(*) - count(*) filter (impact_evaluable) as not_evaluated, count(*) filter (replacement_available) as replacement_available, count(*) filter (impact_severity = 'SEVERE') * 100e0 / count(*) as severe_percent from fx_records")
def e20(spark, d):
    n, ev = F.count("*"), F.count_if("impact_evaluable")
    return view(spark, d, REC).agg(n.alias("total"), ev.alias("evaluated"), (n - ev).alias("not_evaluated"), F.count_if("replacement_available").alias("replacement_available"), (F.count_if(c("impact_severity") == "SEVERE") * 100.0 / n).alias("severe_percent"))


@reg.add("e21_upper_median", "with t as (select duration_hours from (select * from fx_records order by restriction_id limit 100) where duration_hours is not null), r as (select duration_hours, row_number() over (order by duration_hours) - 1 as i, count(*) over () as n from t) select duration_hours as median, n from r where i = n // 2")
def e21(spark, d):
    from kerbline.plans.explain import upper_median

    return upper_median(view(spark, d, REC))


PRED = "select *, row_number() over (order by ts desc, event_id desc) as back from fx_predictions"


@reg.add("e24_label_shares", "select prediction as value, count(*) as n, count(*) / sum(count(*)) over () as share from fx_predictions group by 1")
def e24(spark, d):
    return summaries.shares(view(spark, d, "fx_predictions"), "prediction")


@reg.add("e25_monitor", f"select count(*) as total, avg(confidence) as average_confidence, count(*) filter (prediction = 'High') as high from ({PRED}) where back <= 1000")
def e25(spark, d):
    return summaries.recent(view(spark, d, "fx_predictions"), 1000).agg(F.count("*").alias("total"), F.avg("confidence").alias("average_confidence"), F.count_if(c("prediction") == "High").alias("high"))


@reg.add("g5_recent", f"select event_id, prediction from ({PRED}) where back <= 100")
def g5(spark, d):
    return summaries.recent(view(spark, d, "fx_predictions"), 100).select("event_id", "prediction")


_TERMS = "with c as (select prediction as label, count(*) / sum(count(*)) over () as q from ({log}) group by 1), b(label, p) as (values ('None', 0.78e0), ('Low', 0.13e0), ('High', 0.09e0))"


@reg.add("k9_drift", _TERMS.format(log=f"select * from ({PRED}) where back <= 100") + " select sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))) as magnitude, sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))) > 0.1 as drifted from c join b using (label)")
def k9(spark, d):
    current = summaries.shares(summaries.recent(view(spark, d, "fx_predictions"), 100), "prediction")
    return summaries.drift(current.withColumnRenamed("value", "label"))


@reg.add("h1_difference", "select restriction_id, segment_id from fx_matches where signal = 'proximity' except select restriction_id, segment_id from fx_matches where signal = 'direct_intersection'")
def h1(spark, d):
    m = view(spark, d, "fx_matches")
    ids = lambda s: m.where(c("signal") == s).select("restriction_id", "segment_id")
    return ids("proximity").distinct().join(ids("direct_intersection"), ["restriction_id", "segment_id"], "left_anti")


@reg.add("h2_union_size", "select restriction_id, count(distinct segment_id) as n from fx_matches group by 1")
def h2(spark, d):
    return view(spark, d, "fx_matches").groupBy("restriction_id").agg(F.count_distinct("segment_id").alias("n"))


@reg.add("h3_layer_union", "select 'bench' as kind, p_partkey as id, p_name as name from part union all select 'transit', s_suppkey, s_name from supplier union all select 'library', n_nationkey, n_name from nation")
def h3(spark, d):
    from kerbline.sources.poi import union_layers

    layer = lambda t, i, n, k: table(spark, d, t).select(F.lit(k).alias("kind"), c(i).cast("long").alias("id"), c(n).alias("name"))
    return union_layers([layer("part", "p_partkey", "p_name", "bench"), layer("supplier", "s_suppkey", "s_name", "transit"), layer("nation", "n_nationkey", "n_name", "library")])


@reg.add("h4_all_barriers", "select distinct segment_id as segment from fx_matches where signal = 'direct_intersection'")
def h4(spark, d):
    from kerbline.operators.network import barrier_sets

    return barrier_sets(view(spark, d, "fx_matches").where("signal = 'direct_intersection'")).select(F.explode("segments").alias("segment")).distinct()


@reg.add("h5_strata_union", "select restriction_id, min(s) as stratum from (select restriction_id, 1 as s from fx_records where impact_severity = 'SEVERE' union all select restriction_id, 2 from fx_records where evidence_confidence = 'HIGH') group by 1")
def h5(spark, d):
    r = view(spark, d, REC)
    a = r.where("impact_severity = 'SEVERE'").select("restriction_id", F.lit(1).alias("stratum"))
    return a.unionByName(r.where("evidence_confidence = 'HIGH'").select("restriction_id", F.lit(2).alias("stratum"))).groupBy("restriction_id").agg(F.min("stratum").alias("stratum"))


@reg.add("h6_labels", "select distinct label from (select curr_impact as label from fx_restrictions union all select prediction from fx_predictions)")
def h6(spark, d):
    return view(spark, d, "fx_restrictions").select(c("curr_impact").alias("label")).union(view(spark, d, "fx_predictions").select("prediction")).distinct()


STEPS = "select (u / 50)::bigint as path, u * 10 + right(seg, 1)::bigint as pos, len_m, sidewalk, crosswalk, px_type, case when u % 3 = 0 then 'Local' else '' end as road_type from fx_edges"


def _steps(spark, d):
    e = view(spark, d, "fx_edges")
    return e.select(F.round(c("u") / 50).cast("long").alias("path"), (c("u") * 10 + F.substring("seg", -1, 1).cast("long")).alias("pos"), "len_m", "sidewalk", "crosswalk", "px_type", F.when(c("u") % 3 == 0, "Local").otherwise("").alias("road_type"))


_STEPS = STEPS.replace("(u / 50)::bigint", "round(u / 50)::bigint")
_EVENTS = f"""
with s as ({_STEPS}),
a as (select *, coalesce(sum(len_m) over w, 0) as at_m, last_value(nullif(sidewalk, '') ignore nulls) over w as known from s window w as (partition by path order by pos rows between unbounded preceding and 1 preceding)),
ev as (select path, pos, 0 as ord, round(at_m, 1) as at_m, 'sidewalk_change' as kind, sidewalk as label from a where sidewalk <> '' and sidewalk is distinct from known
       union all select path, pos, 1, round(at_m, 1), 'crosswalk', 'Crosswalk' from a where crosswalk = 1
       union all select path, pos, 2, round(at_m, 1), 'signal', 'Pedestrian signal (' || px_type || ')' from a where px_type <> '')"""


@reg.add("f1_walk_events", _EVENTS + " select path, pos, at_m, kind, label from ev")
def f1(spark, d):
    return sequences.walk_events(_steps(spark, d)).drop("order")


@reg.add("f2_walk_context", _EVENTS + """, p as (select path, dist from (select distinct path from s), (values (0e0), (500e0), (2000e0)) t(dist))
select p.path, p.dist, arg_max(label, [pos, ord]) filter (kind = 'sidewalk_change' and at_m <= dist) as sidewalk, arg_min(label, [pos, ord]) filter (kind <> 'sidewalk_change' and at_m > dist + 1) as next_label,
  arg_min(at_m, [pos, ord]) filter (kind <> 'sidewalk_change' and at_m > dist + 1) as next_at_m from p left join ev using (path) group by 1, 2""")
def f2(spark, d):
    s = _steps(spark, d)
    places = s.select("path").distinct().withColumn("dist", F.explode(F.array(F.lit(0.0), F.lit(500.0), F.lit(2000.0))))
    return sequences.walk_context(sequences.walk_events(s), places)


@reg.add("f3_rank", "select restriction_id, segment_id, pos, row_number() over (partition by restriction_id order by pos, segment_id, signal)::int as rank from fx_matches")
def f3(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "fx_matches").select("restriction_id", "segment_id", "pos", F.row_number().over(Window.partitionBy("restriction_id").orderBy("pos", "segment_id", "signal")).alias("rank"))


@reg.add("f4_cumulative", f"select path, pos, coalesce(sum(len_m) over (partition by path order by pos rows between unbounded preceding and 1 preceding), 0) as at_m from ({_STEPS})")
def f4(spark, d):
    return sequences.along(_steps(spark, d)).select("path", "pos", "at_m")


@reg.add("e18_route_character", f"""
select path, count(*) filter (crosswalk = 1) as crosswalks, count(*) filter (px_type <> '') as signals, count(*) filter (sidewalk = 'No sidewalk') as none, count(*) filter (road_type = 'Local') as local
from ({_STEPS}) group by path having count(*) filter (crosswalk = 1 or px_type <> '' or sidewalk <> '' or road_type <> '') > 0""")
def e18(spark, d):
    r = sequences.route_character(_steps(spark, d))
    n = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).cast("long")
    return r.select("path", "crosswalks", "signals", n(c("sidewalk_counts"), "No sidewalk").alias("none"), n(c("road_type_counts"), "Local").alias("local"))


@reg.add("f5_first_row", "select restriction_id, segment_id, signal from fx_matches qualify row_number() over (partition by restriction_id, segment_id order by pos, signal) = 1")
def f5(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("restriction_id", "segment_id").orderBy("pos", "signal")
    return view(spark, d, "fx_matches").withColumn("n", F.row_number().over(w)).where("n = 1").select("restriction_id", "segment_id", "signal")


_VERS = "select o_custkey as source, o_orderdate as retrieved_at, o_orderkey as version, sha256(o_orderpriority) as sha256 from orders"


@reg.add("f7_content_change", f"select source, version, lag(sha256) over w <> sha256 as changed_from_previous from ({_VERS}) window w as (partition by source order by retrieved_at, version)")
def f7(spark, d):
    v = table(spark, d, "orders").select(c("o_custkey").alias("source"), c("o_orderdate").alias("retrieved_at"), c("o_orderkey").alias("version"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return sequences.content_changes(v).select("source", "version", "changed_from_previous")


@reg.add("b32_path_sample", f"""
with s as ({_STEPS}), p as (select path, pos, row_number() over w - 1 as i, coalesce(sum(len_m) over (partition by path order by pos rows between unbounded preceding and 1 preceding), 0) as at_m from s window w as (partition by path order by pos)),
pieces as (select path, pos, i, at_m, lead(at_m) over w as end_m from p window w as (partition by path order by pos)),
t as (select path, max(at_m) as total from p group by 1), q as (select path, dist, greatest(0, least(dist, total)) as d from t, (values (100e0), (1e9)) v(dist)),
h as (select q.path, q.dist, i, case when end_m > at_m then (d - at_m) / (end_m - at_m) else 0 end as f from q join pieces using (path) where end_m is not null and d <= end_m qualify row_number() over (partition by q.path, q.dist order by pos) = 1)
select path, dist, round(-79e0 + (i + f) * 0.001e0, 9) as x from h""")
def b32(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("pos")
    pts = sequences.along(_steps(spark, d)).withColumns({"x": F.lit(-79.0) + (F.row_number().over(w) - 1) * 0.001, "y": F.lit(43.6)})
    dist = pts.select("path").distinct().withColumn("dist", F.explode(F.array(F.lit(100.0), F.lit(1e9))))
    return sequences.sample_paths(pts, dist).select("path", "dist", F.round("x", 9).alias("x"))


_CASES = "select restriction_id, k as pos, not valid_polyline as malformed, direct_count as direct, proximity_count as proximity, candidate_edge_count as n_candidates from fx_records"


@reg.add("f8_validation_cases")
def f8(spark, d):
    r = view(spark, d, REC).select("restriction_id", c("k").alias("pos"), (~c("valid_polyline")).alias("malformed"), c("direct_count").alias("direct"), c("proximity_count").alias("proximity"), c("candidate_edge_count").alias("n_candidates"))
    return sequences.validation_cases(r)


@reg.add("f8_dense_cases", "with d as (select restriction_id, candidate_edge_count as n from fx_records where valid_polyline and direct_count > 0) select restriction_id, 'direct-intersection baseline' as reason, 1 as place from d where restriction_id = (select min(restriction_id) from d)")
def f8b(spark, d):
    r = view(spark, d, REC).where("valid_polyline and direct_count > 0").select("restriction_id", c("k").alias("pos"), (~c("valid_polyline")).alias("malformed"), c("direct_count").alias("direct"), c("proximity_count").alias("proximity"), c("candidate_edge_count").alias("n_candidates"))
    return sequences.validation_cases(r, 1)


@reg.add("g1_pages", "select ceil(count(*) / 25)::bigint as pages, count(*) as total from fx_records where impact_severity = 'HIGH'")
def g1(spark, d):
    return listing.page(view(spark, d, REC), 0, 25, impact_severity="HIGH").select("pages", "total").distinct()


@reg.add("g1_last_page", """
with r as (select restriction_id, impact_severity, row_number() over (order by restriction_id) - 1 as pl, count(*) over () as total from fx_records)
select restriction_id, impact_severity, total, ceil(total / 25)::bigint as pages from r where pl >= 25 * ((total - 1) // 25)
union all
(with f as (select restriction_id, impact_severity, row_number() over (order by restriction_id) - 1 as pl, count(*) over () as total from fx_records where impact_severity = 'LOW')
select restriction_id, impact_severity, total, ceil(total / 25)::bigint from f where pl >= 25 * ((total - 1) // 25))""")
def g1_last(spark, d):
    folder = listing.index_pages(view(spark, d, REC))
    out = None
    for equal in ({}, {"impact_severity": "LOW"}):
        n = listing.indexed_page(spark, folder, 0, 1, **equal).first()
        last = listing.indexed_page(spark, folder, 25 * ((n["total"] - 1) // 25) if n else 0, 25, **equal).select("restriction_id", "impact_severity", "total", "pages")
        out = last if out is None else out.unionByName(last)
    return out


@reg.add("g3_by_count", "select evidence_confidence as value, count(*) as n, row_number() over (order by count(*) desc, evidence_confidence)::int as place from fx_records group by 1")
def g3(spark, d):
    return summaries.top_values(view(spark, d, REC), {"evidence_confidence": 100}).drop("field")
