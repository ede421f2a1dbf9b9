"""A: scans and sinks, written to the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from kerbline.plans.checkpoint import shared_dir
from kerbline.queries.registry import Registry, table, view
from kerbline.sources import poi, tables

reg = Registry()
c = F.col


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _closures(spark, d):
    r = view(spark, d, "fx_restrictions")
    return r.select(c("restriction_id").alias("Id"), c("lon").cast("string").alias("Longitude"), c("lat").cast("string").alias("Latitude"), c("polyline_text").alias("GeoPolyline"), c("road_class").alias("Road"),
                    F.when(c("k") % 3 == 0, c("district")).otherwise("").alias("Name"), F.lit("").alias("FromRoad"), F.lit("").alias("ToRoad"))


def _feed(spark, d):
    p = _path(spark, "feed")
    tables.write_closures(_closures(spark, d), p)
    return tables.read_closures(spark, p)


@reg.add("a1_feed_scan", "select restriction_id as \"Id\", nullif(polyline_text, '') as \"GeoPolyline\", road_class as \"Road\" from fx_restrictions")
def a1(spark, d):
    return _feed(spark, d).select("Id", F.nullif("GeoPolyline", F.lit("")).alias("GeoPolyline"), "Road")


@reg.add("a2_typed_restrictions", "select restriction_id, lon, lat, polyline_text in ('', 'BAD') as malformed from fx_restrictions")
def a2(spark, d):
    return tables.typed_restrictions(_feed(spark, d)).select("restriction_id", "lon", "lat", "malformed")


@reg.add("a3_feature_scan", "select k::varchar as segment_id, 'LineString' as geom_type from fx_nodes where k % 5 in (0, 1, 2)")
def a3(spark, d):
    from kerbline.queries.blobs import encoded_lines
    from kerbline.sources.geopackage import decoded

    rows = decoded(encoded_lines(view(spark, d, "fx_nodes").select("k", "x", "y")))
    return rows.where("geom_type = 'LineString'").select(c("k").cast("string").alias("segment_id"), "geom_type")


@reg.add("a4_csv_artifact", "select restriction_id, duration_hours, impact_evaluable from fx_records")
def a4(spark, d):
    from kerbline.functions.text import number, truth

    p = _path(spark, "artifact")
    r = view(spark, d, "fx_records").select("restriction_id", "duration_hours", F.when(c("impact_evaluable"), "True").otherwise("False").alias("impact_evaluable"))
    tables.write_csv(r, p)
    back = spark.read.csv(p, header=True, schema="duration_hours string, impact_evaluable string, restriction_id string")
    return back.select("restriction_id", number(c("duration_hours")).alias("duration_hours"), truth(c("impact_evaluable")).alias("impact_evaluable"))


@reg.add("a5_csv_preamble", "select restriction_id as \"ID\", k % 50 = 0 as ragged from fx_restrictions")
def a5(spark, d):
    p = _path(spark, "preamble")
    r = view(spark, d, "fx_restrictions")
    line = F.concat_ws(",", "restriction_id", c("lat").cast("string"), c("lon").cast("string"), F.lit("x"), F.when(c("k") % 50 == 0, F.lit("more")))
    rows = r.select(line.alias("value"))
    # each file is a download of its own, with the lines before the header in front
    head = F.array(*[F.lit(x) for x in ("Road restrictions", "as of today", "ID,Latitude,Longitude,GeoPolyline")])
    numbered = rows.withColumn("i", F.monotonically_increasing_id())
    whole = F.when(F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) == 0, F.concat(head, F.array("value"))).otherwise(F.array("value"))
    numbered.select(F.explode(whole).alias("value")).write.text(p)
    return tables.read_csv_with_preamble(spark, p).select("ID", "ragged")


@reg.add("a6_xml_check", "select 'Id' as field, count(*) as present, 'ok' as state from fx_restrictions union all select 'Name', count(*) filter (k % 3 = 0 and district is not null), 'incomplete' from fx_restrictions union all select 'Planned', 0, 'missing'")
def a6(spark, d):
    return tables.xml_problems(_feed(spark, d), ["Id", "Name", "Planned"])


@reg.add("a6_xml_roots", "select 'Closures' as root, count(*) as records, 'ok' as state from fx_restrictions union all select 'Roads', count(*), 'unexpected root' from fx_restrictions where k % 3 = 0")
def a6_roots(spark, d):
    p = _path(spark, "feeds")
    r = _closures(spark, d)
    tables.write_closures(r, f"{p}/right")
    tables.write_closures(r.where(F.substring("Id", 3, 9).cast("long") % 3 == 0), f"{p}/wrong", root="Roads")
    return tables.xml_roots(spark, f"{p}/*").select("root", "records", "state")


_BAD = {
    10: "missing or duplicate feature ids", 15: "unknown geometry status", 11: "malformed restriction geometry", 13: "malformed feature geometry", 14: "identity differs",
    17: "no geometry provenance", 18: "no source snapshot", 19: "unexpected CRS", 21: "unsupported schema version",
}


@reg.add("a7_artifact_check", " union all ".join(f"select restriction_id, '{problem}' as problem from fx_matches where k % {n} = 0 group by 1" for n, problem in _BAD.items()))
def a7(spark, d):
    from kerbline.plans.artifact import problems

    off = lambda n: c("k") % n == 0
    ids = view(spark, d, "fx_matches").groupBy("restriction_id", "k").agg(F.collect_set("segment_id").alias("ids"))  # the candidates of one restriction
    point, short = '{"type":"Point","coordinates":[-79.4,43.6]}', '{"type":"LineString","coordinates":[[-79.4,43.6]]}'
    features = F.transform(F.when(off(10), F.concat("ids", "ids")).otherwise(c("ids")), lambda i: F.struct(i.alias("feature_id"), F.when(off(13), short).when(~off(2), point).alias("geometry")))
    a = ids.select(
        "restriction_id", F.when(off(21), "spatial-v0").otherwise("spatial-v1").alias("schema_version"), F.when(off(19), "EPSG:26917").otherwise("EPSG:4326").alias("crs"),
        F.when(~off(18), "snap-1").alias("source_snapshot"), F.when(off(14), "R-0").otherwise(c("restriction_id")).alias("source_id"), F.when(~off(17), "EPSG:4326").alias("provenance_crs"),
        F.when(off(15), "?").otherwise("PARTIAL").alias("status"), F.when(off(11), short).when(off(3), point).alias("restriction_geometry"), features.alias("features"))
    p = _path(spark, "artifact")
    tables.as_json_lines(a).write.text(p)
    return problems(spark.read.schema("restriction_id string, schema_version string, crs string, source_snapshot string, source_id string, provenance_crs string, status string, restriction_geometry string, features array<struct<feature_id: string, geometry: string>>").json(p))


@reg.add("a8_layer_resource", "select p_brand as package, arg_min(p_name, [case when p_type like '%A%' then 0 else 1 end, p_partkey]) as name from part group by 1")
def a8(spark, d):
    r = table(spark, d, "part").select(c("p_brand").alias("package"), c("p_partkey").alias("pos"), c("p_name").alias("name"), F.when(c("p_type").contains("A"), "x-4326").otherwise("x").alias("url"), F.lit("geojson").alias("format"))
    return poi.preferred_resource(r).select("package", "name")


@reg.add("a9_transit_stops", "select s_name as name, case s_suppkey % 3 when 1 then 'Wheelchair accessible' when 2 then 'Not wheelchair accessible' else 'Transit stop' end as details from supplier where s_suppkey % 5 <> 0")
def a9(spark, d):
    k = c("s_suppkey")
    p = _path(spark, "stops")
    s = table(spark, d, "supplier").select(c("s_name").alias("stop_name"), F.when(k % 5 == 0, "far").otherwise("-79.4").alias("stop_lon"), F.lit("43.6").alias("stop_lat"), (k % 3).cast("string").alias("wheelchair_boarding"))
    tables.write_csv(s, p)
    return poi.transit_stops(spark.read.csv(p, header=True)).select("name", "details")


@reg.add("a10_a11_sidecars", "select restriction_id, road_class as road from fx_restrictions")
def a10(spark, d):
    p = _path(spark, "locations")
    tables.location_sidecar(_closures(spark, d)).write.json(p)
    return spark.read.schema("restriction_id string, road string").json(p)


@reg.add("a12_json_inputs", "select restriction_id, case when candidate_edge_count = 0 then 'NOT_EVALUATED' when connectivity_lost then 'SEVERE' else 'other' end as severity from fx_inputs")
def a12(spark, d):
    from kerbline.operators.rules import assess

    p = _path(spark, "inputs")
    i = view(spark, d, "fx_inputs").withColumn("missing_fields", F.array().cast("array<string>"))
    i.write.json(p)
    a = assess(spark.read.schema(i.schema).json(p))
    return a.select("restriction_id", F.when(c("severity") == "SEVERE", "SEVERE").when(c("candidate_edge_count") == 0, "NOT_EVALUATED").otherwise("other").alias("severity"))


@reg.add("a13_prediction_log", "select event_id, prediction, confidence from fx_predictions")
def a13(spark, d):
    p = _path(spark, "log")
    rows = view(spark, d, "fx_predictions").select("event_id", "prediction", "confidence")
    tables.append_log(rows.where("event_id % 2 = 0"), p)
    tables.append_log(rows.where("event_id % 2 = 1"), p)
    return spark.read.schema(rows.schema).json(p)


@reg.add("a14_d19_manifest", """
select r_name as name, r_regionkey <> 1 as present, r_regionkey not in (1, 2) as size_ok, r_regionkey not in (1, 2, 3) as hash_ok from region
union all select n_name, true, true, true from nation""")
def a14(spark, d):
    """A manifest of what was published, against files of which one is missing, one is longer and one has other bytes of the same length."""
    p = _path(spark, "payloads")
    region = table(spark, d, "region").select(c("r_name").alias("name"), F.lower("r_name").alias("value"), c("r_regionkey").alias("k"))
    every = region.unionByName(table(spark, d, "nation").select(c("n_name").alias("name"), F.lower("n_name").alias("value"), F.lit(0).alias("k")))
    bytes_ = F.concat("value", F.lit("\n")).cast("binary")  # a line of text
    manifest = every.select("name", F.octet_length(bytes_).cast("long").alias("bytes"), F.sha2(bytes_, 256).alias("sha256"))
    now = every.where("k <> 1").withColumn("value", F.when(c("k") == 2, F.concat("value", F.lit("."))).when(c("k") == 3, F.translate("value", "aeiou", "eioua")).otherwise(c("value")))
    # a folder for each payload, with its one file
    now.select("name", "value").repartition("name").write.partitionBy("name").text(p)
    files = tables.file_hashes(spark, p).where(c("name").startswith("part-"))
    named = files.withColumn("name", F.url_decode(F.regexp_extract("path", "/name=([^/]*)/", 1)))
    return tables.checked_manifest(manifest, named)


@reg.add("a15_next_versions", "select o_custkey as source, sha256(o_orderpriority) as sha256 from (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderdate desc, sha256(o_orderpriority) desc) as i, lead(sha256(o_orderpriority)) over (partition by o_custkey order by o_orderdate desc, sha256(o_orderpriority) desc) as b from orders) where i = 1 and (b is null or b <> sha256(o_orderpriority))")
def a15(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(c("o_custkey").alias("source"), F.lit("u").alias("url"), F.lit("XML").alias("format"), F.lit("n").alias("name"), c("o_orderdate").alias("retrieved_at"), F.sha2("o_orderpriority", 256).alias("sha256"))
    w = Window.partitionBy("source").orderBy(F.desc("retrieved_at"), F.desc("sha256"))
    ranked = o.withColumn("i", F.row_number().over(w))
    return tables.next_versions(ranked.where("i > 1").drop("i"), ranked.where("i = 1").drop("i")).select("source", "sha256")


@reg.add("a16_a17_csv_sink", "select restriction_id, lon::varchar as lon, road_class from fx_restrictions")
def a16(spark, d):
    p = _path(spark, "csv")
    r = view(spark, d, "fx_restrictions")
    tables.write_csv(r.select("road_class", "restriction_id", "lon"), p)
    return spark.read.csv(p, header=True).select("restriction_id", c("lon").cast("double").cast("string").alias("lon"), "road_class")


@reg.add("a18_review_rows", "with a as (select * from fx_matches where threshold_m is null or threshold_m = 5) select r.restriction_id, count(a.k) as candidate_count, count(*) filter (signal = 'direct_intersection') as direct_count, count(*) filter (signal = 'proximity') as proximity_count, count(*) filter (signal = 'point_fallback') as fallback_count, min(distance_m) as minimum_distance_m, 'HIGH=' || count(*) filter (confidence = 'HIGH') || ';MEDIUM=' || count(*) filter (confidence = 'MEDIUM') || ';LOW=' || count(*) filter (confidence = 'LOW') as confidence_distribution from fx_records r left join a using (restriction_id) group by 1")
def a18(spark, d):
    return tables.review_rows(view(spark, d, "fx_records"), view(spark, d, "fx_matches"))


@reg.add("a19_quoted_csv", "select restriction_id, '\"' || road || '\", ' || name as place from fx_records where name is not null")
def a19(spark, d):
    p = _path(spark, "quoted")
    r = view(spark, d, "fx_records").where("name is not null").select("restriction_id", F.concat(F.lit('"'), "road", F.lit('", '), "name").alias("place"))
    tables.write_quoted_csv(r, p)
    return spark.read.csv(p, header=True, escape='"')


_KEPT = ["restriction_id", "k", "impact_severity", "evidence_confidence", "impact_evaluable", "name", "lon"]
_LINE = """'{"evidence_confidence":"' || evidence_confidence || '","impact_evaluable":' || impact_evaluable || ',"impact_severity":"' || impact_severity || '","k":' || k || ',"lon":' || lon ||
  coalesce(',"name":"' || name || '"', '') || ',"restriction_id":"' || restriction_id || '"}'"""


def _tree(levels):
    sql = f"select row_number() over (order by restriction_id) - 1 as i, sha256({_LINE}) as h, 1 as n from fx_records"
    for _ in range(levels):
        sql = f"select i // 1024 as i, sha256(string_agg(h, '' order by i)) as h, sum(n) as n from ({sql}) group by i // 1024"
    return f"select sum(n)::bigint as n, sha256(string_agg(h, '' order by i)) as sha256 from ({sql})"


@reg.add("a20_json_artifact", _tree(3))
def a20(spark, d):
    p = _path(spark, "artifact")
    tables.write_json_artifact(view(spark, d, "fx_records").select(*_KEPT), "restriction_id", p)
    kept = spark.read.schema("restriction_id string, k long, impact_severity string, evidence_confidence string, impact_evaluable boolean, name string, lon double").json(p)
    return tables.artifact_hash(kept, "restriction_id")


@reg.add("a21_feature_collections", "select restriction_id, count(*) as n from fx_matches group by 1")
def a21(spark, d):
    m = view(spark, d, "fx_matches")
    f = m.select("restriction_id", "pos", F.lit('{"type":"Point","coordinates":[0,0]}').alias("geometry"), F.to_json(F.struct("segment_id", "signal")).alias("properties"))
    docs = tables.feature_collections(f)
    return docs.select("restriction_id", F.json_array_length(F.get_json_object("document", "$.features")).cast("long").alias("n"))


@reg.add("a22_cell_sink", "select 'cell_' || i || '_' || j as cell, count(*) as n from (select floor((lon + 79.5e0) / 0.02e0)::bigint as i, floor((lat - 43.6e0) / 0.015e0)::bigint as j from fx_restrictions) group by all")
def a22(spark, d):
    from kerbline.operators.massing import with_cell

    p = _path(spark, "cells")
    tables.write_cells(with_cell(view(spark, d, "fx_restrictions").select("restriction_id", "lon", "lat"), c("lon"), c("lat"), (-79.5, 43.6)), p)
    return spark.read.parquet(p).groupBy("cell").agg(F.count("*").alias("n"))


@reg.add("a23_snapshot_replace", "select restriction_id, case when k % 3 = 1 then 'new' else 'old' end as version, k % 3 as source_snapshot from fx_records where k % 3 <> 1 or k % 2 = 0")
def a23(spark, d):
    r = view(spark, d, "fx_records").select("restriction_id", (c("k") % 3).alias("source_snapshot"), "k")
    old = r.select("restriction_id", F.lit("old").alias("version"), "source_snapshot")
    new = r.where("k % 3 = 1 and k % 2 = 0").select("restriction_id", F.lit("new").alias("version"), "source_snapshot")
    return tables.replaced(old, new)


@reg.add("a26_routing_index", "select u, count(*) as n from (select u from fx_edges union all select v from fx_edges) group by u")
def a26(spark, d):
    e = view(spark, d, "fx_edges").select("u", "v", "seg")
    return tables.routing_index(e, e.select("seg"))[0].groupBy("u").agg(F.count("*").alias("n"))


@reg.add("a27_provenance", "select r_regionkey as source, r_name as title, (select count(*) from nation where n_regionkey = r_regionkey and n_nationkey % 2 = 0) as feature_count, (select count(*) from nation where n_nationkey % 2 = 0)::bigint as total from region")
def a27(spark, d):
    f = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(c("n_regionkey").alias("source"))
    return poi.provenance(f, table(spark, d, "region").select(c("r_regionkey").alias("source"), c("r_name").alias("title")))


@reg.add("m12_match_pipeline")
def m12(spark, d):
    from kerbline.operators import sequences, spatial, summaries
    from kerbline.plans.checkpoint import cut
    from kerbline.queries.space import _segments, _sites

    sites = cut(_sites(spark, d))
    found = cut(spatial.match_candidates(sites, _segments(spark, d)))
    rows = tables.review_rows(sites, found)
    results = rows.join(sites.select("restriction_id", "malformed"), "restriction_id").select("restriction_id", F.xxhash64("restriction_id").alias("pos"), "malformed", c("direct_count").alias("direct"), c("proximity_count").alias("proximity"), c("candidate_count").alias("n_candidates"))
    cases = sequences.validation_cases(results)
    return cases.join(rows, "restriction_id").crossJoin(F.broadcast(summaries.match_summary(sites, found, 5.0)))  # one row
