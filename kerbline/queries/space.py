"""D and I: spatial joins and graph operators over the fixture lattice."""

from pyspark.sql import functions as F

from kerbline.operators import network, paths, spatial
from kerbline.plans.checkpoint import cut
from kerbline.plans.ranks import numbered
from kerbline.queries.registry import VIEWS, Registry, view

reg = Registry()
c = F.col

VIEWS["fx_pois"] = "select k as point, -79.4e0 + x / 1e5 as lon, 43.6e0 + y / 1e5 as lat, k % 6 as kind from fx_nodes"
VIEWS["fx_vertices"] = "select cast(floor(k / 300) as bigint) as route, k, -79.4e0 + x / 1e5 as lon, 43.6e0 + y / 1e5 as lat from fx_nodes"
VIEWS["fx_places"] = "select restriction_id, malformed, -79.4e0 + x1 / 1e5 as lon, 43.6e0 + y1 / 1e5 as lat, x1, y1, x2, y2 from fx_sites"


def _pt(x, y):
    return F.struct(c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))


def _sites(spark, d):
    s = view(spark, d, "fx_sites")
    one = F.array(_pt("x1", "y1"))
    return s.select("restriction_id", "malformed", F.when(c("malformed"), one).otherwise(F.array(_pt("x1", "y1"), _pt("x2", "y2"))).alias("path"))


def _segments(spark, d):
    return view(spark, d, "fx_edges").select(c("seg").alias("segment_id"), F.array(_pt("x1", "y1"), _pt("x2", "y2")).alias("path"), "len_m", "u", "v")


_T = "case when ({qx}-{px})*({qx}-{px})+({qy}-{py})*({qy}-{py}) > 0 then (({rx}-{px})*({qx}-{px})+({ry}-{py})*({qy}-{py}))/(({qx}-{px})*({qx}-{px})+({qy}-{py})*({qy}-{py})) else 0e0 end"
_SIDE = "sign(({qx}-{px})*({ry}-{py})-({qy}-{py})*({rx}-{px}))"
_IN = "({rx} between least({px},{qx}) and greatest({px},{qx}) and {ry} between least({py},{qy}) and greatest({py},{qy}))"


def _xy(template, p, q, r):
    return template.format(px=f"p{p}x", py=f"p{p}y", qx=f"p{q}x", qy=f"p{q}y", rx=f"p{r}x", ry=f"p{r}y")


def _distances(rows: str) -> str:
    """Adds ``distance`` of the pieces (pax, pay)-(pbx, pby) and (pcx, pcy)-(pdx, pdy), a step at a time."""
    corners = (("c", "d", "a"), ("c", "d", "b"), ("a", "b", "c"), ("a", "b", "d"))
    ts = ", ".join(f"greatest(0e0, least(1e0, {_xy(_T, *k)})) as t{i}" for i, k in enumerate(corners))
    ss = ", ".join(f"{_xy(_SIDE, *k)} as s{i}" for i, k in enumerate((("a", "b", "c"), ("a", "b", "d"), ("c", "d", "a"), ("c", "d", "b"))))
    ds = ", ".join(f"pow(p{p}x + t{i}*(p{q}x-p{p}x) - p{r}x, 2) + pow(p{p}y + t{i}*(p{q}y-p{p}y) - p{r}y, 2) as d{i}" for i, (p, q, r) in enumerate(corners))
    touch = " or ".join(f"(s{i} = 0 and {_xy(_IN, *k)})" for i, k in enumerate((("a", "b", "c"), ("a", "b", "d"), ("c", "d", "a"), ("c", "d", "b"))))
    return f"""(select *, case when (s0 <> s1 and s2 <> s3) or {touch} then 0e0 else sqrt(least(d0, d1, d2, d3)) end as distance
      from (select *, {ds} from (select *, {ts}, {ss} from ({rows}))))"""


def _pairs_sql(within: float) -> str:
    return "select restriction_id, malformed, seg as segment_id, len_m, distance from " + _distances(f"""
    select s.restriction_id, s.malformed, e.seg, e.len_m, s.x1::double as pax, s.y1::double as pay, (case when malformed then s.x1 else s.x2 end)::double as pbx, (case when malformed then s.y1 else s.y2 end)::double as pby,
           e.x1::double as pcx, e.y1::double as pcy, e.x2::double as pdx, e.y2::double as pdy
    from fx_sites s join fx_edges e on least(s.x1, s.x2) - {within} <= greatest(e.x1, e.x2) and greatest(s.x1, s.x2) + {within} >= least(e.x1, e.x2)
      and least(s.y1, s.y2) - {within} <= greatest(e.y1, e.y2) and greatest(s.y1, s.y2) + {within} >= least(e.y1, e.y2)""")


_MATCH = f"""
with p as ({_pairs_sql(10)}),
m as (select restriction_id, segment_id, 'direct_intersection' as signal, null::double as threshold_m, distance as distance_m, 'HIGH' as confidence from p where distance = 0 and not malformed
      union all select restriction_id, segment_id, case when malformed then 'point_fallback' else 'proximity' end, t::double, distance, case when malformed then 'LOW' else 'MEDIUM' end
      from p, (values (2), (5), (10)) s(t) where distance <= t and (malformed or distance > 0))"""


@reg.add("d1_direct", _MATCH + " select restriction_id, segment_id from m where signal = 'direct_intersection'")
def d1(spark, d):
    return spatial.match_candidates(_sites(spark, d), _segments(spark, d)).where("signal = 'direct_intersection'").select("restriction_id", "segment_id")


@reg.add("d2_proximity", _MATCH + " select restriction_id, segment_id, threshold_m, round(distance_m, 6) as distance_m from m where signal = 'proximity'")
def d2(spark, d):
    return spatial.match_candidates(_sites(spark, d), _segments(spark, d)).where("signal = 'proximity'").select("restriction_id", "segment_id", "threshold_m", F.round("distance_m", 6).alias("distance_m"))


@reg.add("d3_fallback", _MATCH + " select restriction_id, segment_id, threshold_m, round(distance_m, 6) as distance_m, confidence from m where signal = 'point_fallback'")
def d3(spark, d):
    return spatial.match_candidates(_sites(spark, d), _segments(spark, d)).where("signal = 'point_fallback'").select("restriction_id", "segment_id", "threshold_m", F.round("distance_m", 6).alias("distance_m"), "confidence")


_ONE = "select 0e0 as pax, 0e0 as pay, 200e0 as pbx, 130e0 as pby, seg, x1::double as pcx, y1::double as pcy, x2::double as pdx, y2::double as pdy from fx_edges"


@reg.add("d4_single_match", f"select seg as segment_id, case when distance = 0 then 'direct_intersection' else 'proximity' end as signal, round(distance, 6) as distance_m from {_distances(_ONE)} where distance <= 5")
def d4(spark, d):
    p = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(200.0).alias("x"), F.lit(130.0).alias("y")))
    return spatial.match_one(p, _segments(spark, d), thresholds=(5.0,)).select("segment_id", "signal", F.round("distance_m", 6).alias("distance_m"))


@reg.add("d17_network_nearby", f"with p as ({_pairs_sql(100)}), n as (select restriction_id, count(*) as edges, sum(len_m) as length_m from p where distance <= 100 group by 1) select s.restriction_id, coalesce(edges, 0) as edges, round(coalesce(length_m, 0), 6) as length_m from fx_sites s left join n using (restriction_id)")
def d17(spark, d):
    return spatial.network_nearby(_sites(spark, d), _segments(spark, d)).select("restriction_id", "edges", F.round("length_m", 6).alias("length_m"))


@reg.add("d17_by_impact", f"with p as ({_pairs_sql(100)}), n as (select restriction_id, count(*) as edges, sum(len_m) as length_m from p where distance <= 100 group by 1) select r.curr_impact as value, count(*) as restrictions, round(avg(coalesce(edges, 0)), 6) as mean_edges, round(avg(coalesce(length_m, 0)), 6) as mean_length_m from fx_sites s left join n using (restriction_id) left join fx_restrictions r using (restriction_id) group by 1")
def d17_by_impact(spark, d):
    found = spatial.nearby_by(spatial.network_nearby(_sites(spark, d), _segments(spark, d)), view(spark, d, "fx_restrictions"), "curr_impact")
    return found.select("value", "restrictions", F.round("mean_edges", 6).alias("mean_edges"), F.round("mean_length_m", 6).alias("mean_length_m"))


@reg.add("d7_last_part", "select s.seg as segment_id, (case when u % 10 = 0 then 1 else 0 end)::int as part, (case when u % 10 = 0 then 2 else 1 end)::bigint as part_count from fx_edges s")
def d7(spark, d):
    e = view(spark, d, "fx_edges")
    parts = e.select(c("seg").alias("segment_id"), F.explode(F.when(c("u") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    return network.last_part_edges(parts)


@reg.add("d8_geometry_join", "select m.restriction_id, m.segment_id, e.x1 from (select restriction_id, 'S-' || k || '-0' as segment_id from fx_matches) m left join fx_edges e on e.seg = m.segment_id")
def d8(spark, d):
    m = view(spark, d, "fx_matches").select("restriction_id", F.concat(F.lit("S-"), c("k").cast("string"), F.lit("-0")).alias("segment_id"))
    return m.join(view(spark, d, "fx_edges").select(c("seg").alias("segment_id"), "x1"), "segment_id", "left").select("restriction_id", "segment_id", "x1")


def _near(a, b):
    return f"sqrt(pow(({b}.lon - {a}.lon) * 111320 * cos(radians(({a}.lat + {b}.lat) / 2)), 2) + pow(({b}.lat - {a}.lat) * 110540, 2))"


@reg.add("d11_pois_near_route", f"select distinct v.route as route_id, p.point from fx_pois p join fx_vertices v on {_near('p', 'v')} <= 150")
def d11(spark, d):
    return spatial.points_near_routes(view(spark, d, "fx_pois"), view(spark, d, "fx_vertices"))


@reg.add("d12_poi_counts", f"select r.restriction_id, count(p.point) as n from fx_places r left join fx_pois p on {_near('r', 'p')} <= 200 group by 1")
def d12(spark, d):
    return spatial.counts_near(view(spark, d, "fx_places"), view(spark, d, "fx_pois"))


@reg.add("d13_restrictions_near", f"select restriction_id from fx_places r where exists (select 1 from fx_vertices v where {_near('r', 'v')} <= 75)")
def d13(spark, d):
    return spatial.restrictions_near(view(spark, d, "fx_places"), view(spark, d, "fx_vertices")).select("restriction_id")


@reg.add("d14_snap", "select restriction_id as point, k as node from (select s.restriction_id, n.k, row_number() over (partition by s.restriction_id order by pow(s.x1 - n.x, 2) + pow(s.y1 - n.y, 2), n.k) as i from fx_sites s cross join fx_nodes n) where i = 1")
def d14(spark, d):
    pts = view(spark, d, "fx_sites").select(c("restriction_id").alias("point"), c("x1").alias("x"), c("y1").alias("y"))
    return spatial.nearest(pts, view(spark, d, "fx_nodes").select(c("k").alias("node"), "x", "y"), 60.0).select("point", "node")


@reg.add("d15_few_or_nearest", "select restriction_id, segment_id from (select *, count(*) over (partition by restriction_id) as n, row_number() over (partition by restriction_id order by pow(distance_m * 3 - 4, 2), segment_id, pos) as i from (select restriction_id, segment_id || '-' || pos as segment_id, distance_m, pos from fx_matches)) where n <= 6 or i <= 5")
def d15(spark, d):
    m = view(spark, d, "fx_matches").select("restriction_id", F.concat_ws("-", "segment_id", "pos").alias("segment_id"), (c("distance_m") * 3).alias("x"), F.lit(0.0).alias("y"))
    return spatial.few_or_nearest(m, m.select("restriction_id", F.lit(4.0).alias("ax"), F.lit(0.0).alias("ay")).distinct()).select("restriction_id", "segment_id")


@reg.add("d16_extent", "with b as (select min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from fx_pois) select count(*) filter (lon between w and e and lat between s and n) as inside, round(greatest(0, least(max(lon), max(e)) - greatest(min(lon), min(w))), 9) as width, round(greatest(0, least(max(lat), max(n)) - greatest(min(lat), min(s))), 9) as height from fx_restrictions, b")
def d16(spark, d):
    xy = lambda v: view(spark, d, v).select(c("lon").alias("x"), c("lat").alias("y"))
    return spatial.extent_overlap(xy("fx_restrictions"), xy("fx_pois")).select("inside", F.round("width", 9).alias("width"), F.round("height", 9).alias("height"))


@reg.add("l10_cross_report", """
with r as (select case when k % 9 <> 0 then lon end as lon, lat from fx_restrictions), b as (select min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from fx_pois), v as (select * from r where lon is not null)
select count(*) as valid_points, count(*) filter (lon between w and e and lat between s and n) as inside, round(greatest(0, least(max(lon), max(e)) - greatest(min(lon), min(w))), 9) as width, round(greatest(0, least(max(lat), max(n)) - greatest(min(lat), min(s))), 9) as height,
  'EPSG:4326' as network_crs, 'EPSG:26917' as metric_crs from v, b""")
def l10(spark, d):
    r = view(spark, d, "fx_restrictions").select(F.when(c("k") % 9 != 0, c("lon")).alias("x"), c("lat").alias("y"))
    n = view(spark, d, "fx_pois").select(c("lon").alias("x"), c("lat").alias("y"))
    return spatial.cross_report(r, n).withColumns({"width": F.round("width", 9), "height": F.round("height", 9)})


@reg.add("d5_metric_guard", "select kind as crs, count(*) as refused from (select case o_orderkey % 4 when 0 then 'EPSG:4326' when 1 then 'EPSG:4269' when 2 then 'EPSG:26917' else 'EPSG:4617' end as kind from orders) where kind <> 'EPSG:26917' group by 1")
def d5(spark, d):
    """How many sites of each system the metric match refuses."""
    from kerbline.queries.registry import table

    k = c("o_orderkey") % 4
    rows = table(spark, d, "orders").select(F.when(k == 0, "EPSG:4326").when(k == 1, "EPSG:4269").when(k == 2, "EPSG:26917").otherwise("EPSG:4617").alias("crs"))
    return spatial.refused(rows)


@reg.add("d18_forbidden", "select q, seg from (values ('a'), ('b')) t(q), fx_edges where not ((q = 'a' and u % 2 = 0) or (q = 'b' and u % 3 = 0))")
def d18(spark, d):
    e = view(spark, d, "fx_edges")
    q = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("q")
    bad = e.select("u", "seg", q).where("(q = 'a' and u % 2 = 0) or (q = 'b' and u % 3 = 0)")
    return e.select("seg", q).join(bad, ["q", "seg"], "left_anti").select("q", "seg")


# ---- graph ----

_B = "b as (select u, v, len_m, seg from fx_edges union all select v, u, len_m, seg from fx_edges)"
_CC = f"""
cc(node, lbl) using key (node) as (select k, k from fx_nodes union
  select b.v, min(cc.lbl) from cc join b on b.u = cc.node join recurring.cc r on r.node = b.v where cc.lbl < r.lbl group by b.v)"""


def _edges(spark, d):
    return view(spark, d, "fx_edges").select(c("seg").alias("edge_id"), "u", "v", "len_m")


def _nodes(spark, d):
    return view(spark, d, "fx_nodes").select(c("k").alias("node"), "x", "y")


@reg.add("i1_clusters", "select k as point, min(k) over (partition by x // 40, y // 40) as cluster from fx_nodes")
def i1(spark, d):
    p = view(spark, d, "fx_nodes").select(c("k").alias("point"), F.floor(c("x") / 40).alias("x"), F.floor(c("y") / 40).alias("y"))
    return network.endpoint_clusters(p, 0.0)


@reg.add("i1_clusters_tolerance", "with recursive l as (select a.k as u, b.k as v from fx_nodes a join fx_nodes b on a.k <> b.k and pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2116), cc(node, lbl) using key (node) as (select k, k from fx_nodes union select l.v, min(cc.lbl) from cc join l on l.u = cc.node join recurring.cc r on r.node = l.v where cc.lbl < r.lbl group by l.v) select node as point, lbl as cluster from cc")
def i1t(spark, d):
    return network.endpoint_clusters(view(spark, d, "fx_nodes").select(c("k").alias("point"), "x", "y"), 46.0)


def _built(spark, d, tol=0.0):
    e = numbered(view(spark, d, "fx_edges"), [c("u"), c("seg")], "pos", 0)
    return network.build_graph(e.select(c("seg").alias("segment_id"), F.lit(0).alias("part"), "pos", F.array(_pt("x1", "y1"), _pt("x2", "y2")).alias("path")), tol)


@reg.add("i2_build_graph", """
with p as (select row_number() over (order by u, seg) - 1 as pos, * from fx_edges), e as (select pos * 2 as i, x1 as x, y1 as y from p union all select pos * 2 + 1, x2, y2 from p), n as (select x, y, min(i) as node from e group by 1, 2)
select seg || ':0' as edge_id, a.node as u, b.node as v, round(len_m, 6) as len_m from p join n a on a.x = x1 and a.y = y1 join n b on b.x = x2 and b.y = y2""")
def i2(spark, d):
    return _built(spark, d)[0].select("edge_id", "u", "v", F.round("len_m", 6).alias("len_m"))


@reg.add("i3_components", f"with recursive {_B}, {_CC} select node, lbl as component from cc")
def i3(spark, d):
    return paths.node_components(_edges(spark, d), _nodes(spark, d))


_AUDIT = f"""with recursive {_B}, {_CC}, g as (select n.k, count(b.u) as d from fx_nodes n left join b on b.u = n.k group by 1)
select (select count(*) from fx_nodes) as nodes, (select count(*) from fx_edges) as edges, (select count(distinct lbl) from cc) as components, (select max(n) from (select count(*) as n from cc group by lbl)) as largest,
  (select count(*) from g where d = 0) as isolated, (select count(*) from fx_edges where u = v) as self_loops, (select string_agg(d || '=' || n, ',' order by d) from (select d, count(*) as n from g group by d)) as degrees"""


def _text(m):
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",")


@reg.add("i4_audit", _AUDIT)
def i4(spark, d):
    e, n = _edges(spark, d), _nodes(spark, d)
    return network.audit(e, n, cut(paths.node_components(e, n))).withColumn("degrees", _text(c("degrees")))


@reg.add("i5_audit_tolerances")
def i5(spark, d):
    out = None
    for tol in (0.0, 0.01, 0.1, 1.0):
        e, n = _built(spark, d, tol)
        e, n = cut(e), cut(n)
        row = network.audit(e, n, cut(paths.node_components(e, n))).withColumns({"tolerance": F.lit(tol), "degrees": _text(c("degrees"))})
        out = row if out is None else out.unionByName(row)
    return out


@reg.add("e22_degrees", f"with {_B} select d as degree, count(*) as n from (select u, count(*) as d from b group by u) group by d")
def e22(spark, d):
    ends = _edges(spark, d).select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


# searches: from every node whose number is divisible by 20 to one that is some twelve steps off, if there is one
_Q = "q as (select k as q, k as src, k + 6 * w + 6 as dst from fx_nodes where k % 20 = 0 and k + 6 * w + 6 in (select k from fx_nodes))"
_OWN_Q = "q as (select seg as q, u as src, v as dst from fx_edges where u % 20 = 0)"


def _queries(spark, d):
    n = view(spark, d, "fx_nodes")
    q = n.where("k % 20 = 0").select(c("k").alias("q"), c("k").alias("src"), (c("k") + 6 * c("w") + 6).alias("dst"))
    return q.join(n.select(c("k").alias("dst")), "dst").select("q", "src", "dst")


def _search(block: str) -> str:
    return f"""
with recursive {_B}, {_Q}, sp(q, node, dist) using key (q, node) as (select q, src, 0e0 from q union
  select sp.q, b.v, min(sp.dist + b.len_m) from sp join b on b.u = sp.node left join recurring.sp r on r.q = sp.q and r.node = b.v
  where {block} and (r.dist is null or sp.dist + b.len_m < r.dist) group by sp.q, b.v)"""


@reg.add("i6_shortest_paths", _search("true") + " select q.q, q.src, q.dst, round(sp.dist, 6) as dist from q left join sp on sp.q = q.q and sp.node = q.dst")
def i6(spark, d):
    return paths.shortest_paths(_edges(spark, d), _queries(spark, d), places=_nodes(spark, d)).select("q", "src", "dst", F.round("dist", 6).alias("dist"))


@reg.add("i7_i8_path_geometry")
def i8(spark, d):
    e = view(spark, d, "fx_edges").select(c("seg").alias("edge_id"), "u", "v", F.array(_pt("x1", "y1"), _pt("x2", "y2")).alias("coords"))
    found = paths.shortest_paths(_edges(spark, d), _queries(spark, d), with_path=True, places=_nodes(spark, d))
    found = cut(found.where("reached").select("q", "src", "path"))
    return paths.path_geometry(found, e).join(found.select("q", F.size("path").alias("edges")), "q")


_OWN = _search("sp.q <> b.seg").replace(_Q, _OWN_Q)


@reg.add("i12_replacements", _OWN + " select q.q as edge_id, sp.dist is not null as path_exists, round(sp.dist, 6) as replacement_m, round(sp.dist - e.len_m, 6) as added_m, round(sp.dist / e.len_m, 6) as ratio, sp.dist is null as lost from q join fx_edges e on e.seg = q.q left join sp on sp.q = q.q and sp.node = q.dst")
def i12(spark, d):
    e = _edges(spark, d)
    r = paths.replacements(e, e.where("u % 20 = 0").select("edge_id"), places=_nodes(spark, d))
    return r.select("edge_id", "path_exists", F.round("replacement_m", 6).alias("replacement_m"), F.round("added_m", 6).alias("added_m"), F.round("ratio", 6).alias("ratio"), "lost")


@reg.add("i10_i11_experiments", _OWN + ", base as (select seg, len_m from fx_edges) select q.q as query, round(e.len_m, 6) as baseline_m, round(sp.dist, 6) as hard_m, sp.dist is null as hard_lost, round(least(coalesce(sp.dist, 1e300), 100 * e.len_m), 6) as penalised_m from q join fx_edges e on e.seg = q.q left join sp on sp.q = q.q and sp.node = q.dst")
def i10(spark, d):
    e = _edges(spark, d)
    q = e.where("u % 20 = 0").select(c("edge_id").alias("q"), c("u").alias("src"), c("v").alias("dst"))
    x = paths.experiments(e, q, q.select("q", c("q").alias("edge_id")), places=_nodes(spark, d))
    return x.select("query", F.round("baseline_m", 6).alias("baseline_m"), F.round("hard_m", 6).alias("hard_m"), "hard_lost", F.round("penalised_m", 6).alias("penalised_m"))


_SETS = "sets as (select (u // 100)::bigint as s, seg from fx_edges where u % 20 = 0)"


@reg.add("i13_edge_sets", f"""
with recursive {_SETS}, x as (select s.s, e.seg, e.u, e.v from sets s join fx_edges e using (seg)), bn as (select distinct s, u as node from x union select distinct s, v from x),
{_B}, cc0(node, lbl) using key (node) as (select k, k from fx_nodes union select b.v, min(cc0.lbl) from cc0 join b on b.u = cc0.node join recurring.cc0 r on r.node = b.v where cc0.lbl < r.lbl group by b.v),
ids as (select distinct s from sets), eb as (select ids.s, b.* from ids, b where not exists (select 1 from sets where sets.s = ids.s and sets.seg = b.seg)),
cc(s, node, lbl) using key (s, node) as (select ids.s, k, k from fx_nodes, ids union select cc.s, eb.v, min(cc.lbl) from cc join eb on eb.s = cc.s and eb.u = cc.node join recurring.cc r on r.s = cc.s and r.node = eb.v where cc.lbl < r.lbl group by cc.s, eb.v),
l as (select bn.s, bn.node, cc0.lbl as before, cc.lbl as after from bn join cc0 using (node) join cc on cc.s = bn.s and cc.node = bn.node),
p as (select a.s, a.after = b.after as ok from l a join l b on a.s = b.s and a.node < b.node and a.before = b.before)
select ids.s, (select count(*) from sets where sets.s = ids.s) as removed_edges, (select count(*) from bn where bn.s = ids.s) as boundary_nodes, (select count(*) from p where p.s = ids.s and ok) as connected_pairs,
  (select count(*) from p where p.s = ids.s and not ok) as disconnected_pairs, (select count(distinct after) - count(distinct before) from l where l.s = ids.s) as component_increase from ids""")
def i13(spark, d):
    e = cut(_edges(spark, d))
    sets = e.where("u % 20 = 0").select(F.expr("u div 100").alias("s"), "edge_id")
    return paths.edge_set_removal(e, sets, cut(paths.node_components(e, _nodes(spark, d))))


@reg.add("i9_routes", _search("true") + f""", {_CC.strip()},
bars as (select 'R-' || (u % 3) as r, seg from fx_edges where u % 11 = 0), qa as (select q, case when src % 40 = 0 then 'all' when src % 100 = 20 then 'R-1' end as avoid from q),
forbidden as (select distinct q, seg from qa join bars on avoid = 'all' or avoid = r),
av(q, node, dist) using key (q, node) as (select q.q, q.src, 0e0 from q join qa using (q) where avoid is not null union
  select av.q, b.v, min(av.dist + b.len_m) from av join b on b.u = av.node left join recurring.av r on r.q = av.q and r.node = b.v left join forbidden f on f.q = av.q and f.seg = b.seg
  where f.q is null and (r.dist is null or av.dist + b.len_m < r.dist) group by av.q, b.v)
select q.q, q.src, q.dst, qa.avoid, a.lbl = b.lbl as reachable, round(sp.dist, 1) as base_m, round(av.dist, 1) as recommended_m,
  case when av.dist is not null then round(round(av.dist, 1) - round(sp.dist, 1), 1) end as added_m, case when av.dist is not null then round(round(av.dist, 1) / round(sp.dist, 1), 3) end as ratio
from q join qa using (q) join cc a on a.node = q.src join cc b on b.node = q.dst left join sp on sp.q = q.q and sp.node = q.dst left join av on av.q = q.q and av.node = q.dst""")
def i9(spark, d):
    return _routes(spark, d).select("q", "src", "dst", "avoid", "reachable", "base_m", "recommended_m", "added_m", "ratio")


def _routes(spark, d):
    e = cut(_edges(spark, d))
    q = _queries(spark, d).withColumn("avoid", F.when(c("src") % 40 == 0, "all").when(c("src") % 100 == 20, "R-1"))
    bars = e.where("u % 11 = 0").select(F.concat(F.lit("R-"), (c("u") % 3).cast("string")).alias("restriction_id"), "edge_id")
    return paths.routes(e, q, bars, cut(paths.node_components(e, _nodes(spark, d))), _nodes(spark, d))


@reg.add("i14_cohort_run")
def i14(spark, d):
    from kerbline.plans.replacement_run import cohort_run

    places = view(spark, d, "fx_places").select("restriction_id", "malformed", "lon", "lat")
    return cohort_run(_sites(spark, d), places, _segments(spark, d), _edges(spark, d), _nodes(spark, d))
