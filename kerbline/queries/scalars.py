"""B: scalar, array, geometry and date expressions."""

from pyspark.sql import functions as F

from kerbline.functions import geo, labels, text, times
from kerbline.queries.registry import Registry, view

reg = Registry()
c = F.col

NUM = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
POLY = rf"^\s*\[\s*{NUM}\s*,\s*{NUM}\s*\](?:\s*,\s*\[\s*{NUM}\s*,\s*{NUM}\s*\])+\s*$"
PAIR = rf"\[\s*({NUM})\s*,\s*({NUM})\s*\]"
XS, YS = (f"list_transform(regexp_extract_all(polyline_text, '{PAIR}', {g}), lambda t: t::double)" for g in (1, 2))
R = "fx_restrictions"


@reg.add("b1_polyline", f"""
select restriction_id, regexp_matches(polyline_text, '{POLY}') as parsed, case when regexp_matches(polyline_text, '{POLY}') then len({XS}) end as n_points,
       case when regexp_matches(polyline_text, '{POLY}') then ({XS})[1] end as x1, case when regexp_matches(polyline_text, '{POLY}') then ({YS})[2] end as y2
from fx_restrictions""")
def b1(spark, d):
    p = text.points(c("polyline_text"), finite_only=True)
    return view(spark, d, R).select("restriction_id", p.isNotNull().alias("parsed"), F.when(p.isNotNull(), F.size(p)).cast("long").alias("n_points"), p[0]["x"].alias("x1"), p[1]["y"].alias("y2"))


@reg.add("b2_finite", """
select event_id, case when isfinite(try_cast(trim(s) as double)) then try_cast(trim(s) as double) end as value
from (select event_id, case event_id % 5 when 0 then 'NaN' when 1 then ' 12.5 ' when 2 then 'abc' when 3 then '1e3' else '' end as s from events)""")
def b2(spark, d):
    s = F.when(c("event_id") % 5 == 0, "NaN").when(c("event_id") % 5 == 1, " 12.5 ").when(c("event_id") % 5 == 2, "abc").when(c("event_id") % 5 == 3, "1e3").otherwise("")
    return view(spark, d, "events").select("event_id", text.finite(s).alias("value"))


@reg.add("b3_from_millis", "select o_orderkey, epoch_ms(o_orderkey * 1000000 + 7) as at from orders where o_orderkey % 3 <> 0 union all select o_orderkey, null from orders where o_orderkey % 3 = 0")
def b3(spark, d):
    ms = F.when(c("o_orderkey") % 3 == 0, "x").otherwise((c("o_orderkey") * 1000000 + 7).cast("string"))
    return view(spark, d, "orders").select("o_orderkey", times.from_millis(ms).cast("timestamp_ntz").alias("at"))


@reg.add("b4_blank_to_null", "select restriction_id, nullif(trim(polyline_text), '') as t from fx_restrictions")
def b4(spark, d):
    return view(spark, d, R).select("restriction_id", text.blank_to_null(c("polyline_text")).alias("t"))


@reg.add("b5_codes", """
select restriction_id, list_filter(string_split(s, ';'), lambda x: x <> '') as codes, array_to_string(list_filter(string_split(s, ';'), lambda x: x <> ''), ';') as joined
from (select restriction_id, concat(type, ';;', case when k % 2 = 0 then road_class else '' end, ';', curr_impact) as s from fx_restrictions)""")
def b5(spark, d):
    s = F.concat(c("type"), F.lit(";;"), F.when(c("k") % 2 == 0, c("road_class")).otherwise(""), F.lit(";"), c("curr_impact"))
    return view(spark, d, R).select("restriction_id", text.codes(s).alias("codes"), text.code_text(text.codes(s)).alias("joined"))


@reg.add("b6_coerce", """
select k, t = 'True' as truth, try_cast(nullif(n, '') as double) as number, cast(trunc(try_cast(nullif(n, '') as double)) as int) as whole
from (select k, case when k % 2 = 0 then 'True' else 'False' end as t, case when k % 3 = 0 then '' when k % 3 = 1 then concat(cast(k as string), '.75') else 'n/a' end as n from fx_restrictions)""")
def b6(spark, d):
    t = F.when(c("k") % 2 == 0, "True").otherwise("False")
    n = F.when(c("k") % 3 == 0, "").when(c("k") % 3 == 1, F.concat(c("k").cast("string"), F.lit(".75"))).otherwise("n/a")
    return view(spark, d, R).select("k", text.truth(t).alias("truth"), text.number(n).alias("number"), text.whole(n).alias("whole"))


_MS = "epoch_ms(start_ts) as s, epoch_ms(end_ts) as e"


def _ms(df):
    ms = lambda x: F.unix_millis(c(x).cast("timestamp"))
    return df.withColumns({"s": ms("start_ts"), "e": ms("end_ts")})


@reg.add("b7_hours", f"select restriction_id, case when e >= s then (e - s) / 3600000e0 end as hours from (select *, {_MS} from fx_restrictions)")
def b7(spark, d):
    return _ms(view(spark, d, R)).select("restriction_id", times.hours_between(c("s"), c("e")).alias("hours"))


@reg.add("b8_days", f"select restriction_id, (e - s) / 86400000e0 as days from (select *, {_MS} from fx_restrictions)")
def b8(spark, d):
    return _ms(view(spark, d, R)).select("restriction_id", times.days_between(c("s"), c("e")).alias("days"))


@reg.add("b10_geojson_valid", """
select restriction_id, geom_type, ok from (
  select restriction_id, case k % 4 when 0 then 'Point' when 1 then 'LineString' when 2 then 'MultiLineString' else 'Polygon' end as geom_type,
         case k % 4 when 0 then true when 1 then k % 8 = 1 when 2 then k % 8 = 2 else false end as ok from fx_restrictions)""")
def b10(spark, d):
    from kerbline.sources.geojson import normalized

    pair = lambda i: F.concat(F.lit("["), (c("lon") + i).cast("string"), F.lit(","), c("lat").cast("string"), F.lit("]"))
    line = F.concat(F.lit("["), pair(0), F.lit(","), pair(1), F.lit("]"))
    short = F.concat(F.lit("["), pair(0), F.lit("]"))
    kind = F.when(c("k") % 4 == 0, "Point").when(c("k") % 4 == 1, "LineString").when(c("k") % 4 == 2, "MultiLineString").otherwise("Polygon")
    coords = (
        F.when(c("k") % 4 == 0, pair(0)).when(c("k") % 8 == 1, line).when(c("k") % 4 == 1, short)
        .when(c("k") % 8 == 2, F.concat(F.lit("["), line, F.lit("]"))).when(c("k") % 4 == 2, "[]").otherwise(line)
    )
    doc = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}"))
    g = normalized(doc)
    return view(spark, d, R).select("restriction_id", kind.alias("geom_type"), g.isNotNull().alias("ok"))


_UTM = """
with p as (select restriction_id, radians(lat) as phi, radians(lon + 81) as lam from fx_restrictions),
q as (select restriction_id, lam, atanh(sin(phi)) - {e} * atanh({e} * sin(phi)) as psi from p),
r as (select restriction_id, atan2(sinh(psi), cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + sinh(psi) * sinh(psi))) as eta from q)
select restriction_id, round(500000e0 + {kr} * (eta + {sx}), 3) as x, round({kr} * (xi + {sy}), 3) as y from r"""


def _utm_sql() -> str:
    n = geo.FLATTENING / (2 - geo.FLATTENING)
    e = (geo.FLATTENING * (2 - geo.FLATTENING)) ** 0.5
    radius = geo.SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    sx = " + ".join(f"{v!r}::double * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, v in enumerate(a, 1))
    sy = " + ".join(f"{v!r}::double * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, v in enumerate(a, 1))
    return _UTM.format(e=f"{e!r}::double", kr=f"{geo.SCALE * radius!r}::double", sx=sx, sy=sy)


@reg.add("b11_project", _utm_sql())
def b11(spark, d):
    p = geo.project(c("lon"), c("lat"))
    return view(spark, d, R).select("restriction_id", F.round(p["x"], 3).alias("x"), F.round(p["y"], 3).alias("y"))


@reg.add("b12_from_mercator", "select k, round(degrees(x / 6378137e0), 9) as lon, round(degrees(atan(sinh(y / 6378137e0))), 9) as lat from (select k, -8840000e0 - k * 10 as x, 5410000e0 + k * 3 as y from fx_nodes)")
def b12(spark, d):
    p = geo.from_mercator(-8840000.0 - c("k") * 10, 5410000.0 + c("k") * 3)
    return view(spark, d, "fx_nodes").select("k", F.round(p["lon"], 9).alias("lon"), F.round(p["lat"], 9).alias("lat"))


_HAV = "round(2 * 6371008.8e0 * asin(sqrt(pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b0} - {a0}) / 2), 2))), 6)"


@reg.add("b13_haversine", f"select restriction_id, {_HAV.format(a0='lon', a1='lat', b0='-79.3832e0', b1='43.6532e0')} as metres, coalesce(case when polyline_text not in ('BAD', '') then {_HAV.format(a0=f'({XS})[1]', a1=f'({YS})[1]', b0=f'({XS})[2]', b1=f'({YS})[2]')} end, null) as length_m from fx_restrictions")
def b13(spark, d):
    p = text.points(c("polyline_text"))
    return view(spark, d, R).select("restriction_id", F.round(geo.haversine(c("lon"), c("lat"), F.lit(-79.3832), F.lit(43.6532)), 6).alias("metres"), F.round(geo.sphere_length(p), 6).alias("length_m"))


@reg.add("b14_flat_distance", "select restriction_id, round(sqrt(pow((-79.38e0 - lon) * 111320 * cos(radians((lat + 43.65e0) / 2)), 2) + pow((43.65e0 - lat) * 110540, 2)), 6) as metres from fx_restrictions")
def b14(spark, d):
    return view(spark, d, R).select("restriction_id", F.round(geo.flat_distance(c("lon"), c("lat"), F.lit(-79.38), F.lit(43.65)), 6).alias("metres"))


@reg.add("b15_bearing", "select restriction_id, round(degrees(atan2(sin(radians(-79.38e0 - lon)) * cos(radians(43.65e0)), cos(radians(lat)) * sin(radians(43.65e0)) - sin(radians(lat)) * cos(radians(43.65e0)) * cos(radians(-79.38e0 - lon)))), 6) as degrees from fx_restrictions")
def b15(spark, d):
    return view(spark, d, R).select("restriction_id", F.round(geo.bearing(c("lon"), c("lat"), F.lit(-79.38), F.lit(43.65)), 6).alias("degrees"))


@reg.add("b16_moved", "select restriction_id, round(lon + 150 * sin(radians(k % 360)) / (111320 * cos(radians(lat))), 9) as x, round(lat + 150 * cos(radians(k % 360)) / 110540e0, 9) as y from fx_restrictions")
def b16(spark, d):
    p = geo.moved(c("lon"), c("lat"), c("k") % 360, F.lit(150))
    return view(spark, d, R).select("restriction_id", F.round(p["x"], 9).alias("x"), F.round(p["y"], 9).alias("y"))


def _path(x1="x1", y1="y1", x2="x2", y2="y2"):
    return F.array(*[F.struct(c(a).cast("double").alias("x"), c(b).cast("double").alias("y")) for a, b in ((x1, y1), (x2, y2))])


@reg.add("b17_plane_length", "select seg, round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)), 9) as len_m from fx_edges")
def b17(spark, d):
    return view(spark, d, "fx_edges").select("seg", F.round(geo.plane_length(_path()), 9).alias("len_m"))


@reg.add("b18_centroid", f"select restriction_id, round(coalesce(case when polyline_text not in ('BAD', '') then list_sum({XS}) / len({XS}) end, lon), 9) as x, round(coalesce(case when polyline_text not in ('BAD', '') then list_sum({YS}) / len({YS}) end, lat), 9) as y from fx_restrictions")
def b18(spark, d):
    m = geo.centroid(text.points(c("polyline_text")))
    return view(spark, d, R).select("restriction_id", F.round(F.coalesce(m["x"], c("lon")), 9).alias("x"), F.round(F.coalesce(m["y"], c("lat")), 9).alias("y"))


@reg.add("b19_bounds", f"with p as (select unnest({XS}) as x, unnest({YS}) as y from fx_restrictions where polyline_text not in ('BAD', '')) select min(x) as west, max(x) as east, min(y) as south, max(y) as north from p")
def b19(spark, d):
    b = geo.bounds(text.points(c("polyline_text")))
    rows = view(spark, d, R).select(b.alias("b"))
    return rows.agg(*[(F.min if e in ("west", "south") else F.max)(f"b.{e}").alias(e) for e in ("west", "east", "south", "north")])


@reg.add("b20_within", "select restriction_id, lon between -79.8e0 and -79e0 and lat between 43.4e0 and 43.9e0 as in_city, lon between -79.41e0 and -79.36e0 and lat between 43.63e0 and 43.68e0 as downtown from fx_restrictions")
def b20(spark, d):
    return view(spark, d, R).select("restriction_id", geo.within(c("lon"), c("lat"), geo.BOUNDS).alias("in_city"), geo.within(c("lon"), c("lat"), geo.DOWNTOWN_BOUNDS).alias("downtown"))


@reg.add("b21_cell", "select restriction_id, floor((lon + 79.5e0) / 0.02e0)::bigint as i, floor((lat - 43.6e0) / 0.015e0)::bigint as j, -79.5e0 + floor((lon + 79.5e0) / 0.02e0) * 0.02e0 as west from fx_restrictions")
def b21(spark, d):
    i, j = geo.cell(c("lon") + 79.5, F.lit(0.02)), geo.cell(c("lat") - 43.6, F.lit(0.015))
    return view(spark, d, R).select("restriction_id", i.alias("i"), j.alias("j"), (F.lit(-79.5) + i * 0.02).alias("west"))


@reg.add("b22_tidy_ring", """
with r as (select k, [x / 7e0, x / 7e0, (x + 9) / 7e0, (x + 9) / 7e0, x / 7e0] as xs, [y / 7e0, y / 7e0 + (k % 2) * 1e-9, y / 7e0, (y + 5) / 7e0, y / 7e0] as ys from fx_nodes),
v as (select k, i, round(xs[i], 5) as x, round(ys[i], 5) as y from r, range(1, 6) as t(i)),
w as (select *, lag(x) over (partition by k order by i) as px, lag(y) over (partition by k order by i) as py from v)
select k, count(*) as n from w where px is null or px <> x or py <> y group by k having count(*) >= 4""")
def b22(spark, d):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = c("x") / 7, c("y") / 7
    x9, y5 = (c("x") + 9) / 7, (c("y") + 5) / 7
    ring = F.array(pt(x, y), pt(x, y + (c("k") % 2) * F.lit(1e-9)), pt(x9, y), pt(x9, y5), pt(x, y))
    t = geo.tidy_ring(ring)
    return view(spark, d, "fx_nodes").select("k", F.size(t).cast("long").alias("n")).where(t.isNotNull())


@reg.add("b23_parts", "select seg || ':' || p as edge_id, p::int as part from fx_edges, (values (0), (1)) as t(p) where p = 0 or u % 10 = 0")
def b23(spark, d):
    from kerbline.operators.network import exploded_parts

    e = view(spark, d, "fx_edges")
    parts = F.when(c("u") % 10 == 0, F.array(_path(), _path())).otherwise(F.array(_path()))
    return exploded_parts(e.select(c("seg").alias("segment_id"), parts.alias("parts"))).select("edge_id", "part")


@reg.add("b24_duration_class", "select restriction_id, case when duration_hours is null then 'unknown' when duration_hours >= 720 then 'long' else 'short' end as class from fx_inputs")
def b24(spark, d):
    return view(spark, d, "fx_inputs").select("restriction_id", times.duration_class(c("duration_hours")).alias("class"))


@reg.add("b25_duration_text", """
select restriction_id,
  case when h is null then 'duration unknown' when h < 48 then '~' || greatest(1, floor(h + 0.5)::bigint) || 'h restriction'
       when h / 24 < 45 then '~' || floor(h / 24 + 0.5)::bigint || 'd restriction' when h / 24 / 30.44e0 < 18 then '~' || floor(h / 24 / 30.44e0 + 0.5)::bigint || 'mo restriction'
       else '~' || printf('%.1f', h / 24 / 30.44e0 / 12) || 'yr restriction' end as short,
  case when h is null then 'unknown duration' when h >= 24 then 'about ' || round(h / 24)::bigint || ' days (' || round(h)::bigint || ' hours)' else 'about ' || round(h)::bigint || ' hours' end as long,
  greatest(1, round(h / 24)::bigint) as days,
  case when h is null then '—' when h * 10.003e0 >= 1000 then printf('%.2f', h * 10.003e0 / 1000) || ' km' else floor(h * 10.003e0 + 0.5)::bigint || ' m' end as metres
from (select restriction_id, duration_hours as h from fx_inputs)""")
def b25(spark, d):
    h = c("duration_hours")
    days = F.when(h.isNull(), F.lit(1)).otherwise(times.whole_days(h))
    return view(spark, d, "fx_inputs").select("restriction_id", times.humanized(h).alias("short"), times.about(h).alias("long"), days.alias("days"), times.distance_text(h * 10.003).alias("metres"))


@reg.add("b26_calendar", "select restriction_id, year(start_ts)::int as year, (isodow(start_ts) - 1)::int as weekday, month(start_ts)::int as month, case when isodow(start_ts) >= 6 then 1 else 0 end as weekend, hour(start_ts)::int as hour, dayname(start_ts) as day_name from fx_restrictions")
def b26(spark, d):
    return view(spark, d, R).select("restriction_id", times.calendar(c("start_ts")).alias("t")).select("restriction_id", "t.*")


@reg.add("b27_centre_km", "select restriction_id, round(sqrt(pow((lat - 43.6532e0) * 111, 2) + pow((lon + 79.3832e0) * 111 * cos(radians(lat)), 2)), 9) as km from fx_restrictions")
def b27(spark, d):
    return view(spark, d, R).select("restriction_id", F.round(geo.centre_km(c("lon"), c("lat")), 9).alias("km"))


@reg.add("b28_poi_texts", """
select c_custkey, case when c_custkey % 4 = 0 then 'Bench' when c_custkey % 2 = 0 then c_custkey || ' ' || c_mktsegment else c_mktsegment end as bench,
       case when c_custkey % 3 = 0 then 'Park washroom' else 'Park washroom · ' || c_mktsegment end as washroom,
       case when c_custkey % 6 = 0 then 'Community centre · Accessible, Public washroom' when c_custkey % 2 = 0 then 'Community centre · Accessible'
            when c_custkey % 3 = 0 then 'Community centre · Public washroom' else 'Community centre' end as community
from customer""")
def b28(spark, d):
    k, seg = c("c_custkey"), c("c_mktsegment")
    number = F.when(k % 2 == 0, k.cast("string")).otherwise(" ")
    street = F.when(k % 4 == 0, "").otherwise(seg)
    number = F.when(k % 4 == 0, "").otherwise(number)
    return view(spark, d, "customer").select(
        "c_custkey", labels.place_name(labels.address(number, street), default="Bench").alias("bench"),
        labels.with_detail("Park washroom", F.when(k % 3 == 0, " ").otherwise(seg), "Park washroom").alias("washroom"),
        labels.flags("Community centre", Accessible=F.when(k % 2 == 0, "yes"), Public_washroom=F.when(k % 3 == 0, "yes").otherwise("")).alias("community"),
    )


@reg.add("b29_poi_point", "select k, case when k % 4 in (0, 1) and lon > -79.45e0 then lon end as lon, case when k % 4 in (0, 1) and lon > -79.45e0 then lat end as lat from fx_restrictions")
def b29(spark, d):
    from kerbline.sources.geojson import point_of

    far = F.when(c("lon") > -79.45, c("lon")).otherwise(c("lon") - 180)
    pair = F.concat(F.lit("["), far.cast("string"), F.lit(","), c("lat").cast("string"), F.lit("]"))
    doc = (
        F.when(c("k") % 4 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), pair, F.lit("}")))
        .when(c("k") % 4 == 1, F.concat(F.lit('{"type":"MultiPoint","coordinates":['), pair, F.lit("]}")))
        .when(c("k") % 4 == 2, F.concat(F.lit('{"type":"MultiPoint","coordinates":['), pair, F.lit(","), pair, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"type":"LineString","coordinates":['), pair, F.lit("]}")))
    )
    p = point_of(doc)
    return view(spark, d, R).select("k", p["x"].alias("lon"), p["y"].alias("lat"))


@reg.add("b30_record_hash", "select c_custkey, sha256('+' || c_custkey || chr(31) || '+' || c_name || chr(31) || case when c_custkey % 2 = 0 then '-' else '+' || c_mktsegment end) as h from customer")
def b30(spark, d):
    return view(spark, d, "customer").select("c_custkey", text.record_hash(c("c_custkey"), c("c_name"), F.when(c("c_custkey") % 2 == 1, c("c_mktsegment"))).alias("h"))


@reg.add("b31_tile_row", "select l_linenumber as zoom, (l_partkey % 4)::int as row_, (pow(2, l_linenumber) - 1 - l_partkey % 4)::bigint as flipped, count(*) as n from lineitem group by all")
def b31(spark, d):
    row = (c("l_partkey") % 4).cast("int")
    return view(spark, d, "lineitem").groupBy(c("l_linenumber").alias("zoom"), row.alias("row_")).agg(F.count("*").alias("n")).withColumn("flipped", geo.tile_row(c("zoom"), c("row_")))


@reg.add("b33_circle", "select k, 25 as n, round(x + 0.5e0 * 1.3e0, 6) as first_x, round(y + 0.5e0 * sin(2 * pi() * 6 / 24), 6) as top_y from fx_nodes")
def b33(spark, d):
    ring = geo.circle(c("x"), c("y"), F.lit(0.5))
    return view(spark, d, "fx_nodes").select("k", F.size(ring).alias("n"), F.round(ring[0]["x"], 6).alias("first_x"), F.round(ring[6]["y"], 6).alias("top_y"))


@reg.add("b33_hull_buffer")
def b33_hull(spark, d):
    from kerbline.operators.hull import hull_buffer

    e = view(spark, d, "fx_restrictions").where("polyline_text not in ('BAD', '')")
    return hull_buffer(e.select(c("restriction_id").alias("id"), text.points(c("polyline_text")).alias("path")), radius_m=50.0)


@reg.add("b34_labels", """
select restriction_id, evidence_confidence as evidence, case impact_severity when 'SEVERE' then 1e0 when 'HIGH' then 0.8e0 when 'MODERATE' then 0.5e0 when 'LOW' then 0.25e0
       else case evidence_confidence when 'HIGH' then 1e0 when 'MEDIUM' then 0.6e0 when 'LOW' then 0.3e0 else 0.1e0 end end as weight,
       case when direct_count > 0 then 'Direct intersection' when proximity_count > 0 then 'Proximity' else 'Unknown match' end as match
from fx_records""")
def b34(spark, d):
    kind = F.when(c("direct_count") > 0, "direct_intersection").when(c("proximity_count") > 0, "proximity").otherwise("other")
    return view(spark, d, "fx_records").select("restriction_id", labels.evidence_label(c("evidence_confidence")).alias("evidence"), labels.heat_weight(c("impact_severity"), c("evidence_confidence")).alias("weight"), labels.match_label(kind).alias("match"))


@reg.add("b35_metric", "select restriction_id, added_distance_m as metric, coalesce(nullif(to_road, ''), 'Not available') as label from fx_records")
def b35(spark, d):
    return view(spark, d, "fx_records").select("restriction_id", text.metric(F.coalesce(c("added_distance_m").cast("string"), F.lit(""))).alias("metric"), text.or_label(c("to_road")).alias("label"))


@reg.add("b36_pair", """
select k, case when k % 4 = 0 then lon end as lon, case when k % 4 = 0 then lat end as lat,
       case k % 4 when 0 then null when 1 then 'NOT_A_PAIR' when 2 then 'NOT_NUMERIC' else 'OUT_OF_BOUNDS' end as error from fx_restrictions""")
def b36(spark, d):
    s = F.when(c("k") % 4 == 0, F.concat(c("lon").cast("string"), F.lit(", "), c("lat").cast("string"))).when(c("k") % 4 == 1, c("lon").cast("string")).when(c("k") % 4 == 2, "a,b").otherwise("-200,10")
    return view(spark, d, R).select("k", text.coordinate_pair(s).alias("p")).select("k", "p.*")


@reg.add("b37_target", "select restriction_id, case when curr_impact = 'Medium' then 'Low' else curr_impact end as target from fx_restrictions")
def b37(spark, d):
    return view(spark, d, R).select("restriction_id", labels.simplified_target(c("curr_impact")).alias("target"))


@reg.add("b38_missing_codes", "select k, case when k % 2 = 0 then ['MISSING_ENDTIME', 'MISSING_ROAD'] else ['MISSING_ENDTIME'] end as codes from fx_restrictions")
def b38(spark, d):
    f = F.when(c("k") % 2 == 0, F.array(F.lit("endtime"), F.lit("road"), F.lit("endtime"))).otherwise(F.array(F.lit("endtime")))
    return view(spark, d, R).select("k", text.missing_codes(f).alias("codes"))


@reg.add("b39_display", "select restriction_id, coalesce(nullif(trim(road), ''), nullif(trim(name), ''), restriction_id) as label, case when nullif(trim(from_road), '') is not null and nullif(trim(to_road), '') is not null then trim(from_road) || ' → ' || trim(to_road) else nullif(trim(name), '') end as streets from fx_records")
def b39(spark, d):
    return view(spark, d, "fx_records").select("restriction_id", text.display_label(c("road"), c("name"), c("restriction_id")).alias("label"), text.cross_street(c("from_road"), c("to_road"), c("name")).alias("streets"))
