"""The engine's queries against their SQL, and small cases for the rules that have many branches."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import TABLES, canon
from kerbline import queries as engine
from kerbline.functions import geo, text, times
from kerbline.operators import listing, network, paths, rules, sequences, spatial, summaries
from kerbline.sources import geopackage

#: Held against plain versions in test_plain; SQL of its size is not to be had.
SLOW = {"i14_cohort_run", "m11_report", "k10_importance", "k5_k7_k10_trained_model", "k12_a24_saved_model"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(engine.SQL) - SLOW))
def test_query_equals_sql(spark, sf, duck, name):
    have, want = engine.QUERIES[name](spark, sf).toPandas(), duck.execute(engine.SQL[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert canon(have) == canon(want)


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL) - SLOW))
def test_query_runs(spark, sf, name):
    assert isinstance(engine.QUERIES[name](spark, sf).toPandas(), pd.DataFrame)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("value, n", [("[1,2],[3,4]", 2), ("[1,2]", None), ("", None), (None, None), (" [ -1.5 , .5 ] , [1e1,2] ", 2), ("[1,2],[3]", None), ("[1,2];[3,4]", None), ("[a,2],[3,4]", None)])
def test_polyline(spark, value, n):
    p = text.points(F.lit(value).cast("string"))
    assert one(spark, F.when(p.isNotNull(), F.size(p)))[0] == n


def test_projection(spark):
    # the central meridian on the equator, and a point whose place is known from the defining series
    r = one(spark, geo.project(F.lit(-81.0), F.lit(0.0)).alias("a"), geo.project(F.lit(-79.3832), F.lit(43.6532)).alias("b"))
    assert abs(r["a"]["x"] - 500000) < 1e-6 and abs(r["a"]["y"]) < 1e-6
    assert 629000 < r["b"]["x"] < 631500 and 4833000 < r["b"]["y"] < 4835500


def test_durations(spark):
    r = one(spark, *[times.humanized(F.lit(h).cast("double")) for h in (None, 0.2, 47.0, 48.0, 24 * 50.0, 24 * 700.0)])
    assert list(r) == ["duration unknown", "~1h restriction", "~47h restriction", "~2d restriction", "~2mo restriction", "~1.9yr restriction"]


INPUT = dict(restriction_id="r", valid_polyline=True, fallback_used=False, candidate_edge_count=1, direct_count=1, proximity_count=0, low_count=0, affected_edge_length_m=1.0,
             added_distance_m=10.0, detour_ratio=2.0, connectivity_lost=False, duration_hours=1.0, missing_fields=[])


@pytest.mark.parametrize("change, severity, confidence, reasons, limits", [
    ({}, "MODERATE", "HIGH", ["MODELED_DETOUR"], []),
    ({"candidate_edge_count": 0}, "NOT_EVALUATED", "INSUFFICIENT_EVIDENCE", ["NO_CANDIDATE_EDGE"], []),
    ({"connectivity_lost": True, "added_distance_m": None}, "SEVERE", "HIGH", ["CONNECTIVITY_LOSS_MODELED"], []),
    ({"detour_ratio": None}, "NOT_EVALUATED", "HIGH", ["NETWORK_IMPACT_NOT_EVALUATED"], []),
    ({"added_distance_m": 0.0, "detour_ratio": 1.0}, "LOW", "HIGH", ["NO_MODELED_DETOUR"], []),
    ({"added_distance_m": 129.181}, "HIGH", "HIGH", ["ADDED_DISTANCE_HIGH", "DETOUR_RATIO_HIGH"], []),
    ({"proximity_count": 2}, "MODERATE", "MEDIUM", ["MODELED_DETOUR"], ["MATCH_INCLUDES_PROXIMITY_CANDIDATES"]),
    ({"fallback_used": True, "valid_polyline": False, "missing_fields": ["endtime", "endtime"]}, "MODERATE", "LOW", ["MODELED_DETOUR"], ["MATCH_BASED_ON_POINT_FALLBACK", "RESTRICTION_POLYLINE_MALFORMED", "MISSING_ENDTIME"]),
])
def test_assess(spark, change, severity, confidence, reasons, limits):
    schema = "restriction_id string, valid_polyline boolean, fallback_used boolean, candidate_edge_count int, direct_count int, proximity_count int, low_count int, affected_edge_length_m double, added_distance_m double, detour_ratio double, connectivity_lost boolean, duration_hours double, missing_fields array<string>"
    r = rules.assess(spark.createDataFrame([tuple((INPUT | change).values())], schema)).first()
    assert (r["severity"], r["confidence"], r["reason_codes"], r["limitation_codes"]) == (severity, confidence, reasons, limits)


def test_blobs():
    import struct

    line = struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)
    head = b"GP" + struct.pack("<BBi", 0, 1, 4326)
    assert geopackage.decode(head + line)[0] == "LineString"
    for bad, error in ((b"XX", "header"), (head + line[:-1], "truncated"), (head + line + b"x", "trailing bytes"), (b"GP" + struct.pack("<BBi", 0, 0x11, 1) + line, "empty"), (None, "null")):
        assert geopackage.decode(bad)[2] == error


NET = [("a", 1, 2, 1.0), ("b", 2, 3, 1.0), ("c", 1, 3, 5.0), ("d", 3, 4, 1.0), ("e", 5, 6, 2.0), ("f", 4, 4, 1.0)]


def test_paths_small(spark):
    edges = spark.createDataFrame(NET, "edge_id string, u long, v long, len_m double")
    queries = spark.createDataFrame([("x", 1, 4), ("y", 1, 5), ("z", 2, 2)], "q string, src long, dst long")
    r = {x["q"]: x for x in paths.shortest_paths(edges, queries, with_path=True).collect()}
    assert r["x"]["dist"] == 3.0 and r["x"]["path"] == ["a", "b", "d"]
    assert r["y"]["dist"] is None and not r["y"]["reached"] and r["y"]["settled"]
    assert r["z"]["dist"] == 0.0 and r["z"]["path"] == []
    lost = {x["edge_id"]: x for x in paths.replacements(edges, edges.select("edge_id")).collect()}
    assert lost["a"]["replacement_m"] == 6.0 and lost["a"]["ratio"] == 6.0 and lost["d"]["lost"] and lost["e"]["lost"] and not lost["f"]["lost"]
    x = {r["query"]: r for r in paths.experiments(edges, queries.where("q = 'x'"), spark.createDataFrame([("x", "b")], "q string, edge_id string")).collect()}["x"]
    assert x["baseline_m"] <= x["penalised_m"] <= x["hard_m"] == 6.0 and not x["hard_lost"]
    nodes = spark.range(1, 8).select(F.col("id").alias("node"))
    base = paths.node_components(edges, nodes)
    assert {(r["node"], r["component"]) for r in base.collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (7, 7)}
    sets = spark.createDataFrame([("s", "a"), ("s", "c"), ("t", "d")], "s string, edge_id string")
    removed = {r["s"]: r for r in paths.edge_set_removal(edges, sets, base).collect()}
    assert removed["s"]["component_increase"] == 1 and removed["s"]["boundary_nodes"] == 3 and (removed["s"]["connected_pairs"], removed["s"]["disconnected_pairs"]) == (1, 2)
    assert removed["t"]["component_increase"] == 1
    audit = network.audit(edges, nodes, base).first()
    assert (audit["nodes"], audit["edges"], audit["components"], audit["largest"], audit["isolated"], audit["self_loops"]) == (7, 6, 3, 4, 1, 1) and audit["degrees"][3] == 2


def test_walk(spark):
    steps = spark.createDataFrame([("p", 0, 10.0, "A", 0, ""), ("p", 1, 10.0, "", 1, ""), ("p", 2, 10.0, "A", 0, "X"), ("p", 3, 10.0, "B", 0, None)], "path string, pos int, len_m double, sidewalk string, crosswalk int, px_type string")
    r = [(x["at_m"], x["kind"], x["label"]) for x in sequences.walk_events(steps).orderBy("pos", "order").collect()]
    assert r == [(0.0, "sidewalk_change", "A"), (10.0, "crosswalk", "Crosswalk"), (20.0, "signal", "Pedestrian signal (X)"), (30.0, "sidewalk_change", "B")]


def test_spread(spark):
    rows = spark.createDataFrame([("g", i % 7, f"{i:03d}") for i in range(50)], "g string, candidate_edge_count int, restriction_id string")
    ordered = sorted((i % 7, f"{i:03d}") for i in range(50))
    want = {ordered[round(k * 49 / 11)][1] for k in range(12)}
    assert {r["restriction_id"] for r in sequences.spread(rows, ["g"]).collect()} == want


def test_validation_cases(spark):
    rows = [("d1", 0, False, 1, 0, 3), ("d2", 1, False, 2, 0, 9), ("p1", 2, False, 0, 1, 1), ("m1", 3, True, 0, 0, 2), ("z", 4, False, 0, 0, 0)]
    r = sequences.validation_cases(spark.createDataFrame(rows, "restriction_id string, pos int, malformed boolean, direct int, proximity int, n_candidates int"), 5)
    assert [(x["restriction_id"], x["reason"][:6]) for x in r.orderBy("place").collect()] == [("d1", "direct"), ("d2", "dense "), ("p1", "proxim"), ("m1", "malfor"), ("z", "additi")]


def test_matching_needs_metres(spark):
    with pytest.raises(ValueError):
        spatial.require_metric("EPSG:4326")


def test_drift_of_a_new_label(spark):
    shares = spark.createDataFrame([("New", 1.0)], "label string, share double")
    assert summaries.drift(shares).first()["magnitude"] == 0.0
    assert summaries.drift(shares, full=True).first()["magnitude"] > 0.5


def test_pages(spark):
    rows = spark.createDataFrame([(f"{i:02d}", "x") for i in range(7)], "restriction_id string, state string")
    r = listing.page(rows, 5, 5, state="x").collect()
    assert [x["restriction_id"] for x in r] == ["05", "06"] and r[0]["total"] == 7 and r[0]["pages"] == 2
