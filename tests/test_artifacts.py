"""Spatial artifacts, XML roots, explanations of requests and of routes, hulls and the logistic baseline against plain versions."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators.hull import hull_buffer
from kerbline.plans import artifact, explain, model
from kerbline.queries.space import _routes
from kerbline.sources import tables

POINT, LINE, SHORT = '{"type": "Point", "coordinates": [1, 2.5]}', '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}', '{"type":"LineString","coordinates":[[1.0,2.0]]}'
MATCH = "restriction_id string, segment_id string, geometry string, signal string, confidence string, distance_m double, candidate_rank int, pos int, segment_known boolean"
RESTRICTION = "restriction_id string, geometry string, malformed boolean, evidence_confidence string, source_snapshot string"


def matches(spark, rows):
    return spark.createDataFrame(rows, MATCH)


def test_spatial_evidence(spark):
    r = spark.createDataFrame([("a", LINE, False, "HIGH", "s"), ("b", None, True, "LOW", "s"), ("c", SHORT, False, "LOW", None), ("d", LINE, False, None, "s")], RESTRICTION)
    m = matches(spark, [("a", "x", POINT, "direct_intersection", "HIGH", 0.0, None, 1, True), ("b", "x", POINT, "proximity", "MEDIUM", 3.0, 7, 1, True), ("b", "y", SHORT, "proximity", "MEDIUM", 4.0, None, 2, True),
                        ("c", "z", None, "point_fallback", "LOW", 5.0, None, 1, False), (None, "z", None, None, None, None, None, None, None)])
    f = {(x["restriction_id"], x["feature_id"]): x for x in artifact.spatial_features(m).collect()}
    assert f["a", "x"]["distance_m"] is None and f["a", "x"]["geometry"] == '{"type":"Point","coordinates":[1.0,2.5]}' and f["a", "x"]["candidate_rank"] == 1
    assert f["b", "x"]["candidate_rank"] == 7 and not f["b", "y"]["matched"] and f["b", "y"]["geometry"] is None
    e = {x["restriction_id"]: x for x in artifact.spatial_evidence(r, artifact.spatial_features(m)).collect()}
    assert {k: (x["geometry_status"], x["candidates"], x["matched"]) for k, x in e.items()} == {"a": ("AVAILABLE", 1, 1), "b": ("PARTIAL", 2, 1), "c": ("NOT_AVAILABLE", 1, 0), "d": ("AVAILABLE", 0, 0)}
    assert e["a"]["restriction_geometry"] == LINE and e["c"]["restriction_geometry"] is None
    n = artifact.integrity(r, m).first().asDict()
    assert n == {"restriction_records": 4, "candidate_features": 4, "restriction_geometries": 2, "candidate_geometries": 2, "available": 2, "partial": 1, "not_available": 1, "rejected_geometries": 2, "null_geometries": 4}
    assert set(artifact.integrity(r.limit(0), m).first()) == {0}


def test_artifact_problems(spark):
    schema = "restriction_id string, schema_version string, crs string, source_snapshot string, source_id string, provenance_crs string, status string, restriction_geometry string, features array<struct<feature_id: string, geometry: string>>"
    good = {"schema_version": "spatial-v1", "crs": "EPSG:4326", "source_snapshot": "s", "provenance_crs": "EPSG:4326", "status": "AVAILABLE", "restriction_geometry": LINE, "features": [("x", POINT), ("y", None)]}
    bad = {
        "v": ({"schema_version": None}, "unsupported schema version"), "c": ({"crs": "EPSG:1"}, "unexpected CRS"), "n": ({"source_snapshot": ""}, "no source snapshot"), "i": ({"source_id": "other"}, "identity differs"),
        "s": ({"status": None}, "unknown geometry status"), "p": ({"provenance_crs": None}, "no geometry provenance"), "g": ({"restriction_geometry": "no JSON"}, "malformed restriction geometry"),
        "l": ({"features": None}, "no feature list"), "d": ({"features": [("x", None), ("x", None)]}, "missing or duplicate feature ids"), "m": ({"features": [(None, POINT)]}, "missing or duplicate feature ids"),
        "f": ({"features": [("x", SHORT)]}, "malformed feature geometry"), "ok": ({}, None), "empty": ({"features": [], "restriction_geometry": None}, None),
    }
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [tuple(({"restriction_id": k, "source_id": k} | good | change)[n] for n in names[:8]) + ((good | change)["features"],) for k, (change, _) in bad.items()]
    found = [(x["restriction_id"], x["problem"]) for x in artifact.problems(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(found) == sorted((k, p) for k, (_, p) in bad.items() if p)


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 3), (1024, 2), (2500, 7)])
def test_artifact_hash(spark, n, parts):
    rows = [(f"{i:05d}", i % 3 if i % 5 else None, 'a "quoted" é') for i in range(n)]
    df = spark.createDataFrame(rows, "key string, b int, a string").repartition(parts)
    level = [hashlib.sha256(json.dumps({k: v for k, v in (("a", a), ("b", b), ("key", key)) if v is not None}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for key, b, a in rows]
    for _ in range(3):
        level = [hashlib.sha256("".join(level[i:i + 1024]).encode()).hexdigest() for i in range(0, len(level), 1024)]
    assert tuple(tables.artifact_hash(df, "key").first()) == (n, hashlib.sha256("".join(level).encode()).hexdigest())


def test_json_artifact_is_in_order(spark, tmp_path):
    path = str(tmp_path / "artifact")
    tables.write_json_artifact(spark.range(500).select(F.format_string("%04d", "id").alias("id"), F.lit(1).alias("a")).repartition(5), "id", path)
    text = "".join(p.read_text() for p in sorted((tmp_path / "artifact").glob("part-*")))
    assert text == "".join(f'{{"a":1,"id":"{i:04d}"}}\n' for i in range(500))


def test_xml_roots(spark, tmp_path):
    texts = {"a": '<?xml version="1.0"?>\n<!-- <Roads> -->\n<Closures>\n<Closure><Id>1</Id></Closure><Closure a="1"/>\n</Closures>', "b": "<Closures/>", "c": "<Roads><Closure/></Roads>", "d": "no tag"}
    for k, t in texts.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / "f.xml").write_text(t)
    for k, want in {"a": ("Closures", 1, 2, "ok"), "b": ("Closures", 1, 0, "no records"), "c": ("Roads", 1, 1, "unexpected root"), "d": (None, 1, 0, "unexpected root")}.items():
        assert [tuple(r) for r in tables.xml_roots(spark, str(tmp_path / k)).collect()] == [want]


def test_requests_are_answered(spark, sf):
    from kerbline.queries.judged import m6_dispatch
    from kerbline.queries.registry import view

    asked = spark.createDataFrame([("1", " ", 5, True), ("2", "nowhere", 5, True), ("3", None, None, True), ("4", "", None, False), ("5", None, None, None), ("6", None, 99, None)], "request_id string, restriction_id string, q long, overview boolean")
    records = view(spark, sf, "fx_records").withColumns({"impact_status": F.lit("EVALUATED"), "alternative_edges": F.lit(1), "loss_count": F.lit(0)})
    routes = spark.createDataFrame([(5, False, None, None, None, 0, None, None, None, None, None)], "q long, reachable boolean, avoid string, base_m double, base_edges int, barriers_on_path int, added_m double, ratio double, avoided int, recommended_m double, recommended_edges int")
    got = {x["request_id"]: x for x in explain.answered(asked, records, routes, records).collect()}
    assert [(got[i]["kind"], got[i]["error"]) for i in "123456"] == [("route", None), ("restriction", explain.NOT_FOUND), ("overview", None), (None, explain.NO_CONTEXT), (None, explain.NO_CONTEXT), ("route", None)]
    assert got["1"]["headline"] == explain.SENTENCES["unreachable_headline"] and got["6"]["headline"] is None and got["3"]["headline"].startswith(f"{records.count()} ")
    assert got["2"]["provenance"] is None and got["3"]["provenance"]["publisher"] == "Toronto Open Data" and got["1"]["bullets"] == []
    assert m6_dispatch(spark, sf).count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_routes_are_explained(spark, sf):
    routes = _routes(spark, sf).collect()
    assert routes
    told = {x["q"]: x for x in explain.route_texts(_routes(spark, sf)).collect()}
    whole = lambda v: str(math.floor(v + 0.5))
    for r in routes:
        t, say = told[r["q"]], explain.SENTENCES
        if not r["reachable"]:
            assert t["headline"] == say["unreachable_headline"] and t["bullets"] == []
            continue
        added = r["added_m"]
        case = ("longer" if added > 0 else "same") if r["avoid"] and added is not None else "no_way" if r["avoid"] and r["recommended_m"] is None else "crosses" if r["barriers_on_path"] > 0 else "clear"
        label = say["avoid_all"] if r["avoid"] == "all" else say["avoid_one"].format(id=r["avoid"])
        values = dict(avoided=r["avoided"] or 0, added=added is not None and whole(added), ratio=r["ratio"], on=r["barriers_on_path"], label=label)
        assert t["headline"] == say[f"{case}_headline"].format(**values)
        assert t["narrative"] == say["route"].format(base=whole(r["base_m"]), edges=r["base_edges"], detail=say[case].format(**values))
        assert t["bullets"][0] == say["baseline_bullet"].format(base=whole(r["base_m"]), edges=r["base_edges"])


def test_hull_holds_all_circles(spark):
    from kerbline.functions.geo import LAT_M, LON_M

    paths = {"a": [(-79.4, 43.6), (-79.39, 43.61), (-79.395, 43.62)], "b": [(-79.4, 43.6)], "c": [], "d": [(-79.4, 43.6)] * 3}
    rows = [(k, [dict(x=x, y=y) for x, y in p]) for k, p in paths.items()] + [("n", None)]
    rings = {r["id"]: [(p["x"], p["y"]) for p in r["ring"]] for r in hull_buffer(spark.createDataFrame(rows, "id string, path array<struct<x: double, y: double>>"), 50.0).collect()}
    assert rings["c"] == rings["n"] == []
    for k in "abd":
        around = [(x + 50 * math.sin(a) / (LON_M * math.cos(math.radians(y))), y + 50 * math.cos(a) / LAT_M) for x, y in paths[k] for a in (2 * math.pi * i / 16 for i in range(16))]
        ring = rings[k]
        cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        for a, b in zip(ring, ring[1:] + ring[:1]):
            assert all(cross(a, b, p) > -1e-12 for p in around)
        assert all(min(math.dist(v, p) for p in around) < 1e-12 for v in ring)
        assert len(set(ring)) == len(ring)


def test_logistic_baseline(spark):
    rng = np.random.default_rng(3)
    names = ["Low", "High", "None"]
    numeric = [c for c in model.BASE if c not in model.TEXT]
    rows = []
    for i in range(300):
        k = i % 3
        rows.append(tuple(names[k] if c == "target" else "t" + str(k) if c in model.TEXT else float(rng.normal(4 * k, 0.4)) for c in [*model.BASE, "target"]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'double' if c in numeric else 'string'}" for c in [*model.BASE, "target"]))
    fitted = model.train(df, logistic=True)
    scored = model.predict(fitted, df).collect()
    assert all(r["prediction"] == r["target"] for r in scored)
    lr = fitted.stages[-2]
    w, b, labels = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray(), fitted.stages[-1].getLabels()
    for r in scored:
        z = w @ r["features"].toArray() + b
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose([r["probabilities"][n] for n in labels], p) and abs(r["confidence"] - p.max()) < 1e-9
