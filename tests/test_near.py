"""No near pair is lost, wherever it lies; systems that aren't in metres are refused; forests' labels tell cuts."""

import math
import random

import pytest

from kerbline.operators import forest, paths, spatial


def plane(x1, y1, x2, y2):
    dx = (x2 - x1 + 180) % 360 - 180
    return math.hypot(dx * 111320 * math.cos(math.radians((y1 + y2) / 2)), (y2 - y1) * 110540)


@pytest.mark.parametrize("metres,lat,lon", [(500, 43.6, -79.4), (800, 43.6, -79.4), (200, 75.0, 10.0), (500, 0.0, 179.999), (5000, -60.0, -179.99), (20000, 89.7, 0.0), (75, 43.6, -79.4)])
def test_near_points_equal_all_pairs(spark, metres, lat, lon):
    rng = random.Random(metres + int(lat))
    spread = 3 * metres / 110540

    def points(n):
        wide = spread / max(0.01, math.cos(math.radians(lat)))
        return [(i, (lon + rng.uniform(-wide, wide) + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))) for i in range(n)] + [(n, None, lat)]

    a, b = points(120), points(120)
    found = spatial.near_points(spark.createDataFrame(a, "a long, lon double, lat double"), spark.createDataFrame(b, "b long, lon double, lat double"), "a", "b", float(metres))
    want = {(p[0], q[0]) for p in a for q in b if None not in p + q and plane(*p[1:], *q[1:]) <= metres}
    rows = [(r["a"], r["b"]) for r in found.collect()]
    assert want and len(rows) == len(set(rows)) and set(rows) == want


def test_every_point_has_a_nearest_node(spark):
    far = spark.createDataFrame([(1, 1e9, -1e9), (2, 0.0, 0.0), (3, None, 1.0)], "point long, x double, y double")
    nodes = spark.createDataFrame([(7, 1.0, 1.0), (5, -1.0, 1.0)], "node long, x double, y double")
    assert {(r["point"], r["node"]) for r in spatial.nearest(far, nodes, 0.5).collect()} == {(1, 7), (2, 5)}
    assert spatial.nearest(far, nodes.limit(0), 0.5).count() == 0


def test_only_known_systems_in_metres(spark):
    for code in (3819, 3821, 3824, 3889, 3906, 4326, 4269, 2263, 99999):
        assert not spatial.is_projected(f"EPSG:{code}")
    for code in (7850, 5070, 26917, 32617, 2952, 3857, 2154):
        assert spatial.is_projected(f"epsg:{code}")
    rows = spark.createDataFrame([("EPSG:2263",), ("EPSG:26917",), ("EPSG:3819",), ("EPSG:x",), (None,), ("EPSG:99999999999",)], "crs string")
    assert {r["crs"] for r in spatial.refused(rows).collect()} == {"EPSG:2263", "EPSG:3819", "EPSG:x", None, "EPSG:99999999999"}


def parts(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, u, v in edges:
        parent[root(u)] = root(v)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_labels_tell_cuts(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(f"e{i}", rng.randrange(n), rng.randrange(n)) for i in range(46)] + [("twin", 0, 1), ("twin2", 0, 1), ("loop", 3, 3)]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "edge_id string, u long, v long, len_m double")
    labels = {r["edge_id"]: r for r in forest.cut_labels(df).collect()}
    assert len(labels) == len(edges)
    nodes = {x for e in edges for x in e[1:]}
    whole = len(set(parts(nodes, edges).values()))
    for e in edges:
        bridge = len(set(parts(nodes, [x for x in edges if x[0] != e[0]]).values())) > whole
        assert bridge == (labels[e[0]]["tree"] and not any(labels[e[0]]["label"])), e
    # sets, larger ones with more words
    sets = [(s, e[0]) for s in range(6) for e in rng.sample(edges, rng.randint(1, 30))]
    base = paths.node_components(df)
    found = {r["s"]: r for r in paths.edge_set_removal(df, spark.createDataFrame(sets, "s long, edge_id string"), base).collect()}
    before = parts(nodes, edges)
    for s in range(6):
        gone = {e for x, e in sets if x == s}
        after = parts(nodes, [e for e in edges if e[0] not in gone])
        ends = sorted({x for e in edges if e[0] in gone for x in e[1:]})
        joined = [(a, b) for i, a in enumerate(ends) for b in ends[:i] if before[a] == before[b]]
        kept = sum(after[a] == after[b] for a, b in joined)
        r = found[s]
        assert (r["removed_edges"], r["boundary_nodes"], r["connected_pairs"], r["disconnected_pairs"]) == (len(gone), len(ends), kept, len(joined) - kept)
        assert r["component_increase"] == len(set(after.values())) - whole


def test_regions_do_not_change_ways(spark):
    rng = random.Random(9)
    n = 60
    rows = [(f"e{i}", rng.randrange(n), rng.randrange(n), round(rng.uniform(0, 9), 3)) for i in range(110)]
    e = spark.createDataFrame(rows, "edge_id string, u long, v long, len_m double")
    q = spark.createDataFrame([(i, rng.randrange(n), rng.randrange(n)) for i in range(25)], "q long, src long, dst long")
    change = spark.createDataFrame([(i, f"e{rng.randrange(110)}", rng.choice([None, 3.0])) for i in range(25) for _ in range(8)], "q long, edge_id string, factor double").dropDuplicates(["q", "edge_id"])
    places = spark.createDataFrame([(i, rng.random(), rng.random()) for i in range(n)], "node long, x double, y double")
    length = {r[0]: r for r in rows}
    factor = {(r["q"], r["edge_id"]): r["factor"] for r in change.collect()}
    seen = []
    for size, given in ((1000, None), (7, None), (7, places), (1, None)):
        found = paths.shortest_paths(e, q, change, with_path=True, places=given, region_nodes=size).collect()
        seen.append({r["q"]: r["dist"] and round(r["dist"], 6) for r in found})
        for r in found:
            if r["reached"]:  # the way leads from one end to the other and is as long as it is said to be
                at, total = r["src"], 0.0
                for name in r["path"]:
                    _, u, v, m = length[name]
                    assert at in (u, v)
                    at, total = (v if at == u else u), total + m * factor.get((r["q"], name), 1.0)
                assert at == r["dst"] and abs(total - r["dist"]) < 1e-6
    assert all(x == seen[0] for x in seen)
