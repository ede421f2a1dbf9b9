"""Paths, edge sets, routes, the cohort run, streams and the model against plain versions."""

import heapq
import random
import statistics
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from kerbline.operators import network, paths, sequences, spatial, summaries
from kerbline.plans import model, ranks
from kerbline.plans.checkpoint import cut, fresh_path
from kerbline.plans.replacement_run import cohort_run
from kerbline.queries.registry import view
from kerbline.streaming import feeds

EDGES = "edge_id string, u long, v long, len_m double"


def dijkstra(edges, src, dst, factors=None):
    """(distance, edge ids) or (None, None)."""
    near = defaultdict(list)
    for e, u, v, n in edges:
        f = (factors or {}).get(e, 1.0)
        if f is not None:
            near[u].append((v, n * f, e))
            near[v].append((u, n * f, e))
    todo, seen = [(0.0, src, [])], set()
    while todo:
        d, x, path = heapq.heappop(todo)
        if x == dst:
            return d, path
        if x in seen:
            continue
        seen.add(x)
        for y, n, e in near[x]:
            if y not in seen:
                heapq.heappush(todo, (d + n, y, path + [e]))
    return None, None


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, u, v, _ in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def lattice(seed, width=7, lost=0.35):
    r = random.Random(seed)
    rows = []
    for i in range(width * width):
        for j in (i + 1, i + width):
            if j < width * width and (j != i + 1 or j % width) and r.random() > lost:
                rows.append((f"S-{i}-{j}", i, j, 1.0 + r.randrange(1000) / 64))
    return rows, list(range(width * width))


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    rows, nodes = lattice(seed)
    r = random.Random(seed)
    queries = [(i, r.choice(nodes), r.choice(nodes)) for i in range(25)]
    factors = [(i, r.choice(rows)[0], r.choice([None, 3.0])) for i in range(25)]
    q, e = spark.createDataFrame(queries, "q long, src long, dst long"), spark.createDataFrame(rows, EDGES)
    found = {x["q"]: x for x in paths.shortest_paths(e, q, spark.createDataFrame(factors, "q long, edge_id string, factor double"), with_path=True).collect()}
    length = {x[0]: x[3] for x in rows}
    for i, a, b in queries:
        own = {factors[i][1]: factors[i][2]}
        want, _ = dijkstra(rows, a, b, own)
        assert (found[i]["dist"] is None) == (want is None)
        if want is not None:
            assert found[i]["dist"] == pytest.approx(want)
            assert sum(length[x] * own.get(x, 1.0) for x in found[i]["path"]) == pytest.approx(want)


def test_path_geometry(spark):
    rows, nodes = lattice(3)
    at = {n: (float(n % 7), float(n // 7)) for n in nodes}
    coords = spark.createDataFrame([(e, u, v, [at[u], (at[u][0] / 2 + at[v][0] / 2, at[u][1] / 2 + at[v][1] / 2), at[v]]) for e, u, v, _ in rows], "edge_id string, u long, v long, coords array<struct<x: double, y: double>>")
    q = spark.createDataFrame([(i, i, 48 - i) for i in range(8)], "q long, src long, dst long")
    found = cut(paths.shortest_paths(spark.createDataFrame(rows, EDGES), q, with_path=True).where("reached"))
    shapes = {x["q"]: [tuple(p) for p in x["coords"]] for x in paths.path_geometry(found, coords).collect()}
    for x in found.where("size(path) > 0").collect():
        line = shapes[x["q"]]
        assert line[0] == at[x["src"]] and line[-1] == at[x["dst"]] and len(line) == 2 * len(x["path"]) + 1
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 0.5 for a, b in zip(line, line[1:]))


def test_edge_sets(spark):
    rows, nodes = lattice(4)
    r = random.Random(4)
    sets = [(s, e[0]) for s in range(6) for e in r.sample(rows, r.choice([1, 2, 8]))]
    e = spark.createDataFrame(rows, EDGES)
    base = cut(paths.node_components(e, spark.createDataFrame([(n,) for n in nodes], "node long")))
    found = {x["s"]: x for x in paths.edge_set_removal(e, spark.createDataFrame(sets, "s long, edge_id string"), base).collect()}
    before = components(nodes, rows)
    for s in range(6):
        gone = {e for i, e in sets if i == s}
        after = components(nodes, [x for x in rows if x[0] not in gone])
        ends = sorted({n for x in rows if x[0] in gone for n in x[1:3]})
        pairs = [(a, b) for a in ends for b in ends if a < b and before[a] == before[b]]
        joined = sum(after[a] == after[b] for a, b in pairs)
        x = found[s]
        assert (x["removed_edges"], x["boundary_nodes"], x["connected_pairs"], x["disconnected_pairs"]) == (len(gone), len(ends), joined, len(pairs) - joined)
        assert x["component_increase"] == len(set(after.values())) - len(set(before.values()))


def test_routes(spark):
    rows, nodes = lattice(5)
    r = random.Random(5)
    barriers = [("R-1", x[0]) for x in r.sample(rows, 6)] + [("R-2", x[0]) for x in r.sample(rows, 3)]
    queries = [(i, r.choice(nodes), r.choice(nodes), [None, "all", "R-1"][i % 3]) for i in range(18)]
    e = spark.createDataFrame(rows, EDGES)
    base = cut(paths.node_components(e, spark.createDataFrame([(n,) for n in nodes], "node long")))
    found = {x["q"]: x for x in paths.routes(e, spark.createDataFrame(queries, "q long, src long, dst long, avoid string"), spark.createDataFrame(barriers, "restriction_id string, edge_id string"), base).collect()}
    for q, a, b, avoid in queries:
        x = found[q]
        d, _ = dijkstra(rows, a, b)
        assert x["reachable"] == (d is not None)
        if d is None:
            assert x["base_m"] is None
            continue
        assert x["base_m"] == pytest.approx(d, abs=0.0501)
        gone = {e: None for n, e in barriers if avoid == "all" or n == avoid}
        d2, _ = dijkstra(rows, a, b, gone) if avoid else (None, None)
        assert (x["recommended_m"] is None) == (d2 is None)
        if d2 is not None and a != b:
            assert x["recommended_m"] == pytest.approx(d2, abs=0.0501) and x["added_m"] == pytest.approx(d2 - d, abs=0.11) and x["ratio"] == pytest.approx(d2 / d, rel=0.02)


def test_cohort_run(spark, sf):
    part = lambda name: view(spark, sf, name)
    from kerbline.queries import space

    sites, places = cut(space._sites(spark, sf)), part("fx_places").select("restriction_id", "malformed", "lon", "lat")
    found = {(x["restriction_id"], x["scenario"]): x for x in cohort_run(sites, places, space._segments(spark, sf), space._edges(spark, sf), space._nodes(spark, sf)).collect()}
    rows = [tuple(x) for x in space._edges(spark, sf).collect()]
    by_id = {x[0]: x for x in rows}
    candidates = spatial.match_candidates(sites, space._segments(spark, sf), (5.0,)).collect()
    ways = {}
    for (restriction, scenario), x in found.items():
        allowed = ("HIGH",) if scenario == "HIGH_ONLY" else ("HIGH", "MEDIUM")
        mine = [y["segment_id"] for y in candidates if y["restriction_id"] == restriction and y["confidence"] in allowed]
        assert x["candidate_edge_count"] == len(mine)
        for e in mine:
            if e not in ways:
                ways[e] = dijkstra(rows, by_id[e][1], by_id[e][2], {e: None})[0]
        known = [ways[e] / by_id[e][3] for e in mine if ways[e] is not None]
        assert (x["alternative_path_edge_count"], x["loss_count"]) == (len(known), len(mine) - len(known))
        assert x["median_ratio"] == (pytest.approx(statistics.median(known)) if known else None)
        assert x["affected_edge_length_m"] == pytest.approx(sum(by_id[e][3] for e in mine))
        assert x["set_evaluation_state"] == ("INSUFFICIENT_EVIDENCE" if not mine else "EVALUATED" if len(mine) <= 2 else "NOT_EVALUATED")
        if x["set_evaluation_state"] == "EVALUATED":
            nodes = sorted({n for e in mine for n in by_id[e][1:3]})
            cutoff = components({n for y in rows for n in y[1:3]}, [y for y in rows if y[0] not in mine])
            whole = components({n for y in rows for n in y[1:3]}, rows)
            assert x["component_increase"] == len({cutoff[n] for n in nodes}) - len({whole[n] for n in nodes})


def test_audit_over_tolerances(spark):
    r = random.Random(8)
    places = [(60.0 * (i % 4), 60.0 * (i // 4)) for i in range(12)]
    lines = []
    for i in range(30):
        a, b = r.sample(places, 2)
        move = lambda p: (p[0] + r.choice([0, 0.005, 0.05, 0.5]), p[1])
        lines.append((f"s{i}", i, [move(a), move(b)]))
    parts = spark.createDataFrame(lines, "segment_id string, pos long, path array<struct<x: double, y: double>>").withColumn("part", F.lit(0))
    for tolerance in (0.0, 0.01, 0.1, 1.0):
        e, n = (cut(x) for x in network.build_graph(parts, tolerance))
        row = network.audit(e, n, cut(paths.node_components(e, n))).first()
        points = [p for _, _, path in lines for p in path]
        links = [("", i, j, 0.0) for i in range(len(points)) for j in range(i) if (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2 <= tolerance**2 + 1e-12]
        label = components(range(len(points)), links)
        graph = [("", label[2 * i], label[2 * i + 1], 0.0) for i in range(len(lines))]
        whole = components(set(label.values()), graph)
        assert (row["nodes"], row["edges"], row["components"]) == (len(set(label.values())), len(lines), len(set(whole.values())))


def test_numbering(spark):
    rows = [(i * 7919 % 500, i % 3) for i in range(500)]
    r = random.Random(1)
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b int").repartition(7)
    found = [tuple(x) for x in ranks.numbered(df, [F.col("b"), F.desc("a")]).collect()]
    assert {x[:2]: x[2] for x in found} == {x: i + 1 for i, x in enumerate(sorted(rows, key=lambda x: (x[1], -x[0])))}


def flags(times, limit, window):
    passed, out = deque(), []
    for at in sorted(times):
        while passed and passed[0] <= at - window:
            passed.popleft()
        ok = len(passed) < limit
        out.append((at, ok, 0.0 if ok else passed[0] + window - at))
        if ok:
            passed.append(at)
    return out


def test_bursts(spark):
    r = random.Random(9)
    # one key has most events, in bursts that go over many ranges
    rows = [(1, r.randrange(4000)) for _ in range(3000)] + [(k, r.randrange(90_000)) for k in range(2, 40) for _ in range(20)] + [(None, 5), (3, None)]
    events = spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("ts")).repartition(5)
    path = fresh_path(spark, "events")
    events.repartition(1).write.parquet(f"{path}/events.parquet")
    want = sorted((k, *x) for k in {k for k, s in rows if k is not None} for x in flags([float(s) for i, s in rows if i == k and s is not None], 5, 60.0))
    for found in (feeds.burst_flags(events, "k", "ts", 5, 60.0), feeds.run_to_table(feeds.burst_stream(feeds.read_stream(spark, path, "events"), "k", "ts", 5, 60.0), "bursts").drop("_batch")):
        have = sorted(tuple(x) for x in found.select("key", "at", "accepted", "retry_after_s").collect())
        assert [x[:3] for x in have] == [x[:3] for x in want]
        assert all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(have, want))


def test_jobs_go_on_after_a_restart(spark):
    path, place = fresh_path(spark, "source"), fresh_path(spark, "job")
    rows = lambda a, b: spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}", f"sha{i % 4}", i % 2) for i in range(a, b)], "event_id long, ts string, sha256 string, source long").coalesce(1)
    rows(0, 6).write.parquet(f"{path}/log.parquet")
    run = lambda f, name: sorted(tuple(x) for x in f(feeds.read_stream(spark, path, "log"), place=f"{place}/{name}").collect())
    jobs = {"table": lambda s, place: feeds.run_to_table(s.select("event_id"), "t", place=place).select("event_id"), "buffer": lambda s, place: feeds.recent_buffer(s, 4, place).select("event_id"),
            "manifest": lambda s, place: feeds.ingest_snapshots(s.select("source", "sha256"), place=place), "status": lambda s, place: feeds.batch_status(s, place).select("rows")}
    first = {n: run(f, n) for n, f in jobs.items()}
    assert first["table"] == [(i,) for i in range(6)] and first["buffer"] == [(2,), (3,), (4,), (5,)] and len(first["manifest"]) == 4 and first["status"] == [(6,)]
    assert {n: run(f, n) for n, f in jobs.items()} == first  # nothing new
    rows(6, 9).write.mode("append").parquet(f"{path}/log.parquet")
    second = {n: run(f, n) for n, f in jobs.items()}
    assert second["table"] == [(i,) for i in range(9)] and second["buffer"] == [(5,), (6,), (7,), (8,)] and len(second["manifest"]) == 4 and second["status"] == [(3,), (6,)]


def test_model(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        kind, road = r.choice(["A", "B", "C"]), r.choice(["Major", "Minor"])
        days = r.random() * 100
        target = "High" if kind == "A" and days > 50 else "Low" if road == "Minor" else "None"
        rows.append((str(i), kind, road, "x", "Daily", "D", 43.0 + r.random(), -79.0 - r.random(), days, r.random(), target))
    df = spark.createDataFrame(rows, "restriction_id string, type string, road_class string, directions_affected string, work_period string, district string, lat double, lon double, duration_days double, centre_km double, target string")
    train, test = df.where("restriction_id % 3 <> 0"), df.where("restriction_id % 3 = 0")
    fitted = model.train(train, trees=15)
    path = fresh_path(spark, "model")
    model.save(fitted, path, {"source": "made up"})
    loaded, metadata = model.load(spark, path)
    assert metadata["feature_cols"] == list(model.BASE) and metadata["provenance"] == {"source": "made up"} and metadata["labels"] == ["High", "Low", "None"]
    scored = model.predict(loaded, test).collect()
    assert sum(x["prediction"] == x["target"] for x in scored) / len(scored) > 0.95
    for x in scored:
        assert sum(x["probabilities"].values()) == pytest.approx(1) and x["probabilities"][x["prediction"]] == x["confidence"] == max(x["probabilities"].values())
    first = [x["feature"] for x in model.importances(fitted).orderBy("place").collect()]
    assert set(first[:3]) == {"type", "road_class", "duration_days"}
    runs = model.report({"few": (model.train(train, trees=1, depth=1), test), "many": (fitted, test)}).collect()
    assert [x["run"] for x in runs if x["best"]] == ["many"]
    unseen = model.predict(fitted, test.limit(1).withColumn("type", F.lit("new")))
    assert unseen.count() == 1


def test_match_pipeline(spark, sf):
    """The registered query's cases and counts against the candidates themselves."""
    from kerbline.queries import files, space

    got = files.m12(spark, sf).collect()
    candidates = spatial.match_candidates(cut(space._sites(spark, sf)), space._segments(spark, sf)).collect()
    mine = defaultdict(list)
    for x in candidates:
        if x["threshold_m"] in (None, 5.0):
            mine[x["restriction_id"]].append(x["signal"])
    assert len(got) == 10 and len({x["restriction_id"] for x in got}) == 10
    for x in got:
        own = mine[x["restriction_id"]]
        assert (x["candidate_count"], x["direct_count"], x["proximity_count"], x["fallback_count"]) == (len(own), *(own.count(s) for s in ("direct_intersection", "proximity", "point_fallback")))
    assert got[0]["candidates"] == sum(len(v) for v in mine.values()) and got[0]["with_candidate"] == sum(map(bool, mine.values()))


def test_crs_guard():
    assert all(spatial.is_projected(x) for x in ("EPSG:26917", "epsg:2952", "EPSG:3857", "EPSG:32617"))
    for crs in ("EPSG:4326", "EPSG:4269", "EPSG:4617", "EPSG:4979", "", "WGS 84", "EPSG:x"):
        with pytest.raises(ValueError):
            spatial.require_metric(crs)


def test_reports_of_one_class(spark):
    r = {x["label"]: x for x in summaries.classification_report(spark.createDataFrame([("a", "a")], "truth string, predicted string")).collect()}
    assert r["macro"]["f1"] == 1.0
    assert sequences.VALIDATION_RULES[0].startswith("direct")
