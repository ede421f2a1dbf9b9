"""The path-template tree has no bound on a node's children or on depth, and its rounds follow the branchings."""

import random

from kerbline.llm import url_filter


def test_many_children_and_deep_branches(spark):
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    urls = [(f"http://wide.net/{'bad' if i % 2 else names[i % 60]}/{i}", i % 2) for i in range(400)]
    urls += [(f"http://deep.net/a/b/c/d/e/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(200)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, (_, b) in enumerate(urls)], "doc_id long, quality int, toxic int")
    r = {x["page_id"]: x for x in url_filter.judge_urls(pages, labels).collect()}
    assert len(r) == len(urls)
    assert all(r[i]["verdict"] == ("block" if b else "allow") for i, (_, b) in enumerate(urls))
    assert r[1]["template"] == "/bad/*" and r[401]["template"].endswith("/bad/*")


def plain_tree(rows, min_z=url_filter.MIN_Z):
    """One segment of every path at a time, to the end of the longest: {(host, path): template} of rows (host, path, labelled, bad)."""

    def apart(b1, n1, b2, n2):
        pooled, gap = (b1 + b2 + 1) / (n1 + n2 + 2), (b1 + 1) / (n1 + 2) - (b2 + 1) / (n2 + 2)
        return gap * gap > min_z * min_z * (pooled * (1 - pooled) * (1 / (n1 + 2) + 1 / (n2 + 2)))

    sums = {}
    for h, p, n, b in rows:
        s = sums.setdefault((h, p), [0, 0])
        s[0] += n
        s[1] += b
    at = {k: "" for k in sums}
    segs = {k: [s if not any(x in "0123456789" for x in s) else "*" for s in k[1].split("/") if s] for k in sums}
    for d in range(max(map(len, segs.values()), default=0)):
        nodes = {}
        for k in sums:
            if len(segs[k]) > d:
                child = nodes.setdefault((k[0], at[k]), {}).setdefault(segs[k][d], [0, 0])
                child[0] += sums[k][0]
                child[1] += sums[k][1]
        names = {}
        for node, children in nodes.items():
            n, b = (sum(x[i] for x in children.values()) for i in (0, 1))
            bins = {}
            for s, (cn, cb) in children.items():
                names[node, s] = "*"
                if s != "*" and apart(cb, cn, b - cb, n - cn):
                    bins.setdefault(int((cb + 1) / (cn + 2) * url_filter.BINS), []).append(s)
            branch, before = [], None
            for at_bin in sorted(bins):
                now = [sum(children[s][i] for s in bins[at_bin]) for i in (1, 0)]
                if before is None or apart(*now, *before):
                    branch.append([])
                branch[-1] += bins[at_bin]
                before = now
            # a branch is called by its first child
            for b_ in branch:
                for s in b_:
                    names[node, s] = min(b_) + ("#" if len(b_) > 1 else "")
        at = {k: f"{t}/{names[(k[0], t), segs[k][d]]}" if len(segs[k]) > d else t for k, t in at.items()}
    return at


def test_templates_equal_those_of_one_segment_at_a_time(spark):
    rng = random.Random(8)
    long = "/".join(["q"] * 30)
    rows = [("chain.net", f"/{long}/{end}", 1, int(end == "x")) for end in ("x", "y", "y/z", "") for _ in range(40)] + [("", "", 1, 1), ("lone.net", "/" + "/".join("abc" for _ in range(25)), 9, 9)]
    rows += [("good.net", f"/{long}/{end}", 1, 0) for end in ("x", "y", "") for _ in range(40)]
    for i in range(3000):
        host = rng.choice(["a.net", "a.net", "b.net", "c.net"])
        parts = [rng.choice("abcdef") + rng.choice(["", "", "7"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]
        bad = rng.random() < (0.9 if parts[:1] in (["a"], ["b"]) else 0.3 if parts[1:2] == ["c"] else 0.02)
        rows.append((host, "/" + "/".join(parts) + rng.choice(["", "/"]), int(rng.random() < 0.7), 0))
        rows[-1] = (*rows[-1][:3], int(bad) * rows[-1][2])
    want = plain_tree(rows)
    found = url_filter.template_tree(spark.createDataFrame(rows, "host string, path string, labelled int, bad int")).collect()
    assert len(found) == len(want) and {(r["host"], r["path"]): r["template"] for r in found} == want
    assert any("#" in t for t in want.values()) and any(t.count("/q") == 30 for t in want.values())


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(url_filter, "_merged", lambda *a, _f=url_filter._merged: rounds.append(1) or _f(*a))
    long = "/".join(["deep"] * 500)
    rows = [("one.net", f"/{long}/{i % 2}", 1, 0) for i in range(40)] + [("two.net", f"/{long}/a", 0, 0), ("two.net", f"/{long}/b", 1, 1)]
    found = {r["host"]: r["template"] for r in url_filter.template_tree(spark.createDataFrame(rows, "host string, path string, labelled int, bad int")).collect()}
    assert found == {"one.net": f"/{long}/*", "two.net": "/*" * 501} and len(rounds) <= 3
