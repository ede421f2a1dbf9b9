"""The near-duplicate stage's candidates: SimHash words that share a codeword of the Golay code."""

import random

import numpy as np

from kerbline.llm import similar_sets, simhash


def codes(word):
    """The codewords nearest to a word and to each of its neighbours, by the whole list of codewords."""
    basis = [simhash.GENERATOR << i for i in range(12)]
    every = np.zeros(1, np.int64)
    for b in basis:
        every = np.concatenate([every, every ^ b])
    near = [word, *(word ^ 1 << i for i in range(23))]
    return {int(every[np.bitwise_count(every ^ w).argmin()]) for w in near}


def test_shared_codewords_equal_brute_force():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 23, 300)
    y = x.copy()
    for i in range(300):
        for bit in rng.permutation(23)[: i % 11]:
            y[i] ^= 1 << int(bit)
    expected = [bool(codes(int(a)) & codes(int(b))) for a, b in zip(x, y)]
    assert simhash.share_codeword(x, y).tolist() == expected
    assert all(e for e, a, b in zip(expected, x, y) if int(a ^ b).bit_count() <= 2)


def shared(one, other):
    """Tables in which two sets share their minima and a codeword, and the bits that differ."""
    a, b = (simhash.fingerprint_words(s, similar_sets.TABLES) for s in (one, other))
    same = similar_sets.minima(one) == similar_sets.minima(other)
    return same & simhash.share_codeword(a, b), int(np.bitwise_count(a ^ b).sum()) / (23 * similar_sets.TABLES)


def test_similar_sets_share_a_key_as_often_as_computed():
    rng = np.random.default_rng(2)
    for both, own, rate, bits in ((80, (10, 10), 0.309, 0.152), (4, (1, 0), 0.239, 0.188)):
        hits, differ = [], []
        for _ in range(400):
            every = rng.integers(0, 1 << 63, both + sum(own), np.uint64)
            one, other = every[: both + own[0]], np.concatenate([every[:both], every[both + own[0] :]])
            hit, d = shared(np.sort(one), np.sort(other))
            assert hit.any()
            hits.append(hit.mean())
            differ.append(d)
        assert abs(np.mean(hits) - rate) < 0.02 and abs(np.mean(differ) - bits) < 0.01


def test_meetings_are_shared_minima_with_a_shared_codeword(spark):
    rng = random.Random(3)
    rows, node = [], 0
    for least in range(40):
        base = rng.getrandbits(23)
        for _ in range(rng.choice([1, 2, 5, 30])):  # few and many nodes
            word = base
            for bit in rng.sample(range(23), rng.randrange(8)):
                word ^= 1 << bit
            rows.append((least, least % similar_sets.TABLES, word, node, rng.choice([100, 90, 60])))
            node += 1
    tabled = spark.createDataFrame(rows, "minima long, at int, word int, node long, n long")
    expected = set()
    for i, (m, _, w, u, n) in enumerate(rows):
        for m2, _, w2, v, n2 in rows[i + 1 :]:
            if m == m2 and min(n, n2) >= 0.8 * max(n, n2) and codes(w) & codes(w2):
                expected.add((u, v))
    for batch in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = similar_sets._meetings(tabled.coalesce(1).sortWithinPartitions("minima"), 0.8).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs = {(r["u"], r["v"]) for r in found if r["kind"] == 0}
        by_key = {}
        for r in found:
            if r["kind"] == 1:
                by_key.setdefault(r["key"], []).append((r["u"], r["n"]))
        assert all(k & 63 == rows[group[0][0]][1] for k, group in by_key.items())
        pairs |= {(u, v) for g in by_key.values() for u, n in g for v, n2 in g if u < v and min(n, n2) >= 0.8 * max(n, n2)}
        assert pairs == expected


def test_meetings_kept_together_lose_no_pair_and_repeat_no_node(spark):
    rng = random.Random(4)
    rows, node = [], 0
    for least in range(30):
        bases = [rng.getrandbits(23) for _ in range(3)]
        for _ in range(rng.choice([1, 5, 12, 60])):  # some codewords lead from one base to another
            word = rng.choice(bases)
            for bit in rng.sample(range(23), rng.randrange(6)):
                word ^= 1 << bit
            rows.append((least, least % similar_sets.TABLES, word, node, rng.choice([100, 90, 60])))
            node += 1
    tabled = spark.createDataFrame(rows, "minima long, at int, word int, node long, n long").coalesce(1).sortWithinPartitions("minima")
    near = {(u, v) for u in range(node) for v in range(u + 1, node) if rows[u][0] == rows[v][0] and codes(rows[u][2]) & codes(rows[v][2])}
    fit = {(u, v) for u, v in near if min(rows[u][4], rows[v][4]) >= 0.8 * max(rows[u][4], rows[v][4])}
    for whole, batch in ((10**6, "10000"), (10**6, "7"), (3000, "7")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = similar_sets._meetings(tabled, 0.8, whole).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        pairs = {(r["u"], r["v"]) for r in found if r["kind"] == 0}
        by_key = {}
        for r in found:
            if r["kind"] == 1:
                by_key.setdefault(r["key"], {})[r["u"]] = r["word"]
                assert r["word"] == rows[r["u"]][2] or whole == 3000 and r["word"] == 0
        if whole == 10**6:
            assert sum(r["kind"] for r in found) == len({r["u"] for r in found if r["kind"]})
        for group in by_key.values():
            pairs |= {(u, v) for u in group for v in group if u < v and codes(group[u]) & codes(group[v]) and (u, v) in fit | near}
        assert fit <= pairs <= near


def test_a_group_of_near_copies_goes_to_tasks_once_for_a_table(spark, monkeypatch):
    sent, in_tasks = [], similar_sets._in_tasks

    def counted(rows, by, similarity):
        sent.append(rows.count())
        return in_tasks(rows, by, similarity)

    monkeypatch.setattr(similar_sets, "_in_tasks", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r["doc_id"] for r in similar_sets.one_of_each_group(docs).collect()] == [0]
    assert 0 < sent[0] <= 120 * similar_sets.FIRST
