"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from kerbline.llm import similar_sets


def kept(rows, k=5, similarity=0.8):
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [d for d in ids if root(d) == d]


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.random()}"
    return words


def test_stage_equals_all_pairs_on_the_given_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).select("doc_id").collect()) == kept(rows)


def test_edited_copies_and_split_keys(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "a b", "A  b", "a b c"]
    for group in range(12):
        base = [f"w{group}-{i}" for i in range(120)]
        texts += [" ".join(edited(rng, base, n)) for n in (0, 1, 1, 2, 2, 3, 4)]
    chain = [f"c{i}" for i in range(150)]
    for _ in range(60):  # each is near the one before; the ends are far apart
        texts.append(" ".join(chain))
        chain = edited(rng, chain, 1)
    texts += [" ".join(edited(rng, [f"h{i}" for i in range(100)], 1)) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for part in (similar_sets.PART, 700):
        assert sorted(r["doc_id"] for r in similar_sets.one_of_each_group(df, part=part).collect()) == kept(rows)
