"""Each stage of the pipeline on its own input."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm.common import fresh_path


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        path = fresh_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        ids = sorted(r[0] for r in docs.select("doc_id").collect())
        if name == "language_id":
            assert ids == sorted(d for d, t in rows if t and any(c.isalpha() for c in t))
        elif name == "near_duplicates":
            assert ids == brute.one_of_each_group(rows)
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in brute.contamination(rows, items) if not r[5])
        elif name == "mixing":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            plan = brute.mix([(d, t, s) for d, t, s in before], [tuple(r) for r in labels.select("doc_id", "quality").collect()])
            assert Counter(ids) == Counter({d: c for d, _, _, c in plan if c})
        else:
            from kerbline.llm.queries import tokenizer_path

            assert sorted((r["n_tokens"], r["ids_crc32"]) for r in docs.collect()) == sorted(r[2:] for r in brute.tokens(rows, tokenizer_path()))
        if name != "token_output":
            assert docs.columns == columns


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, k1 long, whole string"


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that stages use."""
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "house", "green", "river", "walks", "slowly", "over", "hill"]) + rng.choice(["", "s", "ing"])
    prose = lambda n: " ".join(word() for _ in range(n))
    a, long = prose(30), prose(60_000)
    rows = [(i, prose(40), "en", "ab"[i % 2], 1, "x", 1, 1, "w") for i in range(20)]
    rows += [(30, a, "en", None, 1, "x", 1, 1, "w"), (31, a, "en", "a", 1, "x", 1, 1, "w"), (31, a, "en", "a", 1, "x", 1, 1, "w"), (31, prose(35), "en", "b", None, None, None, None, None)]
    rows += [(None, prose(33), "en", "a", 1, "x", 1, 1, "w"), (None, prose(34), "en", "b", 1, "x", 1, 1, "w"), (None,) * 9, (40, None, "en", "a", 1, "x", 1, 1, "w"), (41, "", "en", "a", 1, "x", 1, 1, "w")]
    rows += [(42, long, "en", "c", 1, "x", 1, 1, "w"), (43, "12 !! \n\n", "en", "c", 1, "x", 1, 1, "w"), (44, "green house", None, "c", 1, "x", 1, 1, "w"), (45, "green", "en", None, 1, "x", 1, 1, "w")]
    return spark.createDataFrame(rows, AWKWARD)


@pytest.fixture
def tables(spark):
    """A folder with small tables of benchmark and labels."""
    path = fresh_path(spark, "tables")
    spark.createDataFrame([(1, "nothing of this kind stands in any of these documents at all"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_awkward_rows(spark, tables):
    docs = awkward(spark)
    key = lambda df: Counter(map(repr, df.collect()))
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, name)
        found = stage(spark, docs, tables)
        if name == "token_output":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted((r["n_tokens"], r["ids_crc32"]) for r in found.collect()) == sorted(r[2:] for r in brute.tokens(rows, corpus_pipeline.tokenizer_path()))
            break
        assert found.columns == docs.columns
        found.write.parquet(path)
        have, was = key(spark.read.parquet(path)), key(docs)
        if name == "language_id":
            lettered = F.col("text").rlike(r"\p{L}")
            assert have == key(docs.where(lettered))  # repeated rows and null ids stay
        elif name == "near_duplicates":
            ids = [r["doc_id"] for r in spark.read.parquet(path).collect()]
            assert ids.count(30) == 1 and ids.count(31) == 1 and ids.count(None) == 2 and 42 in ids
            assert not have - was
        elif name == "decontamination":
            assert have == was  # nothing is contaminated
        else:
            sizes = {repr(r): len((r["text"] or "").split()) for r in docs.collect()}
            plan = brute.mix([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [(1, 1), (2, None), (None, 0), (3, 0), (3, 1)])
            assert sum(n * sizes[r] for r, n in have.items()) == sum(n * c for _, _, n, c in plan)
            assert all(r in was for r in have)
        docs = spark.read.parquet(path)


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], AWKWARD)
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, tables)
        assert found.count() == 0
