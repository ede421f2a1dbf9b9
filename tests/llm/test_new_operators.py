"""MinHash near-dedup, ranked search and cross-tokenizer alignment against plain versions and on awkward tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import alignment, minhash, queries, ranked_search, token_output
from test_corpus import docs, got, none, odd, plain  # noqa: F401


def test_minhash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(queries.op11_minhash(spark, "/root/testdata/sf0.01")) == sorted(brute.minhash(rows), key=repr)


@pytest.mark.parametrize("part", [minhash.PART, 900])
def test_minhash_of_edited_copies(spark, part):
    rng = random.Random(2)

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"x{rng.random()}"
        return words

    texts = [None, "", " \t", "a b", "A  b", "a b c", "a b", "a"]
    for group in range(10):
        base = [f"w{group}-{i}" for i in range(110)]
        texts += [" ".join(edited(base, n)) for n in (0, 1, 1, 2, 2, 3)]
    chain = [f"c{i}" for i in range(130)]
    for _ in range(40):  # each is near the one before; the ends are far apart
        texts.append(" ".join(chain))
        chain = edited(chain, 1)
    texts += [" ".join(edited([f"h{i}" for i in range(90)], 1)) for _ in range(50)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df, part=part)) == sorted(brute.minhash(rows), key=repr)


def test_minhash_takes_a_root_of_the_hashes():
    assert len(minhash._FACTORS) == 2 * minhash.COLLECTION * minhash.ROWS == 84
    x = np.arange(1, 200, dtype=np.uint64)
    assert len(minhash.half_keys(x)) == 28 and len(set(minhash.half_keys(x).tolist())) == 28
    assert 2 * (1 - minhash.SIMILARITY**minhash.ROWS) ** minhash.COLLECTION < 4e-6


def test_search(spark, sf, plain):  # noqa: F811
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op12_ranked_search(spark, sf)) == sorted(brute.search(plain, items), key=repr)


@pytest.mark.parametrize("shard_bytes,block_terms", [(300, 4), (10**6, 10**6)])
def test_search_in_shards_and_blocks(spark, shard_bytes, block_terms):
    rng = random.Random(4)
    words = ["the", "The", "of", "a1", "é", "zé", "漢字", "x", "<y>", "don't", "q-r", "\0n", "l\nm"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 30)))) for i in range(300)] + [(5, "the x"), (7, None), (8, "")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(12)] + [(3, "the x"), (3, "the x"), (20, None), (21, "!!"), (22, "unseen")]
    index = ranked_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=shard_bytes)
    for k in (1, 7, 400):
        found = ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k, block_terms=block_terms)
        assert got(found) == sorted(brute.search(rows, items, k), key=repr)


def test_reading_stops_before_the_end_and_is_right():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 6))):
            d = rng.permutation(n)[: int(rng.integers(0, n + 1))]
            s = np.sort(rng.integers(1, 20, len(d)))[::-1].astype(np.int64) ** 3
            lists.append((d, s))
            total[d] += s
        want = sorted(((-int(s), i) for i, s in enumerate(total) if s))[:k]
        docs, scores = ranked_search.best_by_reading(lists, n, k, first_read=4)
        assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == want

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Counted.read += at.stop - at.start
            return np.asarray(self)[at]

    d = np.arange(100_000).view(Counted)
    ranked_search.best_by_reading([(d, np.arange(100_000, 0, -1))], 100_000, 5, first_read=16)
    assert Counted.read < 100


def test_cross_tokens(spark, sf, plain):  # noqa: F811
    assert got(queries.op13_cross_tokens(spark, sf)) == sorted(brute.cross_tokens(plain, queries.tokenizer_path(), queries.piece_model_path()), key=repr)


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 60])
def test_cross_tokens_of_odd_texts(spark, block_bytes, monkeypatch):
    rng = random.Random(7)
    alphabet = list("  \n\t''.,!-abzAZ019éß×÷—½漢\xa0\r\x0b▁<|>") + ["'s", " the", "   ", "<|endoftext|>", "</s>", "<0x41>", "ﬁ", "é", "\0"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))) for i in range(700)] + [(3, None), (None, " x"), (None, " x"), (5, " "), (6, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash"))
    if block_bytes < 100:
        monkeypatch.setattr(token_output, "BATCH_BYTES", 40)
    found = alignment.cross_align(df, queries.tokenizer_path(), queries.piece_model_path(), block_bytes=block_bytes, keep_groups=True)
    columns = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    assert got(found.select(*columns)) == sorted(brute.cross_tokens(rows, queries.tokenizer_path(), queries.piece_model_path()), key=repr)
    assert found.where("groups_sha256 <> '' and sha2(groups, 256) <> groups_sha256").count() == 0


def test_galloping_finds_what_a_search_finds():
    rng = np.random.default_rng(1)
    for _ in range(100):
        long = np.sort(rng.choice(5000, int(rng.integers(1, 900)), replace=False))
        wanted = np.sort(rng.integers(0, long[-1] + 1, int(rng.integers(1, 50))))
        at = np.zeros(len(wanted), np.int64)
        assert (alignment.gallop(long, wanted, at, at + len(long) - 1) == np.searchsorted(long, wanted)).all()


def test_odd_tables(spark, odd, none, sf):  # noqa: F811
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    named = [(d, t) for d, t in rows if d is not None]
    found = got(minhash.near_duplicates(odd))
    assert len(found) == len(rows) and {r for r in found if r[0] is not None} == {r for r in brute.minhash(named)}
    assert (None, 0, None, True) in found and (None, 4, 1, False) in found
    items = spark.createDataFrame([(1, "four ALPHA1"), (None, "漢字　x"), (2, None), (3, "")], "item_id long, text string").withColumn("rank", F.lit("clash"))
    index = ranked_search.build_index(odd)
    assert got(ranked_search.search(index, items)) == sorted(brute.search(rows, [(1, "four ALPHA1"), (None, "漢字　x"), (2, None), (3, "")]), key=repr)
    paths = queries.tokenizer_path(), queries.piece_model_path()
    assert len(got(alignment.cross_align(odd, *paths))) == len(rows)
    for empty in (minhash.near_duplicates(none), ranked_search.search(ranked_search.build_index(none), items), ranked_search.search(index, items.limit(0)), alignment.cross_align(none, *paths)):
        assert empty.count() == 0


def test_special_tokens_are_a_choice():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a <|endoftext", "b  c"]
    assert [x.tolist() for x in token_output.PieceEncoder(queries.tokenizer_path(), False).encode_many(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    plain.encode_special_tokens = True
    assert [x.tolist() for x in token_output.PieceEncoder(queries.tokenizer_path()).encode_many(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
