"""Ranked lexical search: the documents with the highest scores for each query, by reading lists in the order of impact.

Documents are dealt into shards of bounded bytes. A shard's index has one list for each term (which documents hold it, how often) and one
row of its documents. Searching, each shard reads a query's lists from the highest impact down, in blocks that double, and no list out of
order (NRA): what was read of a document is the lower end of its score, and the last impact read of each other list may still come on top.
Reading goes on until it is settled which documents are the shard's best, in which order, and their scores have one value. The best of
all shards then give the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import LOWER, released, runs, slices, text_bytes
from kerbline.llm.common import ascii_lower, cut

#: Bytes of text in a shard, about; a longer text is a shard of its own.
SHARD_BYTES = 16_000_000
#: Terms of the queries that a task has at once, about: queries are dealt into blocks of so many.
BLOCK_TERMS = 50_000
#: Entries of each list that the first round reads; each further round reads twice as many.
FIRST_READ = 128
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "shard long, term string, docs array<int>, tfs array<int>, ids array<long>, ns array<long>"

_IN_TERM = np.ones(256, bool)
_IN_TERM[:128] = False
for _a, _b in ((48, 57), (65, 90), (97, 122)):
    _IN_TERM[_a : _b + 1] = True


def _shard(ids: pa.Array, texts: pa.Array) -> tuple[dict, dict]:
    """The shard's documents, by ascending id, and its lists."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    order = np.lexsort((ids.fill_null(0).to_numpy(), null))
    ids, texts = ids.take(pa.array(order)), texts.take(pa.array(order)).fill_null("")
    data, offsets = text_bytes(texts)
    data = data[offsets[0] : offsets[-1]]
    # a zero byte after each text, so that no term goes on in the next
    starts = offsets - offsets[0] + np.arange(len(offsets))
    data = LOWER[np.insert(data, (offsets - offsets[0])[1:], 0)]
    inside = _IN_TERM[data]
    begin, end = runs(inside)
    of = np.searchsorted(starts, begin, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    held = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]).dictionary_encode()
    key, tf = np.unique(held.indices.to_numpy().astype(np.int64) * len(ids) + of, return_counts=True)
    term, doc = np.divmod(key, max(1, len(ids)))
    return {"ids": ids, "ns": np.bincount(of, minlength=len(ids))}, {"term": held.dictionary, "starts": np.searchsorted(term, np.arange(len(held.dictionary) + 1)), "docs": doc, "tfs": tf}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """INDEX of the documents. A row without a term has its shard's documents: ids, ascending, null last, and how many terms each has.

    Terms are the maximal runs of letters and digits of ASCII and all characters beyond it, A-Z lower-cased; a null text has none. Each row is a
    document of its own, whatever its id. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        lists = lambda values, at, kind: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
        for batch in batches:
            texts = batch.column(1).fill_null("")
            for lo, hi in slices(np.diff(text_bytes(texts)[1]).tolist(), shard_bytes):
                head, index = _shard(batch.column(0).slice(lo, hi - lo), texts.slice(lo, hi - lo))
                one, n = np.array([0, len(head["ids"])]), len(index["term"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())),
                     pa.ListArray.from_arrays(pa.array(one.astype(np.int32)), head["ids"]), lists(head["ns"], one, pa.int64())], ["shard", "term", "docs", "tfs", "ids", "ns"])
                for at in range(0, n, 20_000):
                    at_, to = index["starts"][at], index["starts"][min(at + 20_000, n)]
                    own = index["starts"][at : at + 20_001] - at_
                    size = len(own) - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, number)), index["term"].slice(at, size).cast(pa.string()), lists(index["docs"][at_:to], own, pa.int32()), lists(index["tfs"][at_:to], own, pa.int32()),
                         pa.nulls(size, pa.list_(pa.int64())), pa.nulls(size, pa.list_(pa.int64()))], ["shard", "term", "docs", "tfs", "ids", "ns"])
                number += 1

    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return cut(typed.mapInArrow(released(run), INDEX))


def best_by_reading(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best, and those equal by smaller number first, of lists (documents, impacts above 0) by falling impact."""
    low, seen = np.zeros(n_docs, np.int64), np.zeros((n_docs, len(lists)), bool)
    width = first_read
    read = np.zeros(len(lists), np.int64)
    # what the next entry of a list may be at most
    heads = np.array([x[0] if len(x) else 0 for _, x in lists], np.int64)
    wanted = heads > 0
    while True:
        for t in np.flatnonzero(wanted).tolist():
            docs, impacts = lists[t]
            at, to = read[t], min(read[t] + width, len(docs))
            low[docs[at:to]] += impacts[at:to]
            seen[docs[at:to], t] = True
            read[t] = to
            heads[t] = impacts[to - 1] if to < len(docs) else 0
        width *= 2
        met = np.flatnonzero(low)
        order = np.lexsort((met, -low[met]))
        met = met[order]
        lower = low[met]
        upper = lower + ~seen[met] @ heads
        if not heads.any():
            break
        if len(met) < k:
            wanted = heads > 0
            continue
        least = lower[k - 1]
        if heads.sum() >= least:  # a document that was not met yet may belong to the best
            wanted = heads > 0
            continue
        # still open: what may pass or tie with the last of the best, and the best themselves until their score has one value
        open_ = (upper >= least) & (upper > lower)
        if not open_.any():
            break
        wanted = (~seen[met[open_]]).any(axis=0) & (heads > 0)
    return met[:k], low[met[:k]]


def _in_shard(lists: pa.Table, queries: pa.Table, mean: tuple[int, int], k: int) -> pa.Table:
    """Each query's best of one shard; ``lists`` are rows of INDEX, ``queries`` (qid, terms, weights)."""
    empty = {"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())}
    head = lists.filter(lists["term"].is_null())
    if not len(head) or not len(queries):
        return pa.table(empty)
    ids = head["ids"].combine_chunks().flatten()
    ns = head["ns"].combine_chunks().flatten().to_numpy()
    n, total = mean
    m = 50 + 50 * ns * n // max(1, total)
    own = lists.filter(lists["term"].is_valid())
    known = {}
    for term, docs, tfs in zip(own["term"].to_pylist(), own["docs"].combine_chunks(), own["tfs"].combine_chunks()):
        docs, tf = docs.values.to_numpy(), tfs.values.to_numpy().astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])
        order = np.argsort(-impact, kind="stable")
        known[term] = docs[order], impact[order]
    out = []
    for qid, terms, weights in zip(queries["qid"].to_pylist(), queries["terms"].to_pylist(), queries["weights"].to_pylist()):
        chosen = []
        for t, w in zip(terms, weights):
            if t in known and w > 0:
                docs, impact = known[t]
                some = impact > 0
                chosen.append((docs[some], w * impact[some]) if not some.all() else (docs, w * impact))
        if chosen:
            docs, scores = best_by_reading(chosen, len(ids), k)
            out.append(pa.table({"qid": np.full(len(docs), qid), "doc_id": ids.take(pa.array(docs)), "score": scores}))
    return pa.concat_tables(out) if out else pa.table(empty)


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents of ``index`` with the highest scores above 0, ties by ascending doc_id (null last).

    A document scores, over the item's terms, once each, w * ((1000000000 * tf) div (1000 * tf + 20 * m)); w is floor(1000 * ln((2N + 2) / (2df + 1)))
    and m is 50 + ((50 * n * N) div L). Items are told apart by id and text, so repeated rows count once; an item without terms, or null, finds nothing.
    """
    spark = index.sparkSession
    asked = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").alias("text")).distinct()
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    asked = cut(asked.select("item_id", terms.alias("terms")).where("size(terms) > 0").withColumn("qid", F.monotonically_increasing_id()))
    heads, lists = index.where("term is null"), index.where("term is not null").select("shard", "term", "docs", "tfs")
    n = heads.select(F.explode("ns").alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    every = asked.select("qid", F.explode("terms").alias("term"))
    size = every.count()
    blocks = max(1, -(-size // block_terms))
    every = every.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    lists = cut(lists.join(every.select("term").distinct(), "term", "left_semi"))
    df = lists.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * n[0] + 2.0) / (2.0 * F.col("df") + 1.0)))
    weighted = every.join(df, "term").select("qid", "block", "term", weight.alias("w"))
    weighted = weighted.groupBy("qid", "block").agg(F.collect_list(F.struct("term", "w")).alias("t"))  # the terms of one item
    weighted = cut(weighted.select("qid", "block", F.col("t.term").alias("terms"), F.col("t.w").alias("weights")))
    # each block of queries against each shard
    dealt = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = dealt.select("shard", "block").join(weighted, "block").select(F.col("shard").alias("s"), F.col("block").alias("b"), "qid", "terms", "weights")
    rows = lists.join(every.select("term", "block").distinct(), "term").select("shard", "block", "term", "docs", "tfs")
    rows = rows.unionByName(dealt.select("shard", "block", "ids", "ns"), allowMissingColumns=True)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _in_shard(left, right, (n[0], n[1]), k)
        return found.append_column("shard", pa.array(np.full(len(found), left["shard"][0].as_py() if len(left) else 0)))

    best = rows.groupBy("shard", "block").cogroup(queries.groupBy("s", "b")).applyInArrow(run, "qid long, doc_id long, score long, shard long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # first among some shards, then among all, so that no task has the best of all shards
    some = Window.partitionBy("qid", F.pmod(F.xxhash64("shard"), F.lit(64))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(asked.select("qid", "item_id"), "qid").select("item_id", "rank", "doc_id", "score")
