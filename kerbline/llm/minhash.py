"""Near duplicates by MinHash, with tables that share their hashes (tensored banding).

Two collections of COLLECTION hashes each are computed; a hash is made of ROWS minima. Each pair of one hash of either collection is the key of
a table, so COLLECTION ** 2 tables of keys of 2 * ROWS minima cost 2 * COLLECTION * ROWS minima: 84 for 196 tables, that would cost 1,176 if each
had its own. A pair of similarity s shares no key with a probability of up to 2 * (1 - s ** ROWS) ** COLLECTION: 3.3 in a million at 0.85.
Every candidate is compared by its whole set before it links.

A key can only be shared if both its halves are, so hashes that no other set has are left out before keys are formed. FIRST tables with equal
numbers in both collections are compared first; of all others, only keys whose sets are not one component yet. Sets that are nearly equal
share most keys, so few tables join them, and a group of copies isn't sent once for each table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.byte_runs import released
from kerbline.llm.common import cut
from kerbline.llm.similar_sets import PART, linked_components, sets_of_texts, shingle_set
from kerbline.operators.components import components

SHINGLE, SIMILARITY = 3, 0.85
COLLECTION, ROWS = 14, 3
#: Tables that are compared before the others.
FIRST = 4
SEED = 42
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, (2 * COLLECTION * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, (2 * COLLECTION * ROWS, 1), np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """The hashes of both collections, one collection after the other; none for an empty set, which is like no other."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048] * _FACTORS + _OFFSETS
        x ^= x >> np.uint64(29)
        x *= _MIX
        least = np.minimum(least, x.min(axis=1))
    minima = least.reshape(2 * COLLECTION, ROWS)
    key = np.arange(1, 2 * COLLECTION + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ minima[:, i]) * _MIX
        key ^= key >> np.uint64(32)
    return key


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, t1, t2, h1, h2, n, halves) of docs (doc_id, t1, t2, text): two hashes of the set, its size and its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(3)]
            h1, h2 = (pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), k) for s in sets], np.uint64).view(np.int64)) for k in (1, 2))
            halves = pa.array([half_keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], h1, h2, pa.array([len(s) for s in sets], pa.int64()), halves], ["doc_id", "t1", "t2", "h1", "h2", "n", "halves"])

    return docs.mapInArrow(released(run), "doc_id long, t1 long, t2 long, h1 long, h2 long, n long, halves array<long>")


def _tables(nodes: DataFrame) -> DataFrame:
    """(node, n, first, second) of nodes that share a hash of either collection with another: those hashes, with their numbers."""
    half = nodes.select("node", "n", F.posexplode("halves").alias("at", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    live = half.join(shared, "half", "left_semi").groupBy("node", "n").agg(F.collect_list(F.struct("at", "half")).alias("h"))  # 28 at most
    return live.select("node", "n", F.expr(f"filter(h, x -> x.at < {COLLECTION})").alias("first"), F.expr(f"filter(h, x -> x.at >= {COLLECTION})").alias("second")).where("size(first) > 0 and size(second) > 0")


def _keys(tables: DataFrame, first: bool) -> DataFrame:
    """(key, node, n, label) of the FIRST tables whose numbers are equal, or of all others."""
    pair = f"{'' if first else 'not '}(f.at < {FIRST} and f.at = s.at - {COLLECTION})"
    both = tables.select("node", "n", "label", "second", F.explode("first").alias("f")).select("node", "n", "label", "f", F.explode("second").alias("s")).where(pair)
    return both.select(F.xxhash64("f.half", "s.half").alias("key"), "node", "n", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links reach, its own included), kept (it is that one).

    Rows link if the sets of their shingles have a Jaccard similarity of ``similarity`` or more. A text of fewer words is one shingle; one without
    words, or null, has no shingle, links with nothing and stays. Null ids don't count for a component; their rows aren't kept unless they have
    no shingle. Rows that repeat an id are documents of their own. Other columns are not read.
    """
    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    keyed = typed.select("doc_id", F.xxhash64(F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text").alias("t2"), "text")
    sketches = cut(_sketches(keyed, shingle))
    # texts with one set are one node
    nodes = sketches.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("halves").alias("halves"), F.min(F.struct("t1", "t2")).alias("of"), F.min("doc_id").alias("smallest"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    def sets_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, F.col("node") == F.col("w"), "left_semi").select("node", "of.t1", "of.t2")
        return sets_of_texts(keyed.join(rows, ["t1", "t2"]).groupBy("node").agg(F.first("text").alias("text")), shingle)

    tables = cut(_tables(nodes))
    links, known = linked_components(_keys(tables.withColumn("label", F.lit(0)), True).select("key", "node", "n"), sets_of, similarity, part)
    known = cut(known).withColumnRenamed("component", "label")
    labelled = cut(tables.join(known, "node", "left").withColumn("label", F.coalesce("label", "node")))
    others = _keys(labelled, False)
    open_ = others.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    more, _ = linked_components(others.join(open_, "key", "left_semi").select("key", "node", "n"), sets_of, similarity, part, labelled.select("node", "label"))
    found = cut(components(links.unionByName(more)))
    of_node = nodes.join(found, "node", "left").select("h1", "h2", "smallest", F.coalesce("component", "node").alias("component"))
    smallest = of_node.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = cut(of_node.join(smallest, "component").select("h1", "h2", "component_id"))
    full = sketches.select("doc_id", "h1", "h2", F.col("n").alias("n_shingles")).join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.when(F.col("n_shingles") == 0, True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("kept"))
