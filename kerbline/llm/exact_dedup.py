"""Exact duplicates by deterministic block naming.

Every text is cut into fixed-size blocks of bytes. Equal blocks get one integer name: the distinct blocks are grouped by
their bytes, sorted, and numbered in that order. Then adjacent names are paired and each distinct pair is named again,
until every document has a single name. Two documents have the same name, found in the same round, exactly if their bytes are
equal: the hash that routes blocks is never taken as proof of equality, as a collision sends the job down a path that
joins on the blocks themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import cut

BLOCK_BYTES = 2048


def wide_hash(block: Column) -> Column:
    """128 bits, so that unequal blocks hardly ever meet, however many there are."""
    return F.struct(F.xxhash64(block).alias("a"), F.xxhash64(F.lit(1), block).alias("b"))


def _blocks(data: Column, block_bytes: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / F.lit(block_bytes)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Number distinct rows in sorted order; computed once, so the numbers hold."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    route: Callable[[Column], Column] = wide_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as the empty text. Rows that repeat an id are
    rows of their own: among several with the largest id, one stays. A null id is smaller than any other. Other
    columns are not read. ``route`` is the hash that brings equal blocks together; a bad one costs time, not correctness.
    """
    data = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), data.alias("data"))

    block = source.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block"))
    distinct = block.select(route(F.col("block")).alias("h"), "block").distinct()
    names = cut(_named(distinct, ["h", "block"]).select("h", "name"))
    collided = not names.groupBy("h").count().where("count > 1").isEmpty()
    keys = ["h"]
    if collided:
        keys = ["h", "block"]
        names = cut(_named(distinct, keys))

    pieces = F.transform(
        _blocks(F.col("data"), block_bytes),
        lambda b: F.struct(route(b).alias("h"), b.alias("block")) if collided else F.struct(route(b).alias("h")),
    )
    rows = source.select(
        F.monotonically_increasing_id().alias("rid"), "id", F.sha2("data", 256).alias("sha"), pieces.alias("pieces")
    )
    level = cut(
        rows.select("rid", "id", "sha", F.size("pieces").alias("n"), F.posexplode("pieces"))
        .select(
            "rid",
            "n",
            F.col("pos").cast("long").alias("pos"),
            *[F.col(f"col.{k}").alias(k) for k in keys],
            F.when(F.col("pos") == 0, F.struct("id", "sha")).alias("doc"),
        )
        .join(names, keys)
        .select("rid", "n", "pos", "name", "doc")
    )
    heads = level.where("pos = 0").select("rid", "doc.id", "doc.sha")
    level = level.drop("doc")

    found = [level.where("n = 1").select("rid", F.lit(0).alias("round"), "name")]
    longest = level.agg(F.max("n")).first()[0] or 1
    round_ = 0
    while longest > 1:
        round_ += 1
        pairs = (
            level.where("n > 1")
            .groupBy("rid", F.expr("pos div 2").alias("pos"))
            .agg(
                F.max("n").alias("n"),
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            )
        )
        pairs = cut(pairs)
        names = cut(_named(pairs.select("a", "b").distinct(), ["a", "b"]))
        level = pairs.join(names, ["a", "b"]).select("rid", F.expr("int((n + 1) div 2)").alias("n"), "pos", "name")
        level = cut(level)
        found.append(level.where("n = 1").select("rid", F.lit(round_).alias("round"), "name"))
        longest = (longest + 1) // 2

    named = found[0]
    for more in found[1:]:
        named = named.unionByName(more)
    named = cut(named.join(heads, "rid"))
    groups = cut(
        named.groupBy("round", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "rid")).alias("keep"))
    )
    return named.join(groups, ["round", "name"]).select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
