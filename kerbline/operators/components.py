"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.plans.checkpoint import cut

MAX_ROUNDS = 60


def _minima(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links`` (u, v).

    Alternates large-star and small-star steps, which hang every node under the smallest neighbour it knows. A step is
    a combined minimum for each node and a join on it; no node's neighbours are ever gathered.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _minima(both).select("of", F.least("of", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = _minima(large)
        small = (
            large.join(low, F.col("u") == F.col("of"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select(F.col("of").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        edges = cut(small)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
