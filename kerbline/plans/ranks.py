"""Numbering the rows of a whole table in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.plans.checkpoint import cut

#: The place of a row in its partition, in the ids that Spark gives.
ROW_BITS = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], out: str = "place", first: int = 1) -> DataFrame:
    """Add each row's place in the order. The rows are dealt by ranges of it, so no task has more than its range; what is broadcast is a
    row for each range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the id has the partition above its 33rd bit and the row's place in the partition below
    ranged = cut(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))}))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_row") + first).drop("_part", "_row", "_start")
