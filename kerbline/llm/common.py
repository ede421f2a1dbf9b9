"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a fresh local one where that is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kerbline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries made and run in this block remove their shuffles' files when they end, not when the driver's JVM collects garbage."""
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, which cuts its lineage and fixes its generated ids.

    Its shuffles' files go with it. Spark removes the files of ``df`` itself when nothing refers to them
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    shared_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # the setting holds for a new query only


def row_keys(columns: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the whole row; a null counts by its place, as a hash alone passes over it."""
    every = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in every])
    return F.xxhash64(F.lit(1), nulls, *every), F.xxhash64(F.lit(2), nulls, *every)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    """A-Z to a-z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def run_starts(df: DataFrame, order: list, value: str, out: str = "before") -> DataFrame:
    """Add the exclusive running sum of ``value`` over the whole of ``df`` in the given order.

    The rows are dealt by ranges of the order, so no key, however frequent, has to fit in one task; ranges are summed
    first (one row each, and there are as many as shuffle partitions), and each range then runs its own sum.
    """
    n = shuffle_partitions(df.sparkSession)
    ranged = cut(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    )
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_start"))
    within = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_here", F.sum(value).over(within) - F.col(value))
        .join(F.broadcast(starts), "_part")  # one row for each range: bounded by the partition count
        .withColumn(out, F.col("_start") + F.col("_here"))
        .drop("_part", "_seq", "_start", "_here")
    )
