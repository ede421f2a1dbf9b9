"""Projections of records into the shapes that views show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_items(records: DataFrame) -> DataFrame:
    """List rows with defaults for what is missing."""
    return records.select(
        "restriction_id", F.coalesce("evaluation_status", F.lit("NOT_EVALUATED")).alias("state"), F.coalesce("candidate_edge_count", F.lit(0)).alias("candidates"),
        F.when(F.col("replacement_available"), "AVAILABLE").otherwise("NOT_AVAILABLE").alias("replacement"),
    )


def map_features(points: DataFrame, segments: DataFrame) -> DataFrame:
    """(restriction_id, role, x, y) of list points and of matched segments' anchors."""
    shape = lambda df, role: df.select("restriction_id", F.lit(role).alias("role"), "x", "y")
    return shape(points, "point").unionByName(shape(segments, "segment"))


def catalogue_metadata(resources: DataFrame) -> DataFrame:
    """Dataset and resource structs of catalogue rows (title, name, format, ...)."""
    return resources.withColumns({"dataset": F.struct("title"), "resource": F.struct("name", F.upper("format").alias("format"))})


def select_resources(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resources (package, name, format) that match a wanted row, and whether it is the only one of its package and name."""
    from pyspark.sql import Window

    hit = resources.join(wanted, wanted.columns)
    return hit.withColumn("exactly_one", F.count("*").over(Window.partitionBy("package", "name")) == 1)
