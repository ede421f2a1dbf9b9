"""Building rings in grid cells, and tile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import cell, within

# The size of a cell in degrees.
CELL = (0.02, 0.015)


def clip_counts(rings: DataFrame, box: dict) -> DataFrame:
    """Counts of rings (h, ring): all, without height, first vertex outside the box, kept."""
    first = F.get("ring", F.lit(0))
    inside = F.coalesce(within(first["x"], first["y"], box), F.lit(False))
    high = F.coalesce(F.col("h") > 0, F.lit(False))
    return rings.agg(F.count("*").alias("n"), F.count_if(~high).alias("flat"), F.count_if(high & ~inside).alias("outside"), F.count_if(high & inside).alias("kept"))


def with_cell(rows: DataFrame, lon: Column, lat: Column, origin: tuple[float, float]) -> DataFrame:
    i, j = cell(lon - origin[0], F.lit(CELL[0])), cell(lat - origin[1], F.lit(CELL[1]))
    return rows.withColumns({"i": i, "j": j}).withColumn("cell", F.concat_ws("_", F.lit("cell"), "i", "j"))


def cell_manifest(rows: DataFrame, origin: tuple[float, float]) -> DataFrame:
    """Per cell its count and bounds, and the total of all."""
    counts = rows.groupBy("i", "j", "cell").agg(F.count("*").alias("n"))
    edge = lambda k, axis, more: F.lit(origin[axis]) + (F.col(k) + more) * F.lit(CELL[axis])
    return counts.select("cell", "n", edge("i", 0, 0).alias("west"), edge("i", 0, 1).alias("east"), edge("j", 1, 0).alias("south"), edge("j", 1, 1).alias("north"),
                         F.sum("n").over(Window.partitionBy()).alias("total"))  # one row per cell


def fetch_cells(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of well-named cells that the manifest lists."""
    return rows.where(F.col("cell").rlike(r"^cell_-?\d+_-?\d+$")).join(wanted, "cell", "left_semi")


def tile_window(tiles: DataFrame, zoom: tuple[int, int], col: tuple[int, int], row: tuple[int, int]) -> DataFrame:
    return tiles.where(F.col("zoom").between(*zoom) & F.col("col").between(*col) & F.col("row_").between(*row))


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("zoom").agg(F.count("*").alias("n"), (F.sum("bytes") / float(2**20)).alias("mb"))
