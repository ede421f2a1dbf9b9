"""Point-of-interest layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Layers with differing columns as one table; columns that a layer lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def transit_stops(stops: DataFrame) -> DataFrame:
    """Stops as points: (kind, name, details, lon, lat, accessible); rows without a place on the globe go."""
    lon, lat = F.col("stop_lon").try_cast("double"), F.col("stop_lat").try_cast("double")
    wheels = F.when(F.col("wheelchair_boarding") == "1", "Wheelchair accessible").when(F.col("wheelchair_boarding") == "2", "Not wheelchair accessible")
    rows = stops.select(F.lit("transit").alias("kind"), F.coalesce(F.nullif(F.trim("stop_name"), F.lit("")), F.lit("Transit stop")).alias("name"),
                        F.coalesce(wheels, F.lit("Transit stop")).alias("details"), lon.alias("lon"), lat.alias("lat"), wheels.alias("accessible"))
    return rows.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


def preferred_resource(resources: DataFrame) -> DataFrame:
    """Of each package the first GeoJSON resource whose name or url has 4326, else its first GeoJSON resource."""
    rows = resources.where(F.upper("format") == "GEOJSON")
    other = ~F.concat(F.coalesce("name", F.lit("")), F.coalesce("url", F.lit(""))).contains("4326")
    best = rows.groupBy("package").agg(F.min(F.struct(other.alias("other"), "pos", "name", "url")).alias("b"))
    return best.select("package", "b.name", "b.url")


def provenance(features: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per source its title, licence and number of features, zero included, and the total of all."""
    from pyspark.sql import Window

    counts = features.groupBy("source").agg(F.count("*").alias("n"))
    rows = catalogue.join(counts, "source", "left").na.fill(0, ["n"]).withColumnRenamed("n", "feature_count")
    return rows.withColumn("total", F.sum("feature_count").over(Window.partitionBy()))  # one row per source
