"""Profiles and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def columns_named(df: DataFrame, tokens: list[str]) -> DataFrame:
    """The columns whose name holds one of the tokens, whatever its case."""
    names = [c for c in df.columns if any(t.lower() in c.lower() for t in tokens)]
    return df.sparkSession.createDataFrame([(n,) for n in names], "name string")


def _unpivoted(df: DataFrame, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias("value")) for f in fields])
    return df.select(F.inline(pairs))


def _percent(n, total):
    return F.coalesce(F.round(F.try_divide(n * 100, total), 4), F.lit(0.0))


def field_profile(df: DataFrame, fields: list[str], time_fields: tuple[str, ...] = ()) -> DataFrame:
    """Per text field: observed type (blank, epoch_milliseconds_timestamp, binary_indicator_or_enum, numeric, text), counts and distinct values."""
    from kerbline.functions.text import finite

    filled = F.col("value") != ""
    every = lambda cond: F.coalesce(F.bool_and(F.when(filled, cond)), F.lit(False))
    number = F.coalesce(finite(F.col("value")).isNotNull(), F.lit(False))
    out = _unpivoted(df, fields).groupBy("field").agg(
        F.count("*").alias("count"), F.count_if(filled).alias("non_empty"), F.count_if(~filled).alias("blank"), F.count_distinct(F.when(filled, F.col("value"))).alias("distinct"),
        every(number).alias("_number"), every(F.col("value").isin("0", "1")).alias("_binary"),
    )
    is_time = F.col("field").isin(*time_fields) if time_fields else F.lit(False)
    kind = F.when(F.col("non_empty") == 0, "blank").when(is_time & F.col("_number"), "epoch_milliseconds_timestamp").when(F.col("_binary"), "binary_indicator_or_enum").when(F.col("_number"), "numeric").otherwise("text")
    return out.select("field", kind.alias("type"), "count", "non_empty", "blank", _percent(F.col("blank"), F.col("count")).alias("blank_percent"), "distinct")


def id_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, filled ids, distinct ids, rows that repeat one, ids that are repeated."""
    counts = df.groupBy(F.nullif(F.trim(key), F.lit("")).alias("id")).agg(F.count("*").alias("n"))
    filled = F.col("id").isNotNull()
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"), F.count_if(filled).alias("distinct"),
                      F.coalesce(F.sum(F.when(filled, F.col("n") - 1)), F.lit(0)).alias("extra_rows"), F.count_if(filled & (F.col("n") > 1)).alias("repeated_ids"))


def coordinate_quality(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """One row of counts over text coordinates: parsed, failed, missing, outside the globe (both read, or each for itself), outside the city, and the
    range of what could be read."""
    from kerbline.functions.geo import BOUNDS, within
    from kerbline.functions.text import finite

    x, y = finite(F.col(lon)), finite(F.col(lat))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    both = x.isNotNull() & y.isNotNull()
    return df.agg(
        F.count_if(both).alias("parsed"), F.count_if(x.isNull() & ~blank(lon)).alias("lon_failed"), F.count_if(y.isNull() & ~blank(lat)).alias("lat_failed"), F.count_if(blank(lon) | blank(lat)).alias("missing"),
        F.count_if(both & ~(x.between(-180, 180) & y.between(-90, 90))).alias("outside_globe"), F.count_if(both & ~within(x, y, BOUNDS)).alias("outside_city"),
        F.count_if(~x.between(-180, 180)).alias("lon_outside"), F.count_if(~y.between(-90, 90)).alias("lat_outside"),
        F.min(x).alias("west"), F.min(y).alias("south"), F.max(x).alias("east"), F.max(y).alias("north"),
    )


def polyline_quality(df: DataFrame, column: str) -> DataFrame:
    """One row: filled, blank, parsed and malformed polylines, their vertices, those outside the city, and the extent of the parsed ones."""
    from kerbline.functions.geo import BOUNDS, within
    from kerbline.functions.text import points

    p = points(F.col(column), finite_only=True)
    filled = F.coalesce(F.trim(column) != "", F.lit(False))
    outside = F.size(F.filter(p, lambda v: ~within(v["x"], v["y"], BOUNDS)))
    edge = lambda f, axis: f(F.transform(p, lambda v: v[axis]))
    extent = [F.min(edge(F.array_min, "x")).alias("west"), F.min(edge(F.array_min, "y")).alias("south"), F.max(edge(F.array_max, "x")).alias("east"), F.max(edge(F.array_max, "y")).alias("north")]
    return df.agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("blank"), F.count_if(p.isNotNull()).alias("parsed"), F.count_if(filled & p.isNull()).alias("malformed"),
                  F.coalesce(F.sum(F.when(p.isNotNull(), F.size(p))), F.lit(0)).alias("vertices"), F.coalesce(F.sum(F.when(p.isNotNull(), outside)), F.lit(0)).alias("outside_city"), *extent)


def observed_values(df: DataFrame, field: str) -> DataFrame:
    """(value, n): what a text field holds and how often, trimmed; null and blank are one value, the empty text."""
    return df.groupBy(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))).alias("value")).agg(F.count("*").alias("n"))


def temporal_quality(df: DataFrame, fields: list[str]) -> DataFrame:
    """Per field of epoch milliseconds as text: parsed, failed, blank and its first and last time."""
    from kerbline.functions.times import from_millis

    t, filled = from_millis(F.col("value")), F.col("value") != ""
    return _unpivoted(df, fields).groupBy("field").agg(
        F.count_if(filled & t.isNotNull()).alias("parsed"), F.count_if(filled & t.isNull()).alias("failed"), F.count_if(~filled).alias("blank"),
        _percent(F.count_if(~filled), F.count("*")).alias("blank_percent"), F.min(t).alias("first"), F.max(t).alias("last"))


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows that repeat another in all columns, and how many sets of filled fields occur."""
    from kerbline.functions.text import record_hash

    rows = df.select(record_hash(*map(F.col, columns)).alias("h"), F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]).alias("s"))
    hashes = rows.groupBy("h").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    return hashes.crossJoin(F.broadcast(rows.agg(F.count_distinct("s").alias("field_sets"))))  # one row each


def geometry_quality(rows: DataFrame) -> DataFrame:
    """One row over decoded blobs (geom_type, parts, error, blob): counts by type, null and empty blobs, those that can't be read, invalid ones,
    repeats of a blob, the valid ones with their share, and the extent of these.

    A geometry is valid if it has a line, each line has two points or more, and all coordinates are finite; one that can't be read is invalid too.
    Crossing itself makes no line invalid. Of an empty table the counts are 0 and the extent is null.
    """
    kind = lambda t: F.count_if(F.col("geom_type") == t)
    empty = F.coalesce(F.col("error") == "empty", F.lit(False))
    there, failed = F.col("blob").isNotNull(), F.coalesce(F.col("error").isNotNull(), F.lit(False)) & ~empty
    finite = lambda v: (F.abs(v) < F.lit(float("inf")))
    whole = (F.size("parts") > 0) & ~F.exists("parts", lambda line: (F.size(line) < 2) | F.exists(line, lambda p: ~(finite(p["x"]) & finite(p["y"]))))
    valid = there & F.col("parts").isNotNull() & whole
    all_points = F.when(F.col("_valid"), F.flatten("parts"))
    edge = lambda f, axis: f(all_points if axis is None else F.transform(all_points, lambda p: p[axis]))
    marked = rows.select("geom_type", "error", "blob", "parts", F.coalesce(valid, F.lit(False)).alias("_valid"))
    marked = marked.select("geom_type", "error", "blob", "_valid", *[edge(f, axis).alias(f"_{n}") for n, f, axis in (("west", F.array_min, "x"), ("south", F.array_min, "y"), ("east", F.array_max, "x"), ("north", F.array_max, "y"))])
    invalid = there & ~empty & ~F.col("_valid")
    out = marked.agg(
        F.count("*").alias("n"), kind("LineString").alias("lines"), kind("MultiLineString").alias("multilines"), F.count_if(~there).alias("null_blobs"), F.count_if(there & empty).alias("empty"),
        F.count_if(there & failed).alias("failed"), F.count_if(invalid).alias("invalid"), F.count_if("_valid").alias("valid"),
        F.min("_west").alias("west"), F.min("_south").alias("south"), F.max("_east").alias("east"), F.max("_north").alias("north"),
    )
    # repeats of a blob are counted by its hash, so that a blob that stands in a third of all rows is summed before it is shuffled
    repeats = rows.where("blob is not null").groupBy(F.sha2("blob", 256).alias("h")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return out.crossJoin(F.broadcast(repeats)).withColumn("valid_percent", _percent(F.col("valid"), F.col("n")))  # one row each


def identifier_fields(profile: DataFrame, total_field: str = "count") -> DataFrame:
    """Fields of a profile whose values are all there and all different."""
    return profile.where((F.col("non_empty") == F.col(total_field)) & (F.col("distinct") == F.col(total_field)) & (F.col(total_field) > 0)).select("field")
