"""Lists of records: filters, search, pages, lookups and views for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.plans.checkpoint import fresh_path
from kerbline.plans.ranks import ROW_BITS, numbered

#: Ranges of a page index: the rows of one for each of them come to the driver.
RANGES = 1024


def filtered(records: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the values that aren't None."""
    for name, value in equal.items():
        if value is not None:
            records = records.where(F.col(name) == value)
    return records


def index_pages(records: DataFrame, order: str = "restriction_id", folder: str | None = None, ranges: int | None = None) -> str:
    """Write ``records`` so that pages in the order of a column can be read from any place, and return the folder.

    The rows are dealt into up to ``ranges`` ranges (unset: as many as a shuffle has partitions, RANGES at most) of (order, then all that can be ordered), each a folder of its own whose rows are sorted and have
    their ``_row`` in the range, from 0; beside them stands the index, the rows of each range. Nulls come first, ties have a fixed order.
    """
    spark = records.sparkSession
    folder = folder or fresh_path(spark, "pages")
    ranges = ranges or min(int(spark.conf.get("spark.sql.shuffle.partitions")), RANGES)
    ties = [F.col(f"`{n}`") for n, t in records.dtypes if n != order and not t.startswith(("map", "variant"))]
    key = [F.col(f"`{order}`"), *ties]
    dealt = records.repartitionByRange(ranges, *key).sortWithinPartitions(*key)
    dealt = dealt.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS))})
    dealt.sortWithinPartitions("_range", "_row").write.partitionBy("_range").parquet(f"{folder}/rows")
    dealt.limit(0).write.parquet(f"{folder}/columns")
    _rows(spark, folder).groupBy("_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/index")
    return folder


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = spark.read.parquet(f"{folder}/columns").schema
    return spark.read.schema(columns).parquet(f"{folder}/rows")


def indexed_page(spark: SparkSession, folder: str, offset: int = 0, limit: int = 25, **equal) -> DataFrame:
    """The page ``page`` gives, from a folder that ``index_pages`` wrote, in order.

    Only the ranges that hold a part of the page are read: their folders, and without a filter only the row groups with the rows. With one, the
    rows that pass are counted for each range first, which reads the filter's columns alone. What comes to the driver is a row for each range.
    """
    rows = _rows(spark, folder)
    wanted = {k: v for k, v in equal.items() if v is not None}
    counts = filtered(rows, **wanted).groupBy("_range").agg(F.count("*").alias("n")) if wanted else spark.read.parquet(f"{folder}/index")
    total, chosen = 0, []
    for r in sorted(counts.collect()):
        if r["n"] and total < offset + limit and total + r["n"] > offset:
            chosen.append((r["_range"], total))
        total += r["n"]
    if not chosen:
        return rows.where(F.lit(False)).drop("_range", "_row").withColumns({"total": F.lit(total).cast("long"), "pages": F.ceil(F.lit(total) / limit)})
    before = F.create_map(*[F.lit(x) for pair in chosen for x in pair])[F.col("_range")]
    here = filtered(rows.where(F.col("_range").isin([r for r, _ in chosen])), **wanted)
    if wanted:
        at = F.row_number().over(Window.partitionBy("_range").orderBy("_row")) - 1 + before
        here = here.withColumn("_at", at).where(F.col("_at").between(offset, offset + limit - 1)).drop("_at")
    else:
        parts = [(F.col("_range") == r) & F.col("_row").between(offset - n, offset + limit - 1 - n) for r, n in chosen]
        here = here.where(reduce(lambda x, y: x | y, parts))
    return here.orderBy("_range", "_row").drop("_range", "_row").withColumns({"total": F.lit(total).cast("long"), "pages": F.ceil(F.lit(total) / limit)})


def page(records: DataFrame, offset: int = 0, limit: int = 25, order: str = "restriction_id", **equal) -> DataFrame:
    """One page of the filtered list, with the number of all rows that pass and of all pages. Writes an index of the rows that pass; where more
    than one page is wanted, ``index_pages`` keeps one."""
    return indexed_page(records.sparkSession, index_pages(filtered(records, **equal), order), offset, limit)


def search(records: DataFrame, fields: list[str], query: str = "", sort_key: str = "restriction_id", descending: bool = False, **equal) -> DataFrame:
    """Rows that hold ``query`` in any of the fields, whatever its case, ordered by ``sort_key``; missing values sort as ''."""
    kept = filtered(records, **{k: v or None for k, v in equal.items()})
    if query:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))
        kept = kept.where(text.contains(query.lower()))
    kind = dict(records.dtypes)[sort_key]
    key = F.coalesce(F.col(sort_key), F.lit("")) if kind == "string" else F.col(sort_key).asc_nulls_first()
    if kind == "string":
        key = key.desc() if descending else key.asc()
    elif descending:
        key = F.col(sort_key).desc_nulls_last()
    return kept.orderBy(key)


def search_rank(records: DataFrame, fields: list[str], query: str, sort_key: str) -> DataFrame:
    """The search's rows with their place (1 first); ties share the order of the id."""
    return numbered(search(records, fields, query, sort_key), [F.coalesce(F.col(sort_key), F.lit("")), F.col("restriction_id")])


def lookup(records: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per wanted id: its record's columns, and ``found``."""
    marked = records.withColumn("found", F.lit(True))
    return ids.join(marked, "restriction_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def at_threshold(candidates: DataFrame, threshold: float) -> DataFrame:
    return candidates.where(F.col("threshold_m").isNull() | (F.col("threshold_m") == threshold))


SCENARIOS = {"HIGH_ONLY": ["HIGH"], "HIGH_MEDIUM": ["HIGH", "MEDIUM"]}


def by_scenario(candidates: DataFrame) -> DataFrame:
    """Each candidate once for every scenario that allows its confidence."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.array(*map(F.lit, v)).alias("allowed")) for n, v in SCENARIOS.items()])
    return (
        candidates.withColumn("s", F.explode(table))
        .where(F.array_contains("s.allowed", F.col("confidence")))
        .withColumn("scenario", F.col("s.scenario"))
        .drop("s")
    )


def active_counts(records: DataFrame, hours: list[float], known_only: bool = False) -> DataFrame:
    """How many records are active that many hours on: at 0 all (or those of known duration), later those that last as long."""
    steps = F.array(*[F.lit(float(h)) for h in hours])
    d = F.col("duration_hours")
    at_start = d.isNotNull() if known_only else F.lit(True)
    active = F.when(F.col("t") <= 0, at_start).otherwise(F.coalesce(d >= F.col("t"), F.lit(False)))
    return records.withColumn("t", F.explode(steps)).groupBy("t").agg(F.count_if(active).alias("active"))


def with_sidecars(records: DataFrame, coordinates: DataFrame, locations: DataFrame) -> DataFrame:
    return records.join(coordinates, "restriction_id", "left").join(locations, "restriction_id", "left")


def matches_with_geometry(matches: DataFrame, spatial: DataFrame) -> DataFrame:
    """Each candidate's first row per (restriction, segment) by ``pos``, with its geometry where there is one, ranked."""
    first = Window.partitionBy("restriction_id", "segment_id").orderBy("pos", "signal", "distance_m")
    rank = Window.partitionBy("restriction_id").orderBy("pos", "segment_id")
    rows = matches.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.withColumn("rank", F.row_number().over(rank)).join(spatial, "segment_id", "left")


def dominant_match(edges: DataFrame) -> DataFrame:
    """(restriction_id, match_type): the most frequent non-blank type; of equal ones the first seen."""
    counted = edges.where("match_type is not null and match_type <> ''").groupBy("restriction_id", "match_type").agg(
        F.count("*").alias("n"), F.min("pos").alias("first")
    )
    best = counted.groupBy("restriction_id").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "first", "match_type")).alias("b")
    )
    return best.select("restriction_id", F.col("b.match_type").alias("match_type"))


def compared(records: DataFrame, left: str, right: str, fields: list[str]) -> DataFrame:
    """One row per field: its value, as text, in either record, and whether they are the same."""
    rows = records.where(F.col("restriction_id").isin(left, right))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = rows.select("restriction_id", F.inline(pairs))
    side = lambda i: F.max(F.when(F.col("restriction_id") == i, F.col("value")))
    return long.groupBy("field").agg(side(left).alias("left"), side(right).alias("right")).withColumn("same", F.col("left").eqNullSafe(F.col("right")))


def with_provenance(records: DataFrame, snapshot: Column, **constants: str) -> DataFrame:
    return records.withColumns({**{k: F.lit(v) for k, v in constants.items()}, "source_snapshot": snapshot})
