"""Aggregates over records, candidates, labels and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.plans.checkpoint import cut
from kerbline.plans.ranks import numbered


def distributions(records: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) for each of the columns, in one pass; (null field, null value, n) counts all rows."""
    pairs = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")),
                    *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return records.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def summary(records: DataFrame, columns: list[str], evaluated: Column) -> DataFrame:
    """One row: total, evaluated, and a map of counts for each column; zero and empty maps of an empty table."""
    whole = records.agg(F.count("*").alias("total"), F.count_if(evaluated).alias("evaluated"))
    for c in columns:
        counts = records.groupBy(c).agg(F.count("*").alias("n"))
        entries = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(c), F.lit("")), "n")))
        whole = whole.crossJoin(F.broadcast(counts.agg(F.map_from_entries(entries).alias(f"{c}_counts"))))  # one row each
    return whole


def crosstab(records: DataFrame, a: str, b: str) -> DataFrame:
    return records.groupBy(F.concat_ws("|", a, b).alias("pair")).agg(F.count("*").alias("n"))


QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def exact_quantiles(values: DataFrame, by: str, value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, one column for each quantile) of rows (by, value): interpolated linearly, over all values that aren't null.

    The values are sorted by ranges and counted by range, which gives each its place; then the places next to a quantile are picked. So no task
    holds more than its range, however many values a group has. What is broadcast is a row for each group and quantile; groups are few.
    """
    rows = numbered(values.where(F.col(value).isNotNull()).select(by, value), [F.col(by), F.col(value)], "place", 0)
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    at = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for name, q in quantiles.items()])
    wanted = cut(sizes.select("_by", "first", F.inline(at)))
    low, high = F.floor("at"), F.ceil("at")
    ends = wanted.select("_by", "name", "at", F.explode(F.array_distinct(F.array(low, high))).alias("k"), (F.col("first") + F.col("k")).alias("wanted"))
    picked = rows.join(F.broadcast(ends), (F.col(by) == F.col("_by")) & (F.col("place") == F.col("wanted")))
    weight = F.when(low == high, 1.0).when(F.col("k") == low, high - F.col("at")).otherwise(F.col("at") - low)
    found = picked.groupBy(by, "name").agg(F.sum(F.col(value) * weight).alias("v"))
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in quantiles])


def distribution_summary(records: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, count, missing, min, mean, p25 ... p99, max), quantiles exact and interpolated linearly."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    values = records.select(F.inline(pairs))
    out = values.groupBy("metric").agg(F.count("v").alias("count"), F.count_if(F.col("v").isNull()).alias("missing"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"))
    found = exact_quantiles(values, "metric", "v", QUANTILES).withColumnRenamed("metric", "_metric")
    return out.join(found, F.col("metric") == F.col("_metric"), "left").select("metric", "count", "missing", "min", "mean", *QUANTILES, "max")


def match_summary(restrictions: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Counts at one threshold: restrictions (restriction_id, malformed), candidates (restriction_id, signal, confidence, threshold_m)."""
    at = candidates.where(F.col("threshold_m").isNull() | (F.col("threshold_m") == threshold))
    is_ = lambda s: F.count_if(F.col("signal") == s)
    conf = lambda s: F.count_if(F.col("confidence") == s)
    c = at.agg(
        F.count_distinct("restriction_id").alias("with_candidate"), F.count("*").alias("candidates"), is_("direct_intersection").alias("direct"),
        is_("proximity").alias("proximity"), is_("point_fallback").alias("fallback"), conf("HIGH").alias("high"), conf("MEDIUM").alias("medium"), conf("LOW").alias("low"),
    )
    r = restrictions.agg(F.count("*").alias("processed"), F.count_if(~F.col("malformed")).alias("valid"), F.count_if("malformed").alias("using_fallback"))
    return r.crossJoin(F.broadcast(c))  # one row each


def threshold_sweep(candidates: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: restrictions with candidates, candidates, direct, proximity-only and fallback matches."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = candidates.withColumn("t", F.explode(F.when(F.col("threshold_m").isNull(), ts).otherwise(F.array("threshold_m"))))
    rows = rows.where(F.array_contains(ts, F.col("t")))
    is_ = lambda s: F.count_if(F.col("signal") == s)
    return rows.groupBy(F.col("t").alias("threshold_m")).agg(
        F.count_distinct("restriction_id").alias("with_candidates"), F.count("*").alias("candidates"), is_("direct_intersection").alias("direct"),
        is_("proximity").alias("proximity"), is_("point_fallback").alias("fallback"),
    )


def impact_aggregate(edges: DataFrame, by: list[str]) -> DataFrame:
    """Restriction-level impact of edge rows (evaluation_state, replacement_ratio, added_m, lost, length_m); see the columns."""
    ev = F.col("evaluation_state") == "EVALUATED"
    ratio, added = F.when(ev, F.col("replacement_ratio")), F.when(ev, F.col("added_m"))
    out = edges.groupBy(*by).agg(
        F.count("*").alias("candidate_edge_count"), F.count_if(ev).alias("evaluated_edge_count"), F.count(ratio).alias("alternative_path_edge_count"),
        F.count_if(ev & F.col("lost")).alias("loss_count"), F.median(ratio).alias("median_ratio"), F.max(ratio).alias("max_ratio"),
        F.percentile(ratio, 0.9).alias("p90_ratio"), F.median(added).alias("median_added_m"), F.max(added).alias("max_added_m"),
        F.sum("length_m").alias("affected_edge_length_m"),
    )
    fraction = F.try_divide(F.col("loss_count").cast("double"), F.col("evaluated_edge_count").cast("double"))
    state = F.when(F.col("evaluated_edge_count") == F.col("candidate_edge_count"), "EVALUATED").otherwise("PARTIALLY_EVALUATED")
    return out.withColumns({"loss_fraction": fraction, "evaluation_state": state})


def evidence_groups(restrictions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(restriction_id, direct, proximity, fallback, evidence_group) of every restriction (restriction_id, malformed)."""
    is_ = lambda s: F.count_if(F.col("signal") == s)
    n = candidates.groupBy("restriction_id").agg(is_("direct_intersection").alias("direct"), is_("proximity").alias("proximity"), is_("point_fallback").alias("fallback"))
    group = F.when(F.col("malformed"), "FALLBACK").when(F.col("direct") > 0, "DIRECT").when(F.col("proximity") > 0, "PROXIMITY_ONLY").otherwise("NO_CANDIDATE")
    return restrictions.join(n, "restriction_id", "left").na.fill(0, ["direct", "proximity", "fallback"]).withColumn("evidence_group", group)


def top_values(records: DataFrame, fields: dict[str, int]) -> DataFrame:
    """(field, value, n, place): the most frequent values of each field, as many as given; ties by value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = records.select(F.inline(pairs)).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("field"))
    return counts.withColumn("place", place).where(F.col("place") <= limit)


def shares(records: DataFrame, column: str) -> DataFrame:
    """(value, n, share) with the share of all rows."""
    counts = records.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per value


def histogram(records: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal widths between minimum and maximum, the last bin closed on both sides; empty bins stay out."""
    ends = records.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    rows = records.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width))).otherwise(0)
    return rows.withColumns({"bin": bin_, "width": width}).groupBy("bin", "lo", "width").agg(F.count("*").alias("n")).select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n"
    )


def classification_report(rows: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of (truth, predicted), and a row 'macro' with accuracy as its precision; 0 for a zero division."""
    cells = rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    sides = F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_truth")))
    per = cells.select("truth", "predicted", "n", F.inline(sides)).groupBy("label").agg(
        F.sum(F.when(F.col("is_truth") & (F.col("truth") == F.col("predicted")), F.col("n")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("is_truth"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(~F.col("is_truth"), F.col("n")).otherwise(0)).alias("called"),
    )
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    hit = F.col("hit")
    per = per.select("label", safe(hit, F.col("called")).alias("precision"), safe(hit, F.col("support")).alias("recall"), safe(2 * hit, F.col("called") + F.col("support")).alias("f1"), "support", "hit")
    macro = per.agg(
        F.lit("macro").alias("label"), safe(F.sum("hit"), F.sum("support")).alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")
    )
    return per.drop("hit").unionByName(macro)


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Per truth, how often each label was predicted."""
    return rows.groupBy("truth").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


BASELINE = {"None": 0.78, "Low": 0.13, "High": 0.09}


def recent(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of a log (ts, event_id)."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def drift(current: DataFrame, baseline: dict[str, float] | None = None, threshold: float = 0.1, full: bool = False) -> DataFrame:
    """(magnitude, drifted) of a table (label, share) against the baseline: the sum of ½(p ln(p/m) + q ln(q/m)) over labels that both
    have; ``full`` also counts labels that one side lacks."""
    spark = current.sparkSession
    base = spark.createDataFrame(list((baseline or BASELINE).items()), "label string, p double")
    both = base.join(current.select("label", F.col("share").alias("q")), "label", "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / m)).otherwise(0.0)
    part = 0.5 * (term("p") + term("q"))
    kept = part if full else F.when((F.col("p") > 0) & (F.col("q") > 0), part).otherwise(0.0)
    return both.agg(F.coalesce(F.sum(kept), F.lit(0.0)).alias("magnitude")).withColumn("drifted", F.col("magnitude") > threshold)
