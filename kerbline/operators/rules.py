"""Explainable rules: severity, evidence confidence, reasons and limitations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import missing_codes, ordered_unique

# Threshold schemes (added metres, detour ratio), sentences and interpretations.
SCHEMES = {"midpoint": (129.181, 6.983), "upper_quartile": (161.370, 7.189)}
SENTENCES = {
    "NOT_EVALUATED": "Potential network impact was not evaluated because a complete modeled route result is unavailable.",
    "SEVERE": "Potential impact is rated SEVERE because the modeled hard closure disconnects the evaluated endpoint pair.",
    "HIGH": "Potential impact is rated HIGH because the modeled route exceeds a documented detour threshold.",
    "MODERATE": "Potential impact is rated MODERATE because a modeled detour exists but does not reach the documented HIGH threshold.",
    "LOW": "Potential impact is rated LOW because the modeled route has no detour.",
}


def confidence(n: Column, direct: Column, near: Column, low: Column, fallback: Column) -> Column:
    return (
        F.when(n == 0, "INSUFFICIENT_EVIDENCE").when(fallback | (low > 0), "LOW").when((direct > 0) & (near == 0), "HIGH").otherwise("MEDIUM")
    )


def assess(inputs: DataFrame, high_added: Column | None = None, high_ratio: Column | None = None) -> DataFrame:
    """Add severity, confidence, reason_codes, limitation_codes and explanation to assessment inputs.

    A restriction without candidates, or without a complete result, is not evaluated; lost connectivity is SEVERE; no detour is LOW; reaching either
    threshold is HIGH, with both reasons; the rest is MODERATE. Codes keep the order in which they arise, each once.
    """
    added, ratio = F.col("added_distance_m"), F.col("detour_ratio")
    limit_a, limit_r = (x if x is not None else F.lit(v) for x, v in zip((high_added, high_ratio), SCHEMES["midpoint"]))
    none = F.col("candidate_edge_count") == 0
    lost = F.coalesce(F.col("connectivity_lost"), F.lit(False))
    unknown = added.isNull() | ratio.isNull()
    flat = (added == 0) & (ratio <= 1)
    high = (added >= limit_a) | (ratio >= limit_r)
    severity = F.when(none, "NOT_EVALUATED").when(lost, "SEVERE").when(unknown, "NOT_EVALUATED").when(flat, "LOW").when(high, "HIGH").otherwise("MODERATE")
    code = lambda *x: F.array(*map(F.lit, x))
    reasons = (
        F.when(none, code("NO_CANDIDATE_EDGE")).when(lost, code("CONNECTIVITY_LOSS_MODELED")).when(unknown, code("NETWORK_IMPACT_NOT_EVALUATED"))
        .when(flat, code("NO_MODELED_DETOUR")).when(high, code("ADDED_DISTANCE_HIGH", "DETOUR_RATIO_HIGH")).otherwise(code("MODELED_DETOUR"))
    )
    limits = F.concat(
        F.coalesce(F.col("topology_limitations"), F.array().cast("array<string>")) if "topology_limitations" in inputs.columns else F.array().cast("array<string>"),
        F.array(F.when(F.col("fallback_used"), "MATCH_BASED_ON_POINT_FALLBACK").when(F.col("proximity_count") > 0, "MATCH_INCLUDES_PROXIMITY_CANDIDATES"),
                F.when(~F.col("valid_polyline"), "RESTRICTION_POLYLINE_MALFORMED")),
        missing_codes(F.col("missing_fields")),
    )
    conf = confidence(F.col("candidate_edge_count"), F.col("direct_count"), F.col("proximity_count"), F.col("low_count"), F.col("fallback_used"))
    out = inputs.withColumns({"severity": severity, "confidence": conf, "reason_codes": reasons, "limitation_codes": ordered_unique(limits)})
    return out.withColumn("explanation", sentence(F.col("severity"), F.col("confidence")))


def sentence(severity: Column, conf: Column) -> Column:
    text = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    return F.concat(F.element_at(text, severity), F.lit(" Evidence confidence is "), conf, F.lit("."))


def violations(inputs: DataFrame) -> DataFrame:
    """(restriction_id, problem) of inputs without an id or with negative counts or metrics; none if all are good."""
    counts = ["candidate_edge_count", "direct_count", "proximity_count", "low_count"]
    metrics = ["affected_edge_length_m", "added_distance_m", "detour_ratio", "duration_hours"]
    bad = F.array(
        F.when(F.coalesce(F.col("restriction_id"), F.lit("")) == "", "restriction_id is required"),
        *[F.when(F.col(c) < 0, f"{c} is negative") for c in counts + metrics if c in inputs.columns],
    )
    return inputs.select("restriction_id", F.explode(F.array_compact(bad)).alias("problem"))


def under_schemes(inputs: DataFrame) -> DataFrame:
    """The assessment under each threshold scheme."""
    table = F.array(*[F.struct(F.lit(n).alias("scheme"), F.lit(a).alias("high_added"), F.lit(r).alias("high_ratio")) for n, (a, r) in SCHEMES.items()])
    rows = inputs.select("*", F.inline(table))
    return assess(rows, F.col("high_added"), F.col("high_ratio"))


def target_feasibility(records: DataFrame, target: str) -> DataFrame:
    """One row: target, usable records, class counts and the reasons against it."""
    by = records.where("impact_evaluable").groupBy("impact_severity").agg(F.count("*").alias("n"))
    counts = F.array_sort(F.collect_list(F.struct("impact_severity", "n")))  # a row per class
    one = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usable"), F.map_from_entries(counts).alias("class_counts"), F.count("*").alias("k"))
    reasons = F.array_compact(F.array(
        F.when(F.col("usable") == 0, "NO_EVALUATED_NETWORK_LABELS"),
        F.lit("TARGET_IS_POST_SIMULATION_OUTCOME") if target in {"added_distance_m", "detour_ratio", "connectivity_lost"} else F.lit(None),
        F.lit("TARGET_IS_DERIVED_FROM_POST_SIMULATION_RULE_INPUTS") if target in {"high_severe", "severity_class"} else F.lit(None),
        F.when(F.col("k") < 2, "INSUFFICIENT_CLASS_VARIATION"),
    ))
    return one.select(F.lit(target).alias("target"), "usable", "class_counts", reasons.alias("reasons"))
