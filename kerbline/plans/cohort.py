"""Analytical records of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.text import code_text
from kerbline.operators.rules import assess

# The columns of an analytical record, in order.
COLUMNS = (
    "restriction_id", "evaluation_status", "valid_restriction_polyline", "fallback_geometry_used", "candidate_edge_count", "direct_intersection_count", "proximity_only_count",
    "high_confidence_match_count", "medium_confidence_match_count", "low_confidence_match_count", "affected_edge_length_m", "evidence_confidence", "network_evaluated",
    "baseline_distance_m", "disrupted_distance_m", "added_distance_m", "detour_ratio", "connectivity_lost", "removed_edge_count", "penalized_edge_count", "impact_severity",
    "reason_codes", "limitations", "impact_evaluable", "duration_hours", "source_snapshot", "quality_flags",
)


def analytical_records(inputs: DataFrame, snapshot: str = "") -> DataFrame:
    """The fixed columns of every assessed input."""
    a = assess(inputs)
    null = lambda t: F.lit(None).cast(t)
    values = {
        "evaluation_status": F.lit("SPATIAL_EVIDENCE_ONLY"), "valid_restriction_polyline": F.col("valid_polyline"), "fallback_geometry_used": F.col("fallback_used"),
        "direct_intersection_count": F.col("direct_count"), "proximity_only_count": F.col("proximity_count"), "high_confidence_match_count": F.col("direct_count"),
        "medium_confidence_match_count": F.col("proximity_count"), "low_confidence_match_count": F.col("low_count"), "evidence_confidence": F.col("confidence"),
        "network_evaluated": F.col("added_distance_m").isNotNull(), "baseline_distance_m": null("double"), "disrupted_distance_m": null("double"), "removed_edge_count": null("int"),
        "penalized_edge_count": null("int"), "impact_severity": F.col("severity"), "reason_codes": code_text(F.col("reason_codes")), "limitations": code_text(F.col("limitation_codes")),
        "impact_evaluable": F.col("severity") != "NOT_EVALUATED", "source_snapshot": F.lit(snapshot), "quality_flags": F.when(~F.col("valid_polyline"), "MALFORMED_POLYLINE").otherwise(""),
    }
    return a.select(*[(values.get(c, F.col(c))).alias(c) for c in COLUMNS])
