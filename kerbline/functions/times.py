"""Column expressions over times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
LONG_HOURS = 720


def from_millis(text: Column) -> Column:
    """Epoch milliseconds, as text or number, as a timestamp."""
    return F.timestamp_millis(F.expr("0") + text.try_cast("double").try_cast("bigint"))


def hours_between(start_ms: Column, end_ms: Column) -> Column:
    """Null if either is missing or the end comes first."""
    return F.when(end_ms >= start_ms, (end_ms - start_ms) / F.lit(float(HOUR_MS)))


def days_between(start_ms: Column, end_ms: Column) -> Column:
    """May be negative."""
    return (end_ms - start_ms) / F.lit(float(DAY_MS))


def duration_class(hours: Column) -> Column:
    return F.when(hours.isNull(), "unknown").when(hours >= LONG_HOURS, "long").otherwise("short")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def humanized(hours: Column) -> Column:
    """~5h, ~12d, ~3mo or ~1.6yr restriction."""
    days, months = hours / 24, hours / 24 / 30.44
    return (
        F.when(hours.isNull(), "duration unknown")
        .when(hours < 48, F.concat(F.lit("~"), F.greatest(F.lit(1), _half_up(hours)).cast("string"), F.lit("h restriction")))
        .when(days < 45, F.concat(F.lit("~"), _half_up(days).cast("string"), F.lit("d restriction")))
        .when(months < 18, F.concat(F.lit("~"), _half_up(months).cast("string"), F.lit("mo restriction")))
        .otherwise(F.concat(F.lit("~"), F.format_string("%.1f", months / 12), F.lit("yr restriction")))
    )


def about(hours: Column) -> Column:
    """about 3 days (72 hours); about 5 hours; unknown duration."""
    h = F.round(hours).cast("long").cast("string")
    return (
        F.when(hours.isNull(), "unknown duration")
        .when(hours >= 24, F.concat(F.lit("about "), F.round(hours / 24).cast("long").cast("string"), F.lit(" days ("), h, F.lit(" hours)")))
        .otherwise(F.concat(F.lit("about "), h, F.lit(" hours")))
    )


def whole_days(hours: Column) -> Column:
    """At least one day."""
    return F.greatest(F.lit(1), F.round(hours / 24).cast("long"))


def distance_text(metres: Column) -> Column:
    return (
        F.when(metres.isNull(), "—")
        .when(metres >= 1000, F.concat(F.format_string("%.2f", metres / 1000), F.lit(" km")))
        .otherwise(F.concat(_half_up(metres).cast("string"), F.lit(" m")))
    )


def calendar(ts: Column) -> Column:
    """Struct year, weekday (Monday 0), month, weekend (0/1), hour, day_name."""
    weekday = F.weekday(ts)
    return F.struct(
        F.year(ts).alias("year"), weekday.alias("weekday"), F.month(ts).alias("month"),
        F.when(weekday >= 5, 1).otherwise(0).alias("weekend"), F.hour(ts).alias("hour"), F.date_format(ts, "EEEE").alias("day_name"),
    )
