"""Column expressions that read text fields; what can't be read is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a number and a polyline text look like.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
PAIR = rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]"
POLYLINE = rf"^\s*\[\s*{NUMBER}\s*,\s*{NUMBER}\s*\](?:\s*,\s*\[\s*{NUMBER}\s*,\s*{NUMBER}\s*\])+\s*$"


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def finite(x: Column) -> Column:
    """Text as a finite double."""
    value = F.trim(x).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def points(text: Column, finite_only: bool = False) -> Column:
    """``[lon,lat],[lon,lat],...`` as an array of structs x, y; null unless it has at least two pairs and nothing else."""
    xs, ys = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(xs, ys, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    parsed = F.when(text.rlike(POLYLINE), pairs)
    if finite_only:
        bad = F.exists(parsed, lambda p: (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
        parsed = F.when(~bad, parsed)
    return parsed


def codes(text: Column) -> Column:
    """``A;B;;C`` as an array without empty codes."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda c: c != "")


def code_text(array: Column) -> Column:
    return F.array_join(array, ";")


def truth(text: Column) -> Column:
    """'True' is true; all else false."""
    return F.coalesce(text == "True", F.lit(False))


def number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("double")


def whole(text: Column) -> Column:
    """An integer that may be written as a decimal number."""
    return number(text).cast("int")


def missing_codes(fields: Column) -> Column:
    """MISSING_<FIELD> for each name, in order, once."""
    return F.array_distinct(F.transform(fields, lambda f: F.concat(F.lit("MISSING_"), F.upper(f))))


def ordered_unique(values: Column) -> Column:
    """Without nulls and repeats, in order of first appearance."""
    return F.array_distinct(F.array_compact(values))


def coordinate_pair(text: Column) -> Column:
    """Struct (lon, lat, error) of ``lon,lat``; error is NOT_A_PAIR, NOT_NUMERIC, OUT_OF_BOUNDS or null."""
    parts = F.split(text, ",")
    lon, lat = finite(F.get(parts, F.lit(0))), finite(F.get(parts, F.lit(1)))
    error = (
        F.when(text.isNull() | (F.size(parts) != 2), "NOT_A_PAIR")
        .when(lon.isNull() | lat.isNull(), "NOT_NUMERIC")
        .when(~(lon.between(-180, 180) & lat.between(-90, 90)), "OUT_OF_BOUNDS")
    )
    good = error.isNull()
    return F.struct(F.when(good, lon).alias("lon"), F.when(good, lat).alias("lat"), error.alias("error"))


def metric(text: Column) -> Column:
    """Empty and non-finite values are null."""
    return finite(F.nullif(text, F.lit("")))


def or_label(x: Column, label: str = "Not available") -> Column:
    """The value as text, or the label where it is missing or blank."""
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit(label))


def record_hash(*columns: Column) -> Column:
    """SHA-256 over the columns as text; a null differs from ''."""
    parts = [F.coalesce(F.concat(F.lit("+"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def display_label(road: Column, name: Column, record_id: Column) -> Column:
    return F.coalesce(blank_to_null(road), blank_to_null(name), record_id)


def cross_street(from_road: Column, to_road: Column, name: Column) -> Column:
    """``from → to`` if both are there, else the name."""
    a, b = blank_to_null(from_road), blank_to_null(to_road)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" → "), b)).otherwise(blank_to_null(name))
