"""A page from an index equals the sorted list's, at any depth, with and without filters; geometry quality of an empty table."""

import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import listing, profile


@pytest.mark.parametrize("equal", [{}, {"state": "a"}, {"state": "none"}])
def test_indexed_pages_equal_the_sorted_list(spark, equal):
    rng = random.Random(3)
    rows = [(rng.choice([None, f"{rng.randrange(400):03d}"]) if i % 9 == 0 else f"{rng.randrange(400):03d}", "a" if i % 3 else "b", i) for i in range(1000)]
    folder = listing.index_pages(spark.createDataFrame(rows, "restriction_id string, state string, n long"), ranges=16)
    kept = sorted((r for r in rows if all(r[1] == v for v in equal.values())), key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    for offset in (0, 25, 490, len(kept) - 7, len(kept) + 50):
        if offset < 0:
            continue
        found = [tuple(r) for r in listing.indexed_page(spark, folder, offset, 25, **equal).collect()]
        assert [r[:3] for r in found] == kept[offset : offset + 25]
        assert all(r[3:] == (len(kept), -(-len(kept) // 25)) for r in found)


def test_the_last_page_reads_one_range(spark):
    folder = listing.index_pages(spark.range(4000).select(F.format_string("%05d", "id").alias("restriction_id"), F.lit("a").alias("state")), ranges=16)
    last = listing.indexed_page(spark, folder, 3975, 25)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan and "GreaterThanOrEqual(_row" in plan
    assert len(last.inputFiles()) >= 1 and last.count() == 25
    read = spark.read.parquet(f"{folder}/rows").where(F.col("restriction_id") >= "03975").select("_range").distinct().count()
    assert read == 1


def test_pages_of_an_empty_table(spark):
    folder = listing.index_pages(spark.createDataFrame([], "restriction_id string, state string"))
    assert listing.indexed_page(spark, folder).collect() == [] and listing.indexed_page(spark, folder, state="x").count() == 0


def test_geometry_quality_of_awkward_tables(spark):
    schema = "geom_type string, parts array<array<struct<x: double, y: double>>>, error string, blob binary"
    none = profile.geometry_quality(spark.createDataFrame([], schema)).first()
    assert (none["n"], none["valid"], none["duplicates"], none["west"], none["valid_percent"]) == (0, 0, 0, None, 0.0)
    line = [[(0.0, 1.0), (2.0, 3.0)]]
    rows = [("LineString", line, None, b"a"), ("LineString", line, None, b"a"), ("LineString", [[(float("nan"), 1.0), (2.0, 3.0)]], None, b"b"), ("MultiLineString", [], None, b"c"),
            (None, None, "empty", b"d"), (None, None, "truncated", b"e"), (None, None, "null", None)]
    got = profile.geometry_quality(spark.createDataFrame(rows, schema)).first().asDict()
    assert got == {"n": 7, "lines": 3, "multilines": 1, "null_blobs": 1, "empty": 1, "failed": 1, "invalid": 3, "valid": 2, "west": 0.0, "south": 1.0, "east": 2.0, "north": 3.0, "duplicates": 1, "valid_percent": 28.5714}
