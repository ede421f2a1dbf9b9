"""Streams with state: bursts that expire, and a saved model that scores a feed."""

import uuid

import pytest

from kerbline.plans import model
from kerbline.plans.checkpoint import fresh_path
from kerbline.queries import QUERIES
from kerbline.queries.registry import view
from kerbline.streaming import feeds


def test_an_idle_key_has_no_state_left(spark):
    folder = fresh_path(spark, "events-in")
    place = fresh_path(spark, "bursts")
    day = 86400
    files = [[(1, 100), (1, 101), (1, 102), (2, 105)], [(1, 30 * day), (1, 30 * day + 1)], [(3, 60 * day)], [(3, 60 * day + 5)]]
    table = f"{folder}/events.parquet"
    found = []
    for i, rows in enumerate(files):
        df = spark.createDataFrame(rows, "k long, s long").selectExpr("k", "timestamp_seconds(s) as ts").coalesce(1)
        df.write.mode("append").parquet(table)
        # the job starts again for each file, and goes on where it was
        stream = feeds.burst_stream(feeds.read_stream(spark, folder, "events", files=1), "k", "ts", limit=2, window_s=60.0, late="1 hour")
        found = feeds.run_to_table(stream, "bursts", place=place).drop("_batch").collect()
    assert sorted((r["key"], r["at"], r["accepted"]) for r in found) == [
        (1, 100.0, True), (1, 101.0, True), (1, 102.0, False), (1, 30.0 * day, True), (1, 30.0 * day + 1, True), (2, 105.0, True), (3, 60.0 * day, True), (3, 60.0 * day + 5, True)]
    state = spark.read.format("statestore").option("stateVarName", "passed").load(f"{place}/checkpoint")
    assert {r["key"]["key"] for r in state.select("key").collect()} == {3}


def test_the_stream_scores_as_the_batch_does(spark, sf):
    got = {r["restriction_id"]: r for r in QUERIES["j2_model_messages"](spark, sf).collect()}
    rows = view(spark, sf, "fx_restrictions")
    path = fresh_path(spark, f"model-{uuid.uuid4().hex}")
    model.training_job(rows, path, logistic=True)
    want = model.predict(model.load(spark, path)[0], model.features(rows)).select("restriction_id", "prediction", "confidence").collect()
    assert len(got) == len(want) > 0
    for r in want:
        assert got[r["restriction_id"]]["impact"] == r["prediction"] and got[r["restriction_id"]]["confidence"] == pytest.approx(r["confidence"], abs=1e-6)


def test_a_poll_within_the_interval_writes_nothing(spark):
    folder, place = fresh_path(spark, "polls-in"), fresh_path(spark, "polls")
    # (source, hash, second); a source's unchanged payload counts as a poll, one that came too soon does not
    files = [[("a", "h1", 1000), ("a", "h2", 1030), ("b", "h1", 1000)], [("a", "h3", 1059), ("b", "h1", 1060)], [("a", "h4", 1061), ("b", "h2", 1119), (None, "h9", 5000)], [("b", "h5", 1120), ("a", "h6", 1100)]]
    found = []
    for rows in files:
        spark.createDataFrame(rows, "source string, sha256 string, s long").selectExpr("source", "sha256", "timestamp_seconds(s) as at").coalesce(1).write.mode("append").parquet(f"{folder}/polls.parquet")
        found = feeds.ingest_snapshots(feeds.read_stream(spark, folder, "polls", files=1), place=place, at="at", interval_s=60.0).collect()
    assert sorted((r["source"], r["sha256"]) for r in found) == [("a", "h1"), ("a", "h4"), ("b", "h1"), ("b", "h5")]
