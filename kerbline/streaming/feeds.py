"""Structured Streaming jobs over the restriction feed and the prediction log.

Each job reads a stream DataFrame and ends by itself with the ``availableNow`` trigger unless another is given.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from kerbline.plans.checkpoint import cut, fresh_path


def read_stream(spark: SparkSession, path: str, name: str, files: int | None = None) -> DataFrame:
    """The Parquet table ``name`` below ``path`` as a stream of its files, up to ``files`` of them at a time."""
    schema = spark.read.parquet(f"{path}/{name}.parquet").schema
    reader = spark.readStream if files is None else spark.readStream.option("maxFilesPerTrigger", files)
    return reader.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{path}/{name}*")


def _folders(spark: SparkSession, name: str, place: str | None) -> tuple[str, str]:
    """Where a job has its table and its checkpoint: below ``place``, where a restarted job goes on, or else below a new path."""
    place = place or fresh_path(spark, name)
    return f"{place}/table", f"{place}/checkpoint"


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger) -> None:
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()


def _start(spark: SparkSession, schema, out: str) -> None:
    """The table of batches, with an empty batch -1 so that it can always be read."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/_batch=-1")


def _keep(batch: DataFrame, out: str, number: int) -> None:
    """A batch has a folder of its own, so that one that runs again after a failure replaces what it had written."""
    batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", place: str | None = None, **trigger) -> DataFrame:
    """Run the stream into a Parquet table in the shared folder and return the table, with the batch of each row in ``_batch``."""
    spark = stream.sparkSession
    out, checkpoint = _folders(spark, name, place)
    _start(spark, stream.schema, out)
    _run(stream, lambda batch, number: _keep(batch, out, number), checkpoint, mode, **trigger)
    return spark.read.parquet(out)


def ingest_snapshots(stream: DataFrame, key: str = "source", sha: str = "sha256", place: str | None = None, at: str | None = None, interval_s: float | None = None) -> DataFrame:
    """Append each payload whose hash its source has not had yet; the manifest table is the state.

    With ``at`` (a poll's time) and ``interval_s`` a poll counts only if that long has passed since the last one of its source that counted;
    others write nothing. Polls that counted are a table beside the manifest, changed payload or not; those without source or time don't count.
    """
    spark = stream.sparkSession
    out, checkpoint = _folders(spark, "manifest", place)
    polls = f"{out}-polls"
    _start(spark, stream.schema, out)
    if at is not None:
        _start(spark, "poll_key long, poll_at double", polls)

    def due(batch: DataFrame, number: int) -> DataFrame:
        timed = batch.withColumns({"poll_key": F.xxhash64(key), "poll_at": F.unix_micros(F.col(at).cast("timestamp")) / 1e6}).where(F.col(key).isNotNull() & F.col(at).isNotNull())
        last = spark.read.parquet(polls).where(F.col("_batch") < number).groupBy("poll_key").agg(F.max("poll_at").alias("poll_at"))
        every = timed.select("poll_key", "poll_at").unionByName(last).select("poll_key", F.timestamp_micros((F.col("poll_at") * 1e6).cast("long")).alias("t"))
        counted = cut(burst_flags(every.distinct(), "poll_key", "t", 1, interval_s).where("accepted").select(F.col("key").alias("_ck"), F.col("at").alias("_ct")))
        found = cut(timed.join(counted, (F.col("poll_key") == F.col("_ck")) & (F.col("poll_at") == F.col("_ct")), "left_semi").join(last.select(F.col("poll_key").alias("_k"), F.col("poll_at").alias("_before")), F.col("poll_key") == F.col("_k"), "left"))
        found = found.where("_before is null or poll_at > _before").drop("_k", "_before")
        _keep(found.select("poll_key", "poll_at").distinct(), polls, number)
        return found.drop("poll_key", "poll_at")

    def write(batch: DataFrame, number: int) -> None:
        seen = spark.read.parquet(out).where(F.col("_batch") < number).select(key, sha).distinct()
        new = batch if at is None else due(batch, number)
        _keep(new.dropDuplicates([key, sha]).join(seen, [key, sha], "left_anti"), out, number)

    _run(stream, write, checkpoint)
    return spark.read.parquet(out).drop("_batch")


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Messages (type, restriction_id, impact, confidence) of each new restriction; ``score`` adds prediction and confidence."""
    s = score(stream)
    return s.select(F.lit("prediction").alias("type"), "restriction_id", F.col("prediction").alias("impact"), "confidence")


def scored_by_model(stream: DataFrame, path: str, prepare: Callable[[DataFrame], DataFrame], place: str | None = None) -> DataFrame:
    """Messages (type, restriction_id, impact, confidence) of each new restriction by the model saved at ``path``, which is loaded once; ``prepare``
    makes a batch's restrictions. Label and confidence are the model's; a restriction that lacks a feature has no message."""
    from kerbline.plans import model

    spark = stream.sparkSession
    out, checkpoint = _folders(spark, "messages", place)
    fitted, _ = model.load(spark, path)
    key = dict(prepare(spark.createDataFrame([], stream.schema)).dtypes)["restriction_id"]
    _start(spark, f"type string, restriction_id {key}, impact string, confidence double", out)

    def write(batch: DataFrame, number: int) -> None:
        _keep(scored(prepare(batch), lambda rows: model.predict(fitted, model.features(rows))), out, number)

    _run(stream, write, checkpoint)
    return spark.read.parquet(out).drop("_batch")


def batch_status(stream: DataFrame, place: str | None = None) -> DataFrame:
    """(batch, status, rows): one row for each batch; an error becomes a row too."""
    spark = stream.sparkSession
    out, checkpoint = _folders(spark, "status", place)
    schema = "batch long, status string, rows long"
    _start(spark, schema, out)

    def write(batch: DataFrame, number: int) -> None:
        try:
            n, status = batch.count(), "ok"
        except Exception as e:
            n, status = 0, f"error: {type(e).__name__}"
        _keep(spark.createDataFrame([(number, status, n)], schema), out, number)

    _run(stream, write, checkpoint)
    return spark.read.parquet(out).drop("_batch")


def label_windows(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of each label in tumbling windows of the event time; rows later than the watermark are dropped."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "prediction").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "prediction", "n")


def drift_by_window(counts: DataFrame, baseline: dict[str, float], threshold: float = 0.1) -> DataFrame:
    """(start, magnitude, drifted) per window, over labels that both the window and the baseline have."""
    q = F.col("n") / F.sum("n").over(Window.partitionBy("start"))
    known = F.create_map(*[F.lit(x) for kv in baseline.items() for x in kv])
    rows = counts.withColumns({"q": q, "p": F.try_element_at(known, F.col("prediction"))}).where("p > 0 and q > 0")
    m = (F.col("p") + F.col("q")) / 2
    term = 0.5 * (F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m))
    return rows.groupBy("start").agg(F.sum(term).alias("magnitude")).withColumn("drifted", F.col("magnitude") > threshold)


def latest_version(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that update mode wrote again and again, those of the last batch for each key."""
    last = updates.groupBy(*keys).agg(F.max(F.struct("_batch", *[c for c in updates.columns if c not in (*keys, "_batch")])).alias("l"))
    return last.select(*keys, "l.*").drop("_batch")


def recent_buffer(stream: DataFrame, n: int = 100, place: str | None = None) -> DataFrame:
    """The newest ``n`` messages (ts, event_id, ...) after the last batch. A batch's table has the newest of the one before and its own, so
    what there is of the buffer is in the shared folder alone."""
    spark = stream.sparkSession
    out, checkpoint = _folders(spark, "buffer", place)
    _start(spark, stream.schema, out)

    def write(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(out).where(F.col("_batch") == number - 1).drop("_batch")
        _keep(before.unionByName(batch).orderBy(F.desc("ts"), F.desc("event_id")).limit(n), out, number)

    _run(stream, write, checkpoint)
    table = spark.read.parquet(out)
    last = table.agg(F.max("_batch").alias("last"))
    return table.join(F.broadcast(last), F.col("_batch") == F.col("last"), "left_semi").drop("_batch")  # one row


def _accept(times: np.ndarray, passed: deque, limit: int, window_s: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a key's events in order, which pass and how long the others must wait; ``passed`` has the last ``limit`` times that passed, and goes on."""
    accepted, wait = np.ones(len(times), bool), np.zeros(len(times))
    for i, at in enumerate(times.tolist()):
        while passed and passed[0] <= at - window_s:
            passed.popleft()
        if len(passed) < limit:
            passed.append(at)
        else:
            accepted[i], wait[i] = False, passed[0] + window_s - at
    return accepted, wait


def _sessions(rows: DataFrame, window_s: float) -> DataFrame:
    """Rows (key, at) with ``start``, the first time of their session: a key's events with no gap of ``window_s`` between them.

    The rows are dealt by ranges of (key, at), so that a key, however frequent, goes to many tasks. What tells whether a range goes on
    with the session of the one before is a row for each range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_at, start, lead = None, None, None, True
        for batch in batches:
            key, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (at[1:] - at[:-1] >= window_s)
            if last_key is not None:
                new[0] = key[0] != last_key or at[0] - last_at >= window_s
            begun = np.where(new, np.arange(len(key)), -1)
            begun = np.maximum.accumulate(begun)
            starts = np.where(begun < 0, np.nan if start is None else start, at[np.maximum(begun, 0)])
            first = last_key is None
            leads = np.cumsum(new) == (1 if first else 0) if lead else np.zeros(len(key), bool)
            last_key, last_at, start, lead = key[-1], at[-1], starts[-1], bool(leads[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(starts), pa.array(leads)], ["part", "key", "at", "start", "lead"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "key", "at").sortWithinPartitions("key", "at").select(F.spark_partition_id().alias("part"), "key", "at")
    marked = cut(ranged.mapInArrow(run, "part int, key long, at double, start double, lead boolean"))
    ends = marked.groupBy("part").agg(F.min(F.struct("key", "at")).alias("first"), F.max(F.struct("key", "at", "start", "lead")).alias("last"))
    parts = Window.orderBy("part")  # a row for each range
    before = F.lag("last").over(parts)
    goes_on = F.coalesce((before["key"] == F.col("first.key")) & (F.col("first.at") - before["at"] < window_s), F.lit(False))
    known = F.when(~F.col("last.lead"), F.col("last.start")).when(~F.col("goes_on"), F.col("first.at"))
    ends = ends.withColumn("goes_on", goes_on).withColumn("known", F.last(known, ignorenulls=True).over(parts))
    ends = ends.withColumn("lead_start", F.when(F.col("goes_on"), F.lag("known").over(parts)).otherwise(F.col("first.at"))).select("part", "lead_start")
    return marked.join(F.broadcast(ends), "part").select("key", "at", F.when(F.col("lead"), F.col("lead_start")).otherwise(F.col("start")).alias("start"))


_FLAGS = "key long, at double, accepted boolean, retry_after_s double"


def burst_flags(events: DataFrame, key: str, ts: str, limit: int = 240, window_s: float = 60.0) -> DataFrame:
    """(key, at, accepted, retry_after_s): an event passes if fewer than ``limit`` passed in the trailing window of its key.

    Which events count depends on those before, so events are gone through in order; but after a gap of ``window_s`` nothing before
    counts, so a key is cut into sessions there, which are dealt out. A task has the last ``limit`` times of one session at hand. Rows
    without a key or a time are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, passed = None, deque()
        for batch in batches:
            key, at, start = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1])]))
            accepted, wait = np.ones(len(key), bool), np.zeros(len(key))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)]):
                if (key[a], start[a]) != current:
                    current, passed = (key[a], start[a]), deque()
                accepted[a:b], wait[a:b] = _accept(at[a:b], passed, limit, window_s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(accepted), pa.array(wait)], ["key", "at", "accepted", "retry_after_s"])

    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _timed(events, key, ts)
    return _sessions(rows, window_s).repartition(n, "key", "start").sortWithinPartitions("key", "start", "at").mapInArrow(run, _FLAGS)


def _timed(events: DataFrame, key: str, ts: str) -> DataFrame:
    rows = events.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"))
    return rows.where("key is not null and at is not null")


class _Bursts(StatefulProcessor):
    """Which of a key's events pass. Its state is a list of the last times that passed, and goes when the watermark has passed the window."""

    def __init__(self, limit: int, window_s: float):
        self.limit, self.window_s = limit, window_s

    def init(self, handle) -> None:
        self.handle = handle
        self.passed = handle.getListState("passed", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = deque(x[0] for x in self.passed.get())
        last = passed[-1] if passed else None
        for frame in rows:  # a frame has a bounded number of rows, and no more are held
            at = np.sort(frame["at"].to_numpy(), kind="stable")
            accepted, wait = _accept(at, passed, self.limit, self.window_s)
            last = float(at[-1]) if last is None else max(last, float(at[-1]))
            yield pd.DataFrame({"key": key[0], "at": at, "accepted": accepted, "retry_after_s": wait})
        self.passed.put([(float(x),) for x in passed])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(int((last + self.window_s) * 1000) + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "at": pd.Series([], dtype="float64"), "accepted": pd.Series([], dtype="bool"), "retry_after_s": pd.Series([], dtype="float64")})

    def close(self) -> None:
        pass


def burst_stream(stream: DataFrame, key: str, ts: str, limit: int = 240, window_s: float = 60.0, late: str = "1 day") -> DataFrame:
    """burst_flags of a stream: each key's state has the last ``limit`` times that passed, and a timer that removes it when the watermark, ``late``
    behind the newest event, has passed the key's window. Events older than the watermark are left out.

    A key's events of a batch come in frames of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows; those of a frame are taken in order, frames
    and batches as they come. The source's ``maxFilesPerTrigger`` bounds a batch.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = _timed(stream, key, ts).withColumn("time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(_Bursts(limit, window_s), _FLAGS, "Append", "eventTime")


def prediction_feed(log: DataFrame, places: DataFrame, n: int = 20, place: str | None = None) -> DataFrame:
    """The newest ``n`` predictions of the stream ``log`` with their district's place; ``places`` is static."""
    return recent_buffer(log.join(places, "district", "left"), n, place)
