"""J: streaming jobs, run to the end of what is there."""

from pyspark.sql import functions as F

from kerbline.operators.summaries import BASELINE
from kerbline.plans import model
from kerbline.plans.checkpoint import fresh_path
from kerbline.queries.registry import Registry, table, view
from kerbline.streaming import feeds

reg = Registry()
c = F.col

_SQL_LABEL = "case event_type when 'error' then 'High' when 'purchase' then 'Low' else 'None' end"


def _predictions(spark, d):
    s = feeds.read_stream(spark, d, "events")
    label = F.when(c("event_type") == "error", "High").when(c("event_type") == "purchase", "Low").otherwise("None")
    return s.select("event_id", "ts", "user_id", label.alias("prediction"), F.least(F.lit(1.0), c("value") / 500.0).alias("confidence"))


@reg.add("j1_snapshot_ingest", "select distinct o_custkey as source, sha256(o_orderpriority) as sha256 from orders")
def j1(spark, d):
    s = feeds.read_stream(spark, d, "orders").select(c("o_custkey").alias("source"), F.sha2("o_orderpriority", 256).alias("sha256"))
    return feeds.ingest_snapshots(s)


@reg.add("j1_interval_ingest")
def j1i(spark, d):
    """Polls of each source count once in 90 days."""
    s = feeds.read_stream(spark, d, "orders").select(c("o_custkey").alias("source"), F.sha2("o_orderpriority", 256).alias("sha256"), c("o_orderdate").cast("timestamp").alias("at"))
    return feeds.ingest_snapshots(s, at="at", interval_s=90 * 86400.0).select("source", "sha256")


@reg.add("j2_scored_messages", "select 'prediction' as type, o_orderkey as restriction_id, case when o_totalprice > 250000 then 'High' else 'Low' end as impact, 0.5e0 as confidence from orders")
def j2(spark, d):
    s = feeds.read_stream(spark, d, "orders").withColumnRenamed("o_orderkey", "restriction_id")
    rule = lambda df: df.withColumns({"prediction": F.when(c("o_totalprice") > 250000, "High").otherwise("Low"), "confidence": F.lit(0.5)})
    return feeds.run_to_table(feeds.scored(s, rule), "messages").drop("_batch")


@reg.add("j2_model_messages")
def j2m(spark, d):
    """A saved model over the feed's new restrictions, as the stream brings them."""
    rows = view(spark, d, "fx_restrictions")
    path = fresh_path(spark, "model")
    model.training_job(rows, path, logistic=True)
    feed = feeds.read_stream(spark, d, "orders").select("o_orderkey")
    return feeds.scored_by_model(feed, path, lambda batch: rows.join(batch, rows["k"] == F.col("o_orderkey"), "left_semi"))


@reg.add("j3_batch_status", "select 'ok' as status, count(*) as rows from events")
def j3(spark, d):
    return feeds.batch_status(feeds.read_stream(spark, d, "events")).groupBy("status").agg(F.sum("rows").alias("rows"))


_WINDOWS = f"select date_trunc('day', ts) as start, {_SQL_LABEL} as prediction, count(*) as n from events group by all"


@reg.add("j4_label_windows", f"select start, prediction, n from ({_WINDOWS})")
def j4(spark, d):
    return _windows(spark, d).withColumn("start", c("start").cast("timestamp_ntz"))


def _windows(spark, d):
    w = feeds.label_windows(_predictions(spark, d))
    return feeds.latest_version(feeds.run_to_table(w, "windows", "update"), ["start", "prediction"])


@reg.add("j4_drift_alerts", f"with w as ({_WINDOWS}), q as (select *, n / sum(n) over (partition by start) as q from w), b(prediction, p) as (values ('None', 0.78e0), ('Low', 0.13e0), ('High', 0.09e0)) select start, round(sum(0.5e0 * (p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2)))), 9) as magnitude from q join b using (prediction) group by start")
def j4b(spark, d):
    out = feeds.drift_by_window(_windows(spark, d), BASELINE)
    return out.select(c("start").cast("timestamp_ntz").alias("start"), F.round("magnitude", 9).alias("magnitude"))


@reg.add("j5_recent_buffer", "select event_id, event_type from events order by ts desc, event_id desc limit 100")
def j5(spark, d):
    return feeds.recent_buffer(feeds.read_stream(spark, d, "events").select("event_id", "ts", "event_type")).select("event_id", "event_type")


@reg.add("j6_burst_flags")
def j6(spark, d):
    return feeds.burst_flags(table(spark, d, "events"), "user_id", "ts", limit=3, window_s=86400.0)


@reg.add("j6_burst_stream")
def j6s(spark, d):
    s = feeds.burst_stream(feeds.read_stream(spark, d, "events", files=8), "user_id", "ts", limit=3, window_s=86400.0)
    return feeds.run_to_table(s, "bursts").drop("_batch")


@reg.add("j7_prediction_feed", "with n as (select * from fx_predictions order by ts desc, event_id desc limit 20) select event_id, prediction, n_name as name from n left join nation on n_nationkey = user_id % 25")
def j7(spark, d):
    log = _predictions(spark, d).withColumn("district", (c("user_id") % 25).cast("int"))
    places = table(spark, d, "nation").select(c("n_nationkey").cast("int").alias("district"), c("n_name").alias("name"))
    return feeds.prediction_feed(log, places).select("event_id", "prediction", "name")
