"""Streaming operators, run once over everything available and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..streaming import attribution, daily, debounce, ingest, sinks
from .registry import fresh_dir, query
from .views import view


def _streaming_settings(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Run over what is there and stop: without this, wall-clock timers keep asking for further empty batches.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    if spark.sparkContext.master.startswith("local"):   # micro-batches are not adaptive: one state store per core is enough
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))


def _closing_batches(spark) -> None:
    """Let event-time timers run once more after the last rows."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")


def _stream(spark, rows: DataFrame, label: str) -> DataFrame:
    """A file stream over ``rows``, read in one micro-batch: files written together carry no order between them."""
    _streaming_settings(spark)
    out = fresh_dir(spark, label)
    rows.write.parquet(out)
    return spark.readStream.schema(rows.schema).parquet(out)


def _collected(spark, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    out, checkpoint = fresh_dir(spark, f"{label}-out"), fresh_dir(spark, f"{label}-checkpoint")
    sinks.write_batches(stream, out, checkpoint, mode).awaitTermination()
    return spark.read.parquet(out)


@query("j1_ingest_stream", "SELECT batch_id, expected_reason AS reason, count(*) AS n FROM v_payload WHERE expected_reason IS NOT NULL GROUP BY ALL")
def ingest_stream(spark, sf):
    # Uploads are spread over files and micro-batches; the last file's tick closes those that are still open.
    rows = view(spark, sf, "v_payload").select("batch_id", "seq", "raw", F.timestamp_seconds(F.lit(86_400)).alias("received_at"))
    _streaming_settings(spark)
    source = fresh_dir(spark, "uploads")
    rows.repartition(max(3, spark.sparkContext.defaultParallelism), "seq").write.parquet(source)
    tick = rows.limit(1).select(F.lit(None).cast(rows.schema["batch_id"].dataType).alias("batch_id"), "seq", "raw", F.timestamp_seconds(F.lit(90_000)).alias("received_at"))
    tick.write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    out = fresh_dir(spark, "ingest-out")
    _closing_batches(spark)
    ingest.ingest_stream(stream, out, fresh_dir(spark, "ingest-checkpoint")).awaitTermination()
    return spark.read.parquet(f"{out}/reasons").select("batch_id", "reason", "n")


@query("j2_attribute_stream", """
WITH u AS (SELECT seq, event_time, path, action FROM v_feedback WHERE event_type = 'tool_use' AND path IS NOT NULL),
m AS (SELECT u.seq, max(r.seq) AS hit FROM u JOIN v_ranked r ON r.path = u.path AND r.seq < u.seq AND r.seq >= u.seq - 200
  AND date_trunc('second', r.event_time) >= date_trunc('second', u.event_time - INTERVAL 6 HOUR) GROUP BY u.seq)
SELECT u.seq, path, action, 'b' || hit AS bundle_id FROM u LEFT JOIN m USING (seq)""")
def attribute_stream(spark, sf):
    uses = view(spark, sf, "v_feedback").where("event_type = 'tool_use' and path is not null").select(
        "repo", "path", "seq", "event_time", "action")
    shown = view(spark, sf, "v_ranked").select("repo", "path", "seq", "event_time", "bundle_id")
    rows = uses.unionByName(shown, allowMissingColumns=True)
    # A tick a day behind the last row lets the last uses out.
    tick = rows.agg((F.max("event_time") + F.expr("interval 1 day")).alias("event_time"))
    log = _stream(spark, rows.unionByName(tick, allowMissingColumns=True), "log")
    _closing_batches(spark)
    found = attribution.attribute_stream(log.where("bundle_id is null"), log.where("bundle_id is not null"), 6 * 3600)
    return _collected(spark, found, "attribution").select("seq", "path", "action", "bundle_id")


@query("j3_debounce_stream")
def debounce_stream(spark, sf):
    updates = view(spark, sf, "v_telemetry").select(
        F.col("repo_hash").alias("repo"), F.col("task_id").alias("path"), F.col("event_time").alias("queued_at"), "seq")
    released = debounce.debounce_stream(_stream(spark, updates, "updates"))
    return _collected(spark, released, "debounce").groupBy("repo", "path").agg(F.max("queued_at").alias("queued_at"))


@query("j6_daily_stream", "SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS count FROM v_telemetry GROUP BY 1")
def daily_stream(spark, sf):
    stream = daily.daily_stream(_stream(spark, view(spark, sf, "v_telemetry").select("seq", "event_time"), "telemetry"))
    counts = _collected(spark, stream, "daily", "update")
    return counts.groupBy(F.col("date").cast("string").alias("date")).agg(F.max_by("count", "micro_batch").alias("count"))
