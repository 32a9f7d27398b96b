import datetime as dt
import random
import time

from pyspark.sql import functions as F

from trailhead.operators import feedback, reporting
from trailhead.streaming import attribution, daily, debounce, ingest, sinks

T0 = dt.datetime(2024, 5, 1)


def drained(spark, query):
    query.processAllAvailable()
    query.stop()


LOG = "repo string, path string, seq long, event_time timestamp, action string, bundle_id string"


def attributed(spark, tmp_path, rows, parts, late_seconds):
    """What the stream gives for the log's parts as so many micro-batches, and what the batch form gives for all of it."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = spark.readStream.schema(LOG).parquet(str(src))
    found = attribution.attribute_stream(stream.where("bundle_id is null"), stream.where("bundle_id is not null"), 1800, 20, late_seconds)
    query = sinks.write_batches(found, out, str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"})
    tick = [(None, None, None, T0 + dt.timedelta(days=9), None, None)]
    for part in [*parts, tick]:   # an order between files needs one file at a time
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(src))
        query.processAllAvailable()
    query.stop()
    table = spark.createDataFrame(rows, LOG)
    batch = feedback.attribute(table.where("bundle_id is null").withColumn("event_type", F.lit("tool_use")), table.where("bundle_id is not null"), 1800, 20)
    names = ["repo", "path", "seq", "event_time", "action", "bundle_id"]
    return [sorted(map(tuple, df.select(*names).collect()), key=str) for df in (spark.read.parquet(out), batch)]


def feedback_log(n=120):
    rows = []
    for i in range(n):
        shown = i % 3 == 0
        rows.append(("r", "hot" if i % 2 else f"p{i % 5}", i, T0 + dt.timedelta(seconds=60 * i), None if shown else "Edit", f"b{i}" if shown else None))
    return rows


def test_attribution_over_several_batches_equals_batch(spark, tmp_path):
    rows = feedback_log()
    got, want = attributed(spark, tmp_path, rows, [rows[:40], rows[40:80], rows[80:]], None)
    assert got == want and any(r[-1] for r in got)


def test_attribution_of_rows_that_arrive_out_of_order_equals_batch(spark, tmp_path):
    rows = feedback_log()
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    late = [r for r in mixed if r[-1] is None], [r for r in mixed if r[-1] is not None]      # all bundles after all uses
    got, want = attributed(spark, tmp_path, rows, [late[0][:50], late[0][50:], late[1][:9], late[1][9:]], 60 * 120)
    assert got == want and any(r[-1] for r in got)


def test_debounce_releases_by_count_and_keeps_the_rest(spark, tmp_path):
    now = dt.datetime.fromtimestamp(time.time())
    rows = [("a", f"p{i % 12}", now + dt.timedelta(milliseconds=i)) for i in range(12)] + [("b", "x", now), ("c", "old", now - dt.timedelta(hours=1)), ("c", "old", now - dt.timedelta(hours=2))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "repo string, path string, queued_at timestamp").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("repo string, path string, queued_at timestamp").parquet(src)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        drained(spark, sinks.write_batches(debounce.debounce_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"}))
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = [(r.repo, r.path, r.trigger) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted([("a", f"p{i}", "count") for i in range(10)] + [("c", "old", "age")])
    kept = debounce.drop_vanished(spark.createDataFrame([("a", "p0"), ("a", "p1")], "repo string, path string"), spark.createDataFrame([("a", "p1")], "repo string, path string"))
    assert [r.path for r in kept.collect()] == ["p1"]


def test_daily_and_queue_state(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(T0 + dt.timedelta(hours=h),) for h in range(60)], "event_time timestamp").write.parquet(src)
    stream = spark.readStream.schema("event_time timestamp").parquet(src)
    sinks.write_batches(daily.daily_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "update").awaitTermination()
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [12, 24, 24]
    queue = spark.createDataFrame([("r", "a", T0, 0), ("r", "b", T0 + dt.timedelta(seconds=5), 1), ("r", "a", T0 + dt.timedelta(seconds=9), 2)], "repo string, path string, queued_at timestamp, seq int")
    status = debounce.pending_status(queue, F.lit(T0 + dt.timedelta(seconds=20))).first()
    assert (status["count"], status.oldest_age_seconds, status.paths) == (2, 15.0, ["b", "a"])


def test_ingest_stream_equals_batch(spark, tmp_path):
    lines = ['{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b"}', "{bad", "[1]"]
    rows = spark.createDataFrame([(i // 3, i, lines[i % 3]) for i in range(12)], "batch_id int, seq int, raw string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    ingest.ingest_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    want = reporting.ingest(rows)
    for name in ("results", "reasons"):
        cols = want[name].columns
        assert sorted(map(tuple, spark.read.parquet(f"{out}/{name}").select(*cols).collect()), key=str) == sorted(map(tuple, want[name].collect()), key=str)
    assert spark.read.parquet(f"{out}/accepted").count() == 4 and spark.read.parquet(f"{out}/quarantine").count() == 8


def uploads(lines_of):
    line = '{"schema_version":1,"event_type":"x","event_time":"t","install_id":"i","channel":"stable","build_id":"b"}'
    return [(b, i, line if x == "ok" else x, T0 + dt.timedelta(seconds=s)) for i, (b, x, s) in enumerate(lines_of)]


def test_uploads_split_over_files_are_judged_whole(spark, tmp_path):
    parts = [
        uploads([("a", "ok", 0), ("a", "ok", 1), ("b", "ok", 2), ("c", " ", 3), ("d", "{bad", 4)]),
        uploads([("a", "ok", 20), ("b", "[1]", 21), ("d", "ok", 22)]),
        uploads([("a", "ok", 40), ("d", "x" * 600, 41), ("e", "ok", 42), (None, "", 4000)]),
    ]
    parts = [[(b, 100 * p + i, raw, t) for b, i, raw, t in part] for p, part in enumerate(parts)]
    schema = "batch_id string, seq long, raw string, received_at timestamp"
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(src))
    limits = {"max_events": 2, "max_bytes": 600}
    query = ingest.ingest_stream(stream, out, str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"}, **limits)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        query.processAllAvailable()
    query.stop()
    want = reporting.ingest(spark.createDataFrame([r[:3] for part in parts for r in part if r[0]], "batch_id string, seq long, raw string"), **limits)
    for name in ("results", "reasons", "accepted", "quarantine"):
        cols = want[name].columns
        got = spark.read.parquet(f"{out}/{name}").select(*cols)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want[name].collect()), key=str), name
    errors = {r.batch_id: r.error for r in spark.read.parquet(f"{out}/results").collect()}
    assert errors == {"a": "too_many_events", "b": None, "c": "empty_body", "d": "payload_too_large", "e": None}


def test_attribution_keeps_one_state_a_block_of_the_log_whatever_the_paths(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("r", f"p{i % 10}", i, T0 + dt.timedelta(seconds=i), None if i < 10 else "Edit", f"b{i}" if i < 10 else None) for i in range(20)]
    tick = [(None, None, None, T0 + dt.timedelta(days=9), None, None)]
    spark.createDataFrame(rows + tick, LOG).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(LOG).parquet(str(src))
    found = attribution.attribute_stream(stream.where("bundle_id is null"), stream.where("bundle_id is not null"), 1800, 20)
    out = str(tmp_path / "out")
    query = sinks.write_batches(found, out, str(tmp_path / "cp"), trigger={"processingTime": "0 seconds"})
    query.processAllAvailable()
    kept = max(p["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress)
    query.stop()
    assert {(r.path, r.bundle_id) for r in spark.read.parquet(out).collect()} == {(f"p{i}", f"b{i}") for i in range(10)}
    assert 0 < kept <= 3
