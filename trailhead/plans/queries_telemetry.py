"""Telemetry, experiments, transcripts, reporting and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import reporting, telemetry
from ..operators.skew import spread
from ..streaming import debounce
from .registry import query
from .views import view


def _pct(value: str, where: str = "TRUE") -> str:
    """DuckDB: p50, p95, max and n of a value list in one group."""
    v = f"list_sort(list({value}) FILTER ({where}))"
    return f"""coalesce(CAST(trunc(list_median({v})) AS BIGINT), 0)""", f"""coalesce({v}[CAST(greatest(0, floor(len({v}) * 0.95) - 1) AS BIGINT) + 1], 0)""", \
        f"coalesce(list_max({v}), 0)", f"coalesce(len({v}), 0)"


def _pcts(prefix: str, value: str, where: str = "TRUE") -> str:
    return ", ".join(f"{sql} AS {prefix}_{name}" for sql, name in zip(_pct(value, where), ("p50", "p95", "max", "n")))


def _flat(name: str, prefix: str) -> list:
    return [F.col(f"{name}.{f}").alias(f"{prefix}_{f}") for f in ("p50", "p95", "max", "n")]


_NOW = "(SELECT max(event_time) FROM v_telemetry)"


def _now(spark, sf):
    return view(spark, sf, "v_telemetry").agg(F.max("event_time")).scalar()


@query("h1_filter_events", f"SELECT seq, repo_hash FROM v_telemetry WHERE event_time >= {_NOW} - INTERVAL 7 DAY AND repo_hash = 'repo3'")
def filter_events(spark, sf):
    rows = telemetry.filter_events(view(spark, sf, "v_telemetry"), _now(spark, sf), days=7, repo_hash="repo3")
    return rows.select("seq", "repo_hash")


@query("h2_op_summary", f"""
SELECT op, count(*) AS count, count(*) FILTER (success) AS success_count, round_even(count(*) FILTER (success) / count(*), 3)::DOUBLE AS success_rate,
  {_pcts('d', 'duration_ms', 'duration_ms > 0')}, {_pcts('b', 'output_bytes')} FROM v_telemetry GROUP BY op""")
def op_summary(spark, sf):
    return telemetry.op_summary(view(spark, sf, "v_telemetry")).select(
        "op", "count", "success_count", "success_rate", *_flat("duration_ms", "d"), *_flat("output_bytes", "b"))


@query("h3_percentiles", f"SELECT repo_hash, {_pcts('v', 'duration_ms')} FROM v_telemetry GROUP BY repo_hash")
def percentiles(spark, sf):
    rows = telemetry.percentile_columns(view(spark, sf, "v_telemetry"), ["repo_hash"], ["duration_ms"])
    return rows.select("repo_hash", *_flat("duration_ms", "v"))


@query("h4_daily", "SELECT strftime(event_time, '%Y-%m-%d') AS date, count(*) AS count FROM v_telemetry GROUP BY 1")
def daily(spark, sf):
    return telemetry.daily(view(spark, sf, "v_telemetry")).select(F.col("date").cast("string").alias("date"), "count")


@query("h5_top_repos", "SELECT repo_hash, count(*) AS count FROM v_telemetry GROUP BY 1 ORDER BY 2 DESC, min(seq) LIMIT 5")
def top_repos(spark, sf):
    return telemetry.top_values(view(spark, sf, "v_telemetry"), "repo_hash", 5)


@query("h5_surfaces", "SELECT surface, count(*) AS count FROM v_telemetry GROUP BY 1")
def surfaces(spark, sf):
    return telemetry.top_values(view(spark, sf, "v_telemetry"), "surface")


@query("h6_recent_errors", "SELECT seq, op, error_type FROM v_telemetry WHERE NOT success AND error_type <> '' ORDER BY seq DESC LIMIT 10")
def recent_errors(spark, sf):
    return telemetry.recent_errors(view(spark, sf, "v_telemetry")).select("seq", "op", "error_type")


_BUILDS = ["duration_ms", "embed_ms", "output_bytes"]


@query("h7_index_builds", " UNION ALL ".join(f"""
SELECT '{c}' AS metric, count(*) AS count, count(*) FILTER (success) AS success_count,
  {', '.join(f"{sql} AS {n}" for sql, n in zip(_pct(c, f'{c} IS NOT NULL'), ('p50', 'p95', 'max', 'n')))} FROM v_telemetry WHERE event_type = 'index_build'""" for c in _BUILDS))
def index_builds(spark, sf):
    return telemetry.index_builds(view(spark, sf, "v_telemetry"), _BUILDS)


@query("h8_stats", f"""
WITH w AS (SELECT * FROM v_telemetry WHERE event_time >= {_NOW} - INTERVAL 30 DAY)
SELECT 'total' AS part, '' AS key, count(*) AS count FROM w UNION ALL SELECT 'op', op, count(*) FROM w GROUP BY op
UNION ALL SELECT 'day', strftime(event_time, '%Y-%m-%d'), count(*) FROM w GROUP BY 2 UNION ALL SELECT 'surface', surface, count(*) FROM w GROUP BY 2""")
def stats(spark, sf):
    digest = telemetry.stats(view(spark, sf, "v_telemetry"), _now(spark, sf))
    parts = [("total", "total_events", F.lit(""), "total_events"), ("op", "by_op", F.col("op"), "count"),
             ("day", "daily_activity", F.col("date").cast("string"), "count"), ("surface", "surface_breakdown", F.col("surface"), "count")]
    out = None
    for name, frame, key, count in parts:
        rows = digest[frame].select(F.lit(name).alias("part"), key.alias("key"), F.col(count).alias("count"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("h9_experiments", """
SELECT session_id, max_by(cost_after - cost_before, seq) FILTER (lane = 'control')::DOUBLE AS control,
  max_by(cost_after - cost_before, seq) FILTER (lane = 'treatment')::DOUBLE AS treatment FROM v_experiments GROUP BY session_id""")
def experiments(spark, sf):
    rows = telemetry.experiments(telemetry.lane_costs(view(spark, sf, "v_experiments")))
    return rows.select("session_id", F.col("control").cast("double").alias("control"), F.col("treatment").cast("double").alias("treatment"))


@query("h10_lane_costs", "SELECT seq, (cost_after - cost_before)::DOUBLE AS cost_delta FROM v_experiments WHERE cost_before >= 0 AND cost_after >= cost_before")
def lane_costs(spark, sf):
    return telemetry.lane_costs(view(spark, sf, "v_experiments")).select("seq", F.col("cost_delta").cast("double").alias("cost_delta"))


@query("h11_experiment_summary", """
WITH p AS (SELECT session_id, max_by(cost_after - cost_before, seq) FILTER (lane = 'control') AS c, max_by(cost_after - cost_before, seq) FILTER (lane = 'treatment') AS t
  FROM v_experiments GROUP BY session_id)
SELECT session_id, concat_ws(',', CASE WHEN c IS NULL THEN 'control' END, CASE WHEN t IS NULL THEN 'treatment' END) AS missing, (c - t)::DOUBLE AS savings,
  CASE WHEN c IS NOT NULL AND t IS NOT NULL THEN CASE WHEN c > t THEN 'treatment' ELSE 'control' END END AS winner FROM p""")
def experiment_summary(spark, sf):
    rows = telemetry.experiment_summary(view(spark, sf, "v_experiments"))
    return rows.select("session_id", "missing", F.col("savings").cast("double").alias("savings"), "winner")


@query("h12_diff_stats", """
SELECT session_id, count(*) AS files_changed, sum(lines_added)::BIGINT AS lines_added, sum(lines_deleted)::BIGINT AS lines_deleted, sum(lines_added - lines_deleted)::BIGINT AS net_lines,
  count(*) FILTER (status = '??') AS new_files, count(*) FILTER (status <> '??') AS modified_files, count(*) FILTER (path LIKE 'src/%') AS source_files_changed,
  count(*) FILTER (path LIKE 'tests/%') AS test_files_changed, count(*) FILTER (path LIKE 'docs/%') AS docs_files_changed, count(*) FILTER (path LIKE 'conf/%') AS config_files_changed
FROM v_diff GROUP BY session_id""")
def diff_stats(spark, sf):
    return telemetry.diff_stats(view(spark, sf, "v_diff"))


def _transcript(spark, sf):
    names = F.when(F.col("tool_name").isNotNull(), F.array("tool_name")).otherwise(F.array().cast("array<string>"))
    return view(spark, sf, "v_transcript").select("conv_id", "turn", "role", names.alias("tool_names"))


_TURNS = """
WITH e AS (SELECT conv_id, coalesce(max(turn) FILTER (role = 'user'), max(turn) - 200) AS start FROM v_transcript GROUP BY conv_id),
c AS (SELECT conv_id, count(*) FILTER (turn > start AND tool_name IN ('Edit', 'Write')) AS edits, count(*) FILTER (turn > start AND tool_name = 'validate_plan') AS validates
  FROM v_transcript JOIN e USING (conv_id) GROUP BY conv_id) """


@query("h13_turn_tool_counts", _TURNS + "SELECT * FROM c")
def turn_tool_counts(spark, sf):
    return telemetry.turn_tool_counts(_transcript(spark, sf))


_TURNS_WHOLE = _TURNS.replace("max(turn) - 200", "min(turn) - 1")


@query("h13_turn_tool_counts_whole", _TURNS_WHOLE + "SELECT * FROM c")
def turn_tool_counts_whole(spark, sf):
    return telemetry.turn_tool_counts(_transcript(spark, sf), tail=None)


@query("h14_missing_validation_whole", _TURNS_WHOLE + "SELECT * FROM c WHERE edits > 0 AND validates = 0")
def missing_validation_whole(spark, sf):
    return telemetry.missing_validation(_transcript(spark, sf), tail=None)


@query("h13_parse_transcript", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS role, coalesce(tool_name, '') AS tools FROM v_transcript")
def parse_transcript(spark, sf):
    block = F.array(F.struct(F.lit("tool_use").alias("type"), F.col("tool_name").alias("name")), F.struct(
        F.lit("text").alias("type"), F.lit("x").alias("name")))
    raw = F.to_json(F.struct(F.struct("role", block.alias("content")).alias("message")))
    parsed = telemetry.parse_transcript(view(spark, sf, "v_transcript").select("conv_id", "turn", raw.alias("raw")))
    return parsed.select("conv_id", "turn", "role", F.array_join("tool_names", ",").alias("tools"))


@query("h14_missing_validation", _TURNS + "SELECT * FROM c WHERE edits > 0 AND validates = 0")
def missing_validation(spark, sf):
    return telemetry.missing_validation(_transcript(spark, sf))


@query("h15_calls_per_task", f"SELECT {', '.join(f'{s} AS {n}' for s, n in zip(_pct('c'), ('p50', 'p95', 'max', 'n')))} FROM (SELECT count(*) AS c FROM v_telemetry GROUP BY task_id)")
def calls_per_task(spark, sf):
    return telemetry.calls_per_task(view(spark, sf, "v_telemetry"))


# ---- reporting -------------------------------------------------------------------------------------------------------


def _payload_maps(spark, sf):
    rows = view(spark, sf, "v_payload").where("raw like '{\"%'")
    return rows.select("seq", F.from_json("raw", "map<string,string>").alias("event"), F.lit("i9").alias("install_id"))


def _redact_sql(private: str) -> str:
    return f"""
SELECT seq, array_to_string(list_sort(list_concat(list_filter(json_keys(raw), lambda k: NOT list_contains([{private}], k)
    AND NOT list_contains(['channel', 'build_id', 'install_id', 'dogfood'], k)), ['upload_schema_version', 'channel', 'build_id', 'install_id']{{more}})), ',') AS keys
FROM v_payload WHERE json_valid(raw) AND raw LIKE '{{{{%'"""


@query("i1_redact", _redact_sql(", ".join(f"'{k}'" for k in K.REDACTED_KEYS)).replace("{more}", "").replace("{{", "{").replace(
    "AND NOT list_contains(['channel', 'build_id', 'install_id', 'dogfood'], k)", "AND NOT list_contains(['channel', 'build_id', 'install_id'], k)"))
def redact(spark, sf):
    out = reporting.redact(_payload_maps(spark, sf))
    return out.select("seq", F.array_join(F.array_sort(F.map_keys("upload")), ",").alias("keys"))


@query("i1_redact_dogfood", _redact_sql(", ".join(f"'{k}'" for k in K.REDACTED_KEYS if k not in K.DOGFOOD_KEYS)).replace(
    "{more}", " || ['dogfood']").replace("{{", "{"))
def redact_dogfood(spark, sf):
    out = reporting.redact(_payload_maps(spark, sf), dogfood=True)
    return out.select("seq", F.array_join(F.array_sort(F.map_keys("upload")), ",").alias("keys"))


@query("i2_fingerprint", "SELECT seq, CASE WHEN NOT merged THEN sha256('i' || commits_ahead || '|' || sha) END AS fingerprint FROM v_branches")
def fingerprint(spark, sf):
    commit = F.when(~F.col("merged"), F.col("sha"))
    install = F.concat(F.lit("i"), F.col("commits_ahead").cast("string"))
    return view(spark, sf, "v_branches").select("seq", reporting.fingerprint(install, commit).alias("fingerprint"))


@query("i3_trim_to_bytes", """
WITH r AS (SELECT seq, seq % 3 AS queue, sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY seq % 3 ORDER BY seq DESC) AS run FROM v_payload)
SELECT queue, seq FROM r WHERE run <= 100000""")
def trim_to_bytes(spark, sf):
    queues = view(spark, sf, "v_payload").withColumn("queue", F.col("seq") % 3)
    return reporting.trim_to_bytes(queues, ["queue"], max_bytes=100_000, block_rows=512).select("queue", "seq")


def _uploads(spark, sf):
    return spread(view(spark, sf, "v_payload").select("batch_id", "seq", "raw"))


@query("i4_validate_events", "SELECT seq, expected_reason AS reason FROM v_payload")
def validate_events(spark, sf):
    return reporting.validate_events(_uploads(spark, sf)).select("seq", "reason")


_BATCHES = "SELECT batch_id, count(*) AS n, sum(octet_length(encode(raw)) + 1) - 1 AS bytes, count(*) FILTER (expected_reason IS NULL) AS good FROM v_payload GROUP BY batch_id"


@query("i5_ingest_results", f"""
SELECT batch_id, CASE WHEN bytes > 6000 OR n > 1000 THEN 413 WHEN good = 0 THEN 400 ELSE 202 END AS status, CASE WHEN bytes > 6000 THEN 'payload_too_large' END AS error,
  CASE WHEN bytes > 6000 THEN 0 ELSE good END AS accepted, CASE WHEN bytes > 6000 THEN 0 ELSE n - good END AS rejected FROM ({_BATCHES})""")
def ingest_results(spark, sf):
    return reporting.ingest(_uploads(spark, sf), max_bytes=6000)["results"]


@query("i5_ingest_accepted", """
SELECT seq, 1.0::DOUBLE AS schema_version, 'i' AS install_id, CASE WHEN seq % 10 = 6 THEN 'canary' ELSE 'stable' END AS channel, seq % 10 = 6 AS dogfood,
  CASE WHEN seq % 10 = 6 THEN 'tb' END AS traceback, CASE WHEN seq % 10 >= 8 THEN seq END::DOUBLE AS duration_ms FROM v_payload WHERE expected_reason IS NULL""")
def ingest_accepted(spark, sf):
    rows = reporting.ingest(_uploads(spark, sf))["accepted"]
    return rows.select("seq", "schema_version", "install_id", "channel", "dogfood", "traceback", "duration_ms")


@query("i5_ingest_reasons", "SELECT batch_id, expected_reason AS reason, count(*) AS n FROM v_payload WHERE expected_reason IS NOT NULL GROUP BY ALL")
def ingest_reasons(spark, sf):
    return reporting.ingest(_uploads(spark, sf))["reasons"]


@query("i6_peek", "SELECT seq, raw FROM v_payload ORDER BY seq DESC LIMIT 10")
def peek(spark, sf):
    return reporting.peek(view(spark, sf, "v_payload").select("seq", "raw"))


# ---- queue -----------------------------------------------------------------------------------------------------------


def _queue(spark, sf):
    return view(spark, sf, "v_telemetry").select(
        F.col("repo_hash").alias("repo"), F.col("task_id").alias("path"), F.date_trunc("hour", "event_time").alias("queued_at"), "seq")


@query("j4_keep_latest", """
SELECT repo_hash AS repo, task_id AS path, max(seq) AS seq FROM v_telemetry t WHERE date_trunc('hour', event_time) =
  (SELECT max(date_trunc('hour', event_time)) FROM v_telemetry u WHERE u.task_id = t.task_id AND u.repo_hash = t.repo_hash) GROUP BY ALL""")
def keep_latest(spark, sf):
    return debounce.keep_latest(_queue(spark, sf), ["repo", "path"]).select("repo", "path", "seq")


@query("j5_pending_status", f"""
WITH l AS (SELECT repo_hash AS repo, task_id AS path, max_by((date_trunc('hour', event_time), seq), (date_trunc('hour', event_time), seq)) AS b FROM v_telemetry GROUP BY ALL),
o AS (SELECT repo, path, b[1] AS q, row_number() OVER (PARTITION BY repo ORDER BY b[1], b[2]) AS n FROM l)
SELECT repo, count(*) AS count, (epoch_us({_NOW}) - epoch_us(min(q))) / 1e6 AS oldest_age_seconds, array_to_string(list(path ORDER BY n)[:10], ',') AS paths FROM o GROUP BY repo""")
def pending_status(spark, sf):
    out = debounce.pending_status(_queue(spark, sf), _now(spark, sf))
    return out.withColumn("paths", F.array_join("paths", ","))
