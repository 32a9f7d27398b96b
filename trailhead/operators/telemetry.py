"""Usage telemetry, experiments and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths
from .skew import exact_percentiles, salted_join

_SUMMARY = "struct<p50:bigint,p95:bigint,max:bigint,n:bigint>"


def filter_events(df: DataFrame, now: Column | None = None, days: int | None = 30, repo_hash: str | None = None) -> DataFrame:
    """Last ``days`` before ``now`` and one repo; rows without a time, or with one that can't be read, drop out only when a window is set."""
    if days is not None:
        now = F.current_timestamp() if now is None else now
        time = F.try_to_timestamp("event_time") if dict(df.dtypes)["event_time"] == "string" else F.col("event_time")
        df = df.where(time >= now - F.expr(f"interval {days} days"))
    return df if repo_hash is None else df.where(F.col("repo_hash") == repo_hash)


def _op() -> Column:
    return F.coalesce(F.nullif("op", F.lit("")), F.nullif("event_type", F.lit("")), F.lit("unknown"))


def _either(df: DataFrame, name: str, fallback: str | None) -> Column:
    first = F.nullif(F.col(name), F.lit(0))
    return F.coalesce(first, F.col(fallback)) if fallback and fallback in df.columns else first


def percentile_columns(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One struct (p50, p95, max, n) per value column and key; zeros where a key has no value."""
    long = exact_percentiles(df, keys, values)
    picked = [F.max(F.when(F.col("metric") == v, F.struct("p50", "p95", "max", "n"))).alias(v) for v in values]
    return long.groupBy(*keys).agg(*picked)


def _zero_filled(name: str) -> Column:
    zeros = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("p50", "p95", "max", "n")])
    return F.coalesce(name, zeros).cast(_SUMMARY).alias(name)


def op_summary(df: DataFrame, fallback_duration: str | None = None) -> DataFrame:
    """Calls, successes and duration and size percentiles per operation. Durations count when positive."""
    duration = _either(df, "duration_ms", fallback_duration).cast("long")
    rows = df.select(
        _op().alias("op"), F.coalesce("success", F.lit(False)).alias("success"),
        F.when(duration > 0, duration).alias("duration_ms"), F.coalesce(F.col("output_bytes").cast("long"), F.lit(0)).alias("output_bytes"))
    counts = rows.groupBy("op").agg(F.count("*").alias("count"), F.count_if("success").alias("success_count"))
    shape = percentile_columns(rows, ["op"], ["duration_ms", "output_bytes"])
    rate = F.bround(F.col("success_count") / F.col("count"), 3)
    return counts.join(shape, "op", "left").select(
        "op", "count", "success_count", rate.alias("success_rate"), _zero_filled("duration_ms"), _zero_filled("output_bytes"))


def daily(df: DataFrame) -> DataFrame:
    return df.where("event_time is not null").groupBy(F.to_date("event_time").alias("date")).agg(F.count("*").alias("count")).orderBy("date")


def top_values(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Most frequent non-empty values; equal counts in first-seen order."""
    present = df.where(F.coalesce(F.col(column), F.lit("")) != "")
    counts = present.groupBy(column).agg(F.count("*").alias("count"), F.min("seq").alias("first_seq"))
    ordered = counts.orderBy(F.col("count").desc(), "first_seq")
    return (ordered if k is None else ordered.limit(k)).select(column, "count")


def recent_errors(df: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` failures with an error type, newest first."""
    failed = df.where(~F.coalesce("success", F.lit(False)) & (F.coalesce("error_type", F.lit("")) != ""))
    last = failed.orderBy(F.col("seq").desc()).limit(k)
    return last.select("seq", "event_time", F.coalesce(F.nullif("op", F.lit("")), F.col("event_type")).alias("op"), "error_type")


BUILD_COLUMNS = ["duration_ms", "model_load_ms", "embed_ms", "scan_ms", "chunk_count", "file_count", "output_bytes"]


def index_builds(df: DataFrame, columns: list[str] = BUILD_COLUMNS) -> DataFrame:
    """Phase timings of index builds: count, successes and (metric, p50, p95, max, n) per column, nulls left out."""
    builds = df.where("event_type = 'index_build'").withColumn("event_type", F.lit("index_build"))
    totals = builds.groupBy("event_type").agg(
        F.count("*").alias("count"), F.count_if(F.coalesce("success", F.lit(False))).alias("success_count"))
    return totals.join(exact_percentiles(builds, ["event_type"], columns), "event_type", "left").drop("event_type")


def stats(df: DataFrame, now: Column | None = None, days: int | None = 30, repo_hash: str | None = None) -> dict[str, DataFrame]:
    """All digests over one filtered scan."""
    events = filter_events(df, now, days, repo_hash)
    return {
        "total_events": events.agg(F.count("*").alias("total_events")),
        "by_op": op_summary(events),
        "index_builds": index_builds(events, [c for c in BUILD_COLUMNS if c in df.columns]),
        "daily_activity": daily(events),
        "top_repos": top_values(events, "repo_hash", 5),
        "surface_breakdown": top_values(events, "surface"),
        "recent_errors": recent_errors(events),
    }


def calls_per_task(df: DataFrame) -> DataFrame:
    """Median and p95 of the number of calls per task."""
    calls = df.where("task_id is not null").groupBy("task_id").agg(F.count("*").alias("calls"))
    return exact_percentiles(calls.withColumn("all", F.lit(1)), ["all"], ["calls"]).drop("all", "metric")


# ---- experiments -----------------------------------------------------------------------------------------------------


def lane_costs(df: DataFrame) -> DataFrame:
    """Lane rows with their cost; negative costs and an after below its before are refused."""
    ok = (F.col("cost_before") >= 0) & (F.col("cost_after") >= 0) & (F.col("cost_after") >= F.col("cost_before"))
    return df.where(ok).withColumn("cost_delta", (F.col("cost_after") - F.col("cost_before")).cast("decimal(18,2)"))


def experiments(df: DataFrame, lanes: list[str] = ("control", "treatment")) -> DataFrame:
    """One row per session with the last cost recorded for each lane."""
    picked = [F.max_by("cost_delta", F.when(F.col("lane") == lane, F.col("seq"))).alias(lane) for lane in lanes]
    return df.groupBy("session_id").agg(*picked)


def experiment_summary(df: DataFrame) -> DataFrame:
    """Missing lanes, savings (control minus treatment), their share of the control cost, and the winner."""
    pairs = experiments(lane_costs(df))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("control", "treatment")]))
    savings = (F.col("control") - F.col("treatment")).cast("decimal(18,2)")
    both = F.size(missing) == 0
    share = F.when(F.col("control") > 0, F.bround((savings / F.col("control")) * F.lit(100).cast("decimal(5,0)"), 1))
    return pairs.select(
        "session_id", F.array_join(missing, ",").alias("missing"), "control", "treatment", savings.alias("savings"),
        share.cast("double").alias("savings_pct"),
        F.when(both, F.when(savings > 0, "treatment").otherwise("control")).alias("winner"))


def diff_stats(changes: DataFrame) -> DataFrame:
    """Size and shape of a session's diff by file type; untracked (``??``) files are new."""
    low, ext = F.lower("path"), paths.extension("path")
    test = F.concat(low, F.lit("/")).contains("tests/")
    for marker in K.TEST_MARKERS:
        test = test | F.lower(paths.name("path")).contains(marker)
    kind = (
        F.when(test, "test").when(ext.isin(K.DOC_EXTENSIONS), "docs").when(ext.isin(K.CONFIG_EXTENSIONS), "config")
        .when(ext.isin(K.CODE_EXTENSIONS), "source").otherwise("other")
    )
    new = F.col("status") == "??"
    out = changes.withColumn("_k", kind).groupBy("session_id").agg(
        F.count("*").alias("files_changed"), F.sum("lines_added").alias("lines_added"),
        F.sum(F.when(new, 0).otherwise(F.col("lines_deleted"))).alias("lines_deleted"),
        F.count_if(new).alias("new_files"), F.count_if(~new).alias("modified_files"),
        *[F.count_if(F.col("_k") == k).alias(f"{k}_files_changed") for k in ("source", "test", "docs", "config")])
    return out.withColumn("net_lines", F.col("lines_added") - F.col("lines_deleted"))


# ---- transcripts -----------------------------------------------------------------------------------------------------


def parse_transcript(lines: DataFrame) -> DataFrame:
    """JSON transcript lines (conv_id, turn, raw) to (conv_id, turn, role, tool_names); unreadable lines name nothing."""
    shape = "struct<type:string,tool_name:string,name:string,message:struct<role:string,content:string>>"
    blocks = F.from_json("_o.message.content", "array<struct<type:string,name:string>>")
    used = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: b["name"])
    names = F.concat(F.array("_o.tool_name", "_o.name"), F.coalesce(used, F.array().cast("array<string>")))
    user = (F.col("_o.type") == "user") | (F.col("_o.message.role") == "user")
    parsed = lines.withColumn("_o", F.from_json("raw", shape))
    return parsed.select(
        "conv_id", "turn", F.when(user, "user").otherwise("other").alias("role"),
        F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "").alias("tool_names"))


def turn_tool_counts(transcripts: DataFrame, validate_tool: str = "validate_plan", tail: int | None = K.TRANSCRIPT_TAIL_LINES) -> DataFrame:
    """Edits and validations after the last user message of each conversation; if it has none, in its last ``tail`` lines, or in all for None."""
    ends = transcripts.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_user"), F.max("turn").alias("_end"))
    start = F.col("_user") if tail is None else F.coalesce(F.col("_user"), F.col("_end") - tail)
    inside = salted_join(transcripts, ends, ["conv_id"], ["turn"]).where(start.isNull() | (F.col("turn") > start))
    calls = inside.select("conv_id", F.explode("tool_names").alias("tool")).groupBy("conv_id").agg(
        F.count_if(F.col("tool").isin(K.EDIT_ACTIONS)).alias("edits"),
        F.count_if(F.col("tool") == validate_tool).alias("validates"))
    return ends.select("conv_id").join(calls, "conv_id", "left").fillna(0, ["edits", "validates"])


def missing_validation(transcripts: DataFrame, **options) -> DataFrame:
    """Conversations that end with edits but no validation."""
    return turn_tool_counts(transcripts, **options).where("edits > 0 and validates = 0")
