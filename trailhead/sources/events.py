"""Append-only JSON-lines event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.skew import log_offsets

RANKED_PATH = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("heuristic_score", T.DoubleType()),
    T.StructField("embedding_score", T.DoubleType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("repo_root", T.StringType()),
    T.StructField("bundle_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("relevance", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("ranked_paths", T.ArrayType(RANKED_PATH)),
])

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("event_time", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("surface", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("repo_hash", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("output_bytes", T.LongType()),
    T.StructField("model_load_ms", T.LongType()),
    T.StructField("embed_ms", T.LongType()),
    T.StructField("scan_ms", T.LongType()),
    T.StructField("chunk_count", T.LongType()),
    T.StructField("file_count", T.LongType()),
])

SCHEMA_VERSION = 1


def read_events(
    spark: SparkSession, path: str, since: str | None = None, schema: T.StructType = FEEDBACK_SCHEMA
) -> DataFrame:
    """Feedback log rows in log order (``seq``: by file name, then line). Blank and malformed lines are skipped.

    In an object that repeats a key the last value counts.

    ``since`` is an ISO-8601 UTC string and compared as one; rows without a time pass.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # A strict parse refuses repeated keys, the other one trailing text.
    whole = F.try_parse_json("value").isNotNull() | (F.get_json_object("value", "$").isNotNull() & F.trim("value").rlike(r"(?s)^\{.*\}$"))
    numbered = log_offsets(lines).where(whole)
    rows = numbered.select("seq", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e")).where("e is not null")
    rows = rows.select("seq", "e.*")
    if since is not None:
        rows = rows.where(F.col("event_time").isNull() | (F.col("event_time") >= since))
    return rows


def read_telemetry(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """Telemetry log rows; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def with_event_defaults(df: DataFrame, version: int = SCHEMA_VERSION, now=None) -> DataFrame:
    """Fill in ``schema_version`` and ``event_time`` where a row has none."""
    now = F.date_trunc("second", F.current_timestamp()) if now is None else now
    for name, value in (("schema_version", F.lit(version)), ("event_time", now)):
        df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return df


def append_events(df: DataFrame, path: str) -> None:
    """Append to a Parquet event table partitioned by day."""
    out = with_event_defaults(df).withColumn("event_date", F.to_date("event_time"))
    out.write.mode("append").partitionBy("event_date").parquet(path)
