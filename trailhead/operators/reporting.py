"""Anonymised usage reporting: redaction, retention and the ingest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import constants as K
from ..functions.text import as_col, strip
from .skew import salted_join


def redact(df: DataFrame, dogfood: bool = False, channel: str = "stable", build_id: str = "dev", version: int = 1,
           extra_keys: list[str] = ()) -> DataFrame:
    """``event`` (map<string,string>) without private keys and with the upload facts; needs an ``install_id`` column.

    In dogfood mode a non-null error message and traceback are kept. ``extra_keys`` are further keys to drop.
    """
    private = [k for k in [*K.REDACTED_KEYS, *extra_keys] if not (dogfood and k in K.DOGFOOD_KEYS)]
    facts = {"upload_schema_version": F.lit(str(version)), "channel": F.lit(channel), "build_id": F.lit(build_id),
             "install_id": F.col("install_id"), **({"dogfood": F.lit("true")} if dogfood else {})}
    kept = F.map_filter("event", lambda k, v: ~k.isin([*private, *facts]) & ~(k.isin(K.DOGFOOD_KEYS) & v.isNull()))
    added = F.create_map(*[c for k, v in facts.items() for c in (F.lit(k), v)])
    return df.withColumn("upload", F.map_concat(kept, added))


def fingerprint(install_id: Column | str, first_commit: Column | str) -> Column:
    """Stable id of a repo for one install; null without a commit."""
    return F.sha2(F.concat(as_col(install_id), F.lit("|"), as_col(first_commit)), 256)


def trim_to_bytes(df: DataFrame, keys: list[str], line: str = "raw", max_bytes: int = K.MAX_QUEUE_BYTES,
                  block_rows: int = 4096) -> DataFrame:
    """Per queue the newest rows whose bytes, one more each for the line end, fit ``max_bytes``.

    The running size is taken over blocks of neighbouring rows first; blocks that start past the limit drop out before
    any row is ordered, and rows are only ordered inside a block.
    """
    sized = df.withColumn("_b", F.octet_length(line) + 1).withColumn("_block", F.floor(F.col("seq") / F.lit(block_rows)))
    newer = W.partitionBy(*keys).orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    blocks = sized.groupBy(*keys, "_block").agg(F.sum("_b").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_before") <= max_bytes).drop("_n")
    inside = W.partitionBy(*keys, "_block").orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, 0)
    near = sized.join(blocks, [*keys, "_block"])
    return near.withColumn("_run", F.col("_before") + F.sum("_b").over(inside)).where(F.col("_run") <= max_bytes).drop(
        "_b", "_block", "_before", "_run")


def peek(df: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` queued rows, most recent last."""
    return df.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


# ---- ingest ----------------------------------------------------------------------------------------------------------


def validate_events(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``reason``: why an uploaded line is refused, or null. The first broken rule counts.

    A line is parsed once; the rules read the parsed column.
    """
    parsed = df.withColumn("_doc", F.try_parse_json(raw)).withColumn("_keys", F.json_object_keys(raw))
    return parsed.withColumn("reason", _reject_reason(F.col("_doc"), F.col("_keys"))).drop("_doc", "_keys")


def _reject_reason(doc: Column, keys: Column) -> Column:
    def at(name):
        return F.try_variant_get(doc, f"$.{name}", "variant")

    def kind(name):   # null where the key is absent
        return F.schema_of_variant(at(name))

    def absent_or(name, *kinds):
        return kind(name).isNull() | kind(name).isin(*kinds)

    def number(name):
        return F.coalesce(kind(name).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    def text(name):
        return F.coalesce((kind(name) == "STRING") & (F.try_variant_get(doc, f"$.{name}", "string") != ""), F.lit(False))

    def amount(name):
        return kind(name).isNull() | (number(name) & (F.try_variant_get(doc, f"$.{name}", "double") >= 0))

    dogfood = F.coalesce(F.try_variant_get(doc, "$.dogfood", "boolean"), F.lit(False))
    hits = F.filter(
        keys, lambda k: k.isin(K.REJECTED_KEYS) & ~(dogfood & k.isin(K.DOGFOOD_KEYS)))
    rules = [
        (doc.isNull(), "invalid_json"),
        (~F.schema_of_variant(doc).startswith("OBJECT"), "not_object"),
        (~absent_or("dogfood", "BOOLEAN"), "bad_dogfood"),
        (F.size(hits) > 0, F.concat(F.lit("forbidden_key:"), F.get(hits, F.lit(0)))),
        (~number("schema_version"), "missing_schema_version"),
        (~text("event_type"), "missing_event_type"),
        (~text("event_time"), "missing_event_time"),
        (~text("install_id"), "missing_install_id"),
        (~(text("channel") & F.try_variant_get(doc, "$.channel", "string").isin("stable", "canary")), "bad_channel"),
        (~F.coalesce(kind("build_id") == "STRING", F.lit(False)), "missing_build_id"),
        (~absent_or("session_id", "STRING"), "bad_session_id"),
        (~absent_or("op", "STRING"), "bad_op"),
        (~absent_or("success", "BOOLEAN"), "bad_success"),
        (~absent_or("error_type", "STRING", "VOID"), "bad_error_type"),
        (~amount("duration_ms"), "bad_duration_ms"),
        (~amount("output_bytes"), "bad_output_bytes"),
        (~absent_or("repo_fingerprint", "STRING"), "bad_repo_fingerprint"),
        (~(kind("stats").isNull() | kind("stats").startswith("OBJECT")), "bad_stats"),
        (~absent_or("error_message", "STRING"), "bad_error_message"),
        (~absent_or("traceback", "STRING"), "bad_traceback"),
    ]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for broken, reason in rules[1:]:
        out = out.when(broken, reason if isinstance(reason, Column) else F.lit(reason))
    return out


def stored_columns(valid: DataFrame, raw: str = "raw") -> DataFrame:
    """The columns kept of an accepted line."""
    doc = F.try_parse_json(F.col(raw))
    names = {
        "event_time": "string", "schema_version": "double", "event_type": "string", "channel": "string", "build_id": "string",
        "install_id": "string", "session_id": "string", "op": "string", "success": "boolean", "error_type": "string",
        "duration_ms": "double", "output_bytes": "double", "repo_fingerprint": "string", "dogfood": "boolean",
        "error_message": "string", "traceback": "string",
    }
    picked = [F.try_variant_get(doc, f"$.{n}", t).alias(n) for n, t in names.items()]
    stats_json = F.to_json(F.try_variant_get(doc, "$.stats", "variant")).alias("stats_json")
    return valid.select(*[c for c in valid.columns if c not in (raw, "reason")], *picked, stats_json).fillna(False, ["dogfood"])


def gate_error(max_bytes: int = K.MAX_BATCH_BYTES, max_events: int = K.MAX_BATCH_EVENTS) -> Column:
    """Why a batch of ``bytes`` and ``events`` is refused as a whole, or null."""
    return (
        F.when(F.col("bytes") > max_bytes, "payload_too_large").when(F.col("events") == 0, "empty_body")
        .when(F.col("events") > max_events, "too_many_events")
    )


def gate_batches(raw_batches: DataFrame, **limits) -> DataFrame:
    """(batch_id, error): the limits on a whole batch."""
    filled = strip("raw") != ""
    sizes = raw_batches.groupBy("batch_id").agg(
        (F.sum(F.octet_length("raw") + 1) - 1).alias("bytes"), F.count_if(filled).alias("events"))
    return sizes.withColumn("error", gate_error(**limits))


def checked_lines(raw_batches: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(limits per batch, the checked lines of the batches within them). Input: (batch_id, seq, raw)."""
    gates = gate_batches(raw_batches, **limits)
    passed = gates.where("error is null").select("batch_id")
    lines = salted_join(raw_batches.where(strip("raw") != ""), passed, ["batch_id"], ["seq"], "left_semi")
    return gates, validate_events(lines)


def ingest_outputs(gates: DataFrame, checked: DataFrame) -> dict[str, DataFrame]:
    """Accepted rows, quarantined rows, one result per batch and the histogram of reasons."""
    good = checked.where("reason is null")
    bad = checked.where("reason is not null")
    counts = checked.groupBy("batch_id").agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    status = F.when(F.col("error").isin("payload_too_large", "too_many_events"), 413).when(
        F.col("error").isNotNull() | (F.col("accepted") == 0), 400).otherwise(202)
    results = gates.join(counts, "batch_id", "left").fillna(0, ["accepted", "rejected"]).withColumn("status", status)
    return {
        "accepted": stored_columns(good), "quarantine": bad,
        "results": results.select("batch_id", "status", "error", "accepted", "rejected"),
        "reasons": bad.groupBy("batch_id", "reason").agg(F.count("*").alias("n")),
    }


def ingest(raw_batches: DataFrame, **limits) -> dict[str, DataFrame]:
    """Check and split uploaded batches."""
    return ingest_outputs(*checked_lines(raw_batches, **limits))
