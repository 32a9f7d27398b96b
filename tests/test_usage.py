import json

import pytest
from pyspark.sql import functions as F

from trailhead.functions import paths
from trailhead.operators import reporting, telemetry

GOOD = {"schema_version": 1, "event_type": "x", "event_time": "t", "install_id": "i", "channel": "stable", "build_id": ""}

CASES = [
    ("nope", "invalid_json"), ("null", "not_object"), ("[]", "not_object"), ("3", "not_object"),
    (json.dumps({**GOOD, "dogfood": "yes", "query": 1}), "bad_dogfood"), (json.dumps({"task": 1, **GOOD, "code": 2}), "forbidden_key:task"),
    (json.dumps({**GOOD, "code": 2, "dogfood": True, "traceback": "t"}), "forbidden_key:code"), (json.dumps({**GOOD, "dogfood": True, "traceback": "t"}), None),
    (json.dumps({**GOOD, "schema_version": "1"}), "missing_schema_version"), (json.dumps({**GOOD, "event_type": ""}), "missing_event_type"),
    (json.dumps({**GOOD, "event_time": None}), "missing_event_time"), (json.dumps({**GOOD, "install_id": 3}), "missing_install_id"),
    (json.dumps({**GOOD, "channel": "beta"}), "bad_channel"), (json.dumps({k: v for k, v in GOOD.items() if k != "build_id"}), "missing_build_id"),
    (json.dumps({**GOOD, "session_id": 1}), "bad_session_id"), (json.dumps({**GOOD, "op": None}), "bad_op"), (json.dumps({**GOOD, "success": 1}), "bad_success"),
    (json.dumps({**GOOD, "error_type": None}), None), (json.dumps({**GOOD, "error_type": 1}), "bad_error_type"), (json.dumps({**GOOD, "duration_ms": -1}), "bad_duration_ms"),
    (json.dumps({**GOOD, "duration_ms": 1.5}), None), (json.dumps({**GOOD, "output_bytes": "2"}), "bad_output_bytes"), (json.dumps({**GOOD, "repo_fingerprint": 2}), "bad_repo_fingerprint"),
    (json.dumps({**GOOD, "stats": None}), "bad_stats"), (json.dumps({**GOOD, "stats": [1]}), "bad_stats"), (json.dumps({**GOOD, "stats": {"path": 1}}), None),
    (json.dumps(GOOD), None),
]


def test_ingest_rules(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "seq int, raw string")
    got = {r.seq: r.reason for r in reporting.validate_events(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_ingest_limits(spark):
    good = json.dumps(GOOD)
    rows = [(1, 0, good), (1, 1, "bad"), (2, 2, "bad"), (3, 3, " "), (4, 4, good), (4, 5, good), (4, 6, good), (5, 7, "x" * 900)]
    out = reporting.ingest(spark.createDataFrame(rows, "batch_id int, seq int, raw string"), max_bytes=800, max_events=2)
    got = {r.batch_id: (r.status, r.error, r.accepted, r.rejected) for r in out["results"].collect()}
    assert got == {1: (202, None, 1, 1), 2: (400, None, 0, 1), 3: (400, "empty_body", 0, 0), 4: (413, "too_many_events", 0, 0), 5: (413, "payload_too_large", 0, 0)}
    assert out["accepted"].count() == 1 and {(r.batch_id, r.reason, r.n) for r in out["reasons"].collect()} == {(1, "invalid_json", 1), (2, "invalid_json", 1)}


def test_redaction(spark):
    event = {"query": "q", "op": "x", "traceback": "tb", "error_message": None, "channel": "z"}
    df = spark.createDataFrame([(event, "me")], "event map<string,string>, install_id string")
    plain = reporting.redact(df).first().upload
    assert set(plain) == {"op", "upload_schema_version", "channel", "build_id", "install_id"} and plain["channel"] == "stable"
    dog = reporting.redact(df, dogfood=True, extra_keys=["op"]).first().upload
    assert dog["traceback"] == "tb" and dog["dogfood"] == "true" and "op" not in dog and "error_message" not in dog


@pytest.mark.parametrize("limit", [0, 9, 10, 57, 5000])
def test_retention_equals_brute_force(spark, limit):
    lines = [(i % 2, i, "x" * (i % 7 + 1)) for i in range(300)]
    df = spark.createDataFrame(lines, "queue int, seq int, raw string")
    want = set()
    for queue in (0, 1):
        size = 0
        for q, seq, raw in reversed([x for x in lines if x[0] == queue]):
            size += len(raw) + 1
            if size > limit:
                break
            want.add(seq)
    assert {r.seq for r in reporting.trim_to_bytes(df, ["queue"], max_bytes=limit, block_rows=16).collect()} == want


def test_transcript(spark):
    lines = [json.dumps({"type": "user"}), json.dumps({"name": "Edit"}), "", "{bad", json.dumps({"message": {"role": "user", "content": "hi"}}),
             json.dumps({"message": {"role": "assistant", "content": [{"type": "tool_use", "name": "Write"}, {"type": "text", "name": "Edit"}]}}),
             json.dumps({"tool_name": "Edit", "name": "validate_plan"})]
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", i, json.dumps({"tool_name": "Edit"})) for i in range(300)]
    parsed = telemetry.parse_transcript(spark.createDataFrame(rows, "conv_id string, turn int, raw string"))
    got = {r.conv_id: (r.edits, r.validates) for r in telemetry.turn_tool_counts(parsed).collect()}
    assert got == {"a": (2, 1), "b": (200, 0)}
    assert [r.conv_id for r in telemetry.missing_validation(parsed).collect()] == ["b"]


def test_op_summary_fallbacks(spark):
    rows = [("", "invocation", 0, 40, True, None), (None, "invocation", None, 20, False, 8), ("x", "y", -5, None, None, 4)]
    df = spark.createDataFrame(rows, "op string, event_type string, duration_ms long, old_ms long, success boolean, output_bytes long")
    got = {r.op: r for r in telemetry.op_summary(df, "old_ms").collect()}
    assert tuple(got["invocation"].duration_ms) == (30, 20, 40, 2) and tuple(got["invocation"].output_bytes) == (4, 0, 8, 2)
    assert tuple(got["x"].duration_ms) == (0, 0, 0, 0) and got["x"].success_rate == 0.0


def test_index_builds_and_experiments(spark):
    builds = spark.createDataFrame([("index_build", True, 100, 4000), ("index_build", False, 300, None), ("z", True, 1, 1)], "event_type string, success boolean, duration_ms long, embed_ms long")
    got = {r.metric: (r["count"], r.success_count, r.p50, r.n) for r in telemetry.index_builds(builds, ["duration_ms", "embed_ms"]).collect()}
    assert got == {"duration_ms": (2, 1, 200, 2), "embed_ms": (2, 1, 4000, 1)}
    lanes = [("s", "control", 1, "1.00", "3.00"), ("s", "control", 2, "1.00", "5.00"), ("s", "treatment", 3, "2.00", "4.50"), ("s", "treatment", 4, "9.00", "1.00"), ("t", "control", 5, "0", "0")]
    df = spark.createDataFrame(lanes, "session_id string, lane string, seq int, a string, b string").select(
        "session_id", "lane", "seq", F.col("a").cast("decimal(18,2)").alias("cost_before"), F.col("b").cast("decimal(18,2)").alias("cost_after"))
    out = {r.session_id: r for r in telemetry.experiment_summary(df).collect()}
    assert float(out["s"].savings) == 1.5 and out["s"].savings_pct == 37.5 and out["s"].winner == "treatment"
    assert out["t"].missing == "treatment" and out["t"].winner is None


def test_whole_conversations_and_texts(spark):
    rows = [("b", i, "other", ["Edit"]) for i in range(300)] + [("c", 0, "user", ["Edit"]), ("c", 1, "other", ["Write"])]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, tool_names array<string>")
    assert {r.conv_id: r.edits for r in telemetry.turn_tool_counts(turns, tail=None).collect()} == {"b": 300, "c": 1}
    late = spark.createDataFrame([("x.py", "# " + "x" * 3000 + "\nimport click\n")], "path string, content string")
    assert paths.classify(late).first().subkind == "cli" and paths.classify(late, head_chars=2048).first().subkind == "util"
