import datetime as dt
import random

from pyspark.sql import functions as F

from trailhead.operators import feedback

EVENT = "repo string, seq long, event_time timestamp, event_type string, bundle_id string, path string, action string, relevance string"
RANKED = "repo string, seq long, event_time timestamp, bundle_id string, pos int, path string, kind string, embedding_score double"
T0 = dt.datetime(2024, 5, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def log(spark, *events):
    rows = [("r", i, at(m), t, b, p, a, rel) for i, (m, t, b, p, a, rel) in enumerate(events)]
    return spark.createDataFrame(rows, EVENT)


def bundle(spark, *entries):
    return spark.createDataFrame([("r", s, at(m), b, pos, p, k, e) for s, m, b, pos, p, k, e in entries], RANKED)


def test_attribution_windows(spark):
    events = log(spark, (0, "bundle_emitted", "b0", None, None, None), (110, "bundle_emitted", "b1", None, None, None),
                 (119, "bundle_emitted", "b2", None, None, None), (120, "tool_use", None, "a.py", "Edit", None),
                 (149, "tool_use", None, "a.py", "Read", None), (150, "tool_use", None, "a.py", "Read", None), (120, "tool_use", None, "zz", "Read", None))
    ranked = bundle(spark, (0, 0, "b0", 0, "a.py", "code", 0.5), (1, 110, "b1", 0, "a.py", "code", 0.5), (2, 119, "b2", 0, "a.py", "code", 0.5))
    got = {r.seq: r.bundle_id for r in feedback.attribute(events, ranked).collect()}
    assert got == {3: "b2", 4: "b2", 5: None, 6: None}
    assert {r.bundle_id for r in feedback.attribute(events, ranked, max_events=1).where("seq = 3").collect()} == {"b2"}
    assert {r.bundle_id for r in feedback.attribute(events, ranked, max_events=1).where("seq = 4").collect()} == {None}


def test_attribution_of_a_hot_path_equals_brute_force(spark):
    rng = random.Random(3)
    kinds = [rng.choice(["bundle_emitted", "tool_use", "tool_use"]) for _ in range(1500)]
    events, ranked = [], []
    for i, kind in enumerate(kinds):
        path = "hot" if rng.random() < 0.6 else f"p{rng.randrange(20)}"
        time = T0 + dt.timedelta(seconds=20 * i)
        events.append(("r", i, time, kind, f"b{i}" if kind == "bundle_emitted" else None, None if kind == "bundle_emitted" else path, "Edit", None))
        if kind == "bundle_emitted":
            ranked.append(("r", i, time, f"b{i}", 0, path, "code", 0.1))
    e, r = spark.createDataFrame(events, EVENT), spark.createDataFrame(ranked, RANKED)
    for window, limit in ((300, 40), (3600, 7)):
        got = {x.seq: x.bundle_id for x in feedback.attribute(e, r, window, limit).collect()}
        for row in events:
            if row[3] != "tool_use":
                continue
            match = [b for b in ranked if b[5] == row[5] and row[1] - limit <= b[1] < row[1] and b[2] >= row[2] - dt.timedelta(seconds=window)]
            assert got[row[1]] == (match[-1][3] if match else None)


def test_evaluation(spark):
    ranked = bundle(spark, (0, 0, "b1", 0, "a.py", "code", 0.5), (0, 0, "b1", 1, "R.md", "doc", 0.4), (0, 0, "b1", 2, "p.json", "config", 0.3))
    events = log(spark, (0, "bundle_emitted", "b1", None, None, None), (1, "tool_use", "b1", "a.py", "Edit", None),
                 (2, "git_edit", "b1", "a.py", "Edit", None), (3, "self_report", "b1", "R.md", None, "noise"), (3, "self_report", "b1", "R.md", None, "noise"),
                 (4, "tool_use", None, "api/other.py", "Read", None), (5, "tool_use", "b1", "p.json", "Read", None))
    got = {r.kind: (r.bundle_paths, r.positives, r.noise, r.misses, r.precision, r.recall, r.noise_rate) for r in feedback.evaluate(events, ranked).collect()}
    assert got["code"] == (1, 1, 0, 0, 1.0, 1.0, 0.0) and got["doc"] == (1, 0, 1, 0, 0.0, 0.0, 1.0)
    assert got["code/handler"] == (0, 0, 0, 1, 0.0, 0.0, 0.0) and got["overall"] == (3, 1, 1, 1, 0.3333, 0.5, 0.3333)
    later = feedback.evaluate(events, ranked, since=F.lit(at(4)))
    assert {r.kind for r in later.collect()} >= {"overall", "code/handler"}


def test_labels(spark):
    ranked = bundle(spark, (0, 0, "b", 0, "a", "code", 0.1), (0, 0, "b", 1, "c", "code", 0.2), (5, 5, "b", 0, "a", "doc", 0.3), (5, 5, "b", 1, "d", None, None))
    events = log(spark, (0, "bundle_emitted", "b", None, None, None), (1, "tool_use", "b", "a", "Edit", None), (2, "self_report", "b", "a", None, "noise"),
                 (3, "self_report", "b", "a", None, "bogus"), (4, "git_edit", "b", "d", "Edit", None), (9, "tool_use", "b", "d", "Write", None))
    got = {r.path: (r.kind, r.label, r.source, r.detail, r.label_time) for r in feedback.labels(events, ranked).collect()}
    assert got == {"a": ("doc", "noise", "self_report", "noise", at(3)), "d": ("code", "positive", "git", "Edit", at(9))}
    weighted = {r.path: round(r.weight, 4) for r in feedback.weighted_labels(feedback.labels(events, ranked), F.lit(at(9 + 60 * 24 * 30))).collect()}
    assert weighted["d"] == 0.4


def test_mark_used(spark):
    labels = spark.createDataFrame([("b", "x", "noise"), ("b", " ", "noise"), ("b", "y", "other"), ("", "z", "noise")], "bundle_id string, path string, relevance string")
    rows, counts = feedback.mark_used(labels)
    assert [r.path for r in rows.collect()] == ["x"] and [tuple(r) for r in counts.collect()] == [("b", 1, 2)]


def test_reaping_twice_reports_once(spark):
    ranked = bundle(spark, (0, 0, "b1", 0, "a", "code", 0.1), (1, 1, "b2", 0, "a", "code", 0.1), (1, 1, "b2", 1, "c", "code", 0.1))
    events = log(spark, (0, "bundle_emitted", "b1", None, None, None), (1, "bundle_emitted", "b2", None, None, None))
    edits = spark.createDataFrame([("w1", 1, "a"), ("w0", 0, "a")], "worktree string, worktree_order int, path string")
    first = feedback.reap(events, ranked, edits)
    found = first.where("event_type = 'git_edit'").collect()
    assert {(r.bundle_id, r.path, r.worktree) for r in found} == {("b1", "a", "w0"), ("b2", "a", "w0")}
    again = events.unionByName(first.select(
        F.lit("r").alias("repo"), (F.monotonically_increasing_id() + 100).alias("seq"), F.lit(at(9)).alias("event_time"), "event_type", "bundle_id",
        "path", "action", F.lit(None).cast("string").alias("relevance")))
    assert feedback.reap_summary(again, ranked, edits).first().edits_emitted == 0


def _weighted(spark, rows):
    return spark.createDataFrame(rows, "kind string, embedding_score double, label string, weight double")


def test_tuner_moves_with_the_evidence(spark):
    low = feedback.tune(_weighted(spark, [("code", 0.2, "positive", 1.0)] * 20), sigma=0.15, min_labels=5)
    fit = {r.kind: r for r in low.collect()}
    assert fit["code"].fitted_threshold == 0.2 and fit["code"].confidence == "weak" and fit["doc"].confidence == "prior_only"
    high = feedback.tune(_weighted(spark, [("code", 0.35, "noise", 1.0)] * 60), sigma=0.15, min_labels=5).where("kind = 'code'").first()
    assert high.fitted_threshold == 0.4 and high.confidence == "strong"


def test_subkinds_shrink_toward_their_parent(spark):
    rows = [("code/handler", 0.2, "positive", 1.0)] * 15 + [("code/model", 0.35, "noise", 1.0)] * 15 + [("code/cli", 0.1, "positive", 1.0)]
    fits = feedback.tune(_weighted(spark, rows))
    got = {r.kind: r for r in fits.collect()}
    assert got["code/handler"].fitted_threshold <= 0.2 < 0.35 < got["code/model"].fitted_threshold
    assert got["code/cli"].fitted_threshold == got["code"].fitted_threshold == got["code/cli"].prior_threshold
    assert {r.key for r in feedback.learned_layer(fits).collect()} == {"code", "doc", "config", "test", "code/handler", "code/model"}
