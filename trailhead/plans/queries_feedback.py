"""Feedback analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, paths
from ..operators import feedback, ranking
from .context import emitted_events, rank_sections
from .queries_rank import _corpus
from ..session import settle
from .registry import files_of, query, r6, stored_files
from .views import view


def _log(spark, sf):
    return view(spark, sf, "v_feedback"), view(spark, sf, "v_ranked")


@query("g1_bundle_events", f"""WITH {_corpus("'doc', 'code', 'config'", "v_source", "v_work")},
n AS (SELECT *, row_number() OVER (PARTITION BY task_id, kind = 'doc' ORDER BY score DESC, path) AS i FROM z WHERE worthy AND score > 0)
SELECT task_id, path, kind, score FROM n WHERE i <= CASE kind WHEN 'doc' THEN 6 ELSE 8 END""")
def bundle_events(spark, sf):
    from ..operators import graph

    files, tasks = stored_files(spark, sf), view(spark, sf, "v_work")
    sections = rank_sections(tasks, files, settle(graph.dependency_edges(files), "edges"))
    rows = emitted_events(tasks, sections).select("task_id", F.inline("ranked_paths")).where("kind <> 'test'")
    return rows.select("task_id", "path", paths.parent_kind("kind").alias("kind"), "score")


@query("g2_attribute", """
WITH u AS (SELECT seq, event_time, path, action FROM v_feedback WHERE event_type = 'tool_use' AND path IS NOT NULL),
m AS (SELECT u.seq, max(r.seq) AS hit FROM u JOIN v_ranked r ON r.path = u.path AND r.seq < u.seq AND r.seq >= u.seq - 200
  AND date_trunc('second', r.event_time) >= date_trunc('second', u.event_time - INTERVAL 30 MINUTE) GROUP BY u.seq)
SELECT u.seq, path, action, 'b' || hit AS bundle_id FROM u LEFT JOIN m USING (seq)""")
def attribute(spark, sf):
    return feedback.attribute(*_log(spark, sf)).select("seq", "path", "action", "bundle_id")


@query("g2_attribute_six_hours", """
WITH u AS (SELECT seq, event_time, path, action FROM v_feedback WHERE event_type = 'tool_use' AND path IS NOT NULL),
m AS (SELECT u.seq, max(r.seq) AS hit FROM u JOIN v_ranked r ON r.path = u.path AND r.seq < u.seq AND r.seq >= u.seq - 50
  AND date_trunc('second', r.event_time) >= date_trunc('second', u.event_time - INTERVAL 6 HOUR) GROUP BY u.seq)
SELECT u.seq, path, action, 'b' || hit AS bundle_id FROM u LEFT JOIN m USING (seq)""")
def attribute_six_hours(spark, sf):
    return feedback.attribute(*_log(spark, sf), window_seconds=6 * 3600, max_events=50).select("seq", "path", "action", "bundle_id")


@query("g3_mark_used", """
SELECT bundle_id, count(*) FILTER (relevance <> 'bogus' AND path IS NOT NULL) AS recorded, count(*) FILTER (relevance = 'bogus' OR path IS NULL) AS skipped
FROM v_feedback WHERE event_type = 'self_report' AND bundle_id IS NOT NULL GROUP BY bundle_id""")
def mark_used(spark, sf):
    reports = view(spark, sf, "v_feedback").where("event_type = 'self_report'")
    return feedback.mark_used(reports)[1]


def _edits(spark, sf):
    """Edited paths by worktree: every edit in the log, in one of three trees."""
    log = view(spark, sf, "v_feedback").where("action = 'Edit'")
    tree = (F.col("seq") % 3).cast("int")
    return log.select(F.concat(F.lit("w"), tree.cast("string")).alias("worktree"), tree.alias("worktree_order"), "path").distinct()


_REAP = """
WITH x AS (SELECT path, min('w' || seq % 3) AS worktree FROM v_feedback WHERE action = 'Edit' GROUP BY path),
n AS (SELECT DISTINCT bundle_id, path FROM v_ranked),
f AS (SELECT n.bundle_id, n.path, worktree FROM n JOIN x USING (path) WHERE (n.bundle_id, n.path) NOT IN
  (SELECT (bundle_id, path) FROM v_feedback WHERE event_type = 'git_edit' AND bundle_id IS NOT NULL)),
o AS (SELECT 'git_edit' AS event_type, bundle_id, path, worktree FROM f UNION ALL SELECT DISTINCT 'bundle_reaped', bundle_id, NULL, NULL FROM v_ranked)
"""


@query("g4_reap", _REAP + "SELECT * FROM o")
def reap(spark, sf):
    events, ranked = _log(spark, sf)
    return feedback.reap(events, ranked, _edits(spark, sf)).select("event_type", "bundle_id", "path", "worktree")


@query("g4_reap_summary", _REAP + """SELECT count(*) FILTER (event_type = 'bundle_reaped') AS bundles_scanned,
  count(*) FILTER (event_type = 'git_edit') AS edits_emitted FROM o""")
def reap_summary(spark, sf):
    events, ranked = _log(spark, sf)
    return feedback.reap_summary(events, ranked, _edits(spark, sf))


@query("g5_evaluate", """
WITH i AS (SELECT DISTINCT bundle_id, path, kind FROM v_ranked),
e AS (SELECT f.*, i.kind FROM v_feedback f LEFT JOIN i ON i.bundle_id = f.bundle_id AND i.path = f.path),
p AS (SELECT DISTINCT bundle_id, path, kind FROM e WHERE kind IS NOT NULL AND ((event_type = 'tool_use' AND action = 'Edit') OR event_type = 'git_edit' OR relevance LIKE 'informed%')),
n AS (SELECT DISTINCT bundle_id, path, kind FROM e WHERE kind IS NOT NULL AND relevance = 'noise'),
a AS (SELECT kind, 1 AS b, 0 AS p, 0 AS n, 0 AS m FROM v_ranked UNION ALL SELECT kind, 0, 1, 0, 0 FROM p UNION ALL SELECT kind, 0, 0, 1, 0 FROM n
  UNION ALL SELECT 'code/other', 0, 0, 0, 1 FROM e WHERE kind IS NULL AND event_type = 'tool_use' AND path IS NOT NULL),
t AS (SELECT coalesce(kind, 'overall') AS kind, sum(b) AS bundle_paths, sum(p) AS positives, sum(n) AS noise, sum(m) AS misses FROM a GROUP BY ROLLUP (kind))
SELECT kind, bundle_paths::BIGINT AS bundle_paths, positives::BIGINT AS positives, noise::BIGINT AS noise, misses::BIGINT AS misses,
  CASE bundle_paths WHEN 0 THEN 0 ELSE round_even(positives / bundle_paths, 4) END::DOUBLE AS precision,
  CASE positives + misses WHEN 0 THEN 0 ELSE round_even(positives / (positives + misses), 4) END::DOUBLE AS recall,
  CASE bundle_paths WHEN 0 THEN 0 ELSE round_even(noise / bundle_paths, 4) END::DOUBLE AS noise_rate FROM t""")
def evaluate(spark, sf):
    return feedback.evaluate(*_log(spark, sf))


@query("g5_eval_totals", "SELECT count(*) FILTER (event_type = 'bundle_emitted') AS bundles, count(*) AS events_total FROM v_feedback")
def eval_totals(spark, sf):
    return feedback.eval_totals(view(spark, sf, "v_feedback"))


_LABELS = """
WITH i AS (SELECT DISTINCT bundle_id, path, kind, embedding_score FROM v_ranked),
s AS (SELECT bundle_id, path, max_by(relevance, seq) AS rel FROM v_feedback WHERE relevance IN ('informed_edit', 'informed_context', 'noise') GROUP BY ALL),
d AS (SELECT bundle_id, path, min_by(CASE event_type WHEN 'git_edit' THEN 'git' ELSE 'hook' END, seq) AS src FROM v_feedback WHERE action = 'Edit' GROUP BY ALL),
t AS (SELECT bundle_id, path, max(event_time) AS label_time FROM v_feedback WHERE event_type <> 'bundle_emitted' GROUP BY ALL),
l AS (SELECT i.*, CASE WHEN rel = 'noise' THEN 'noise' WHEN rel IS NOT NULL OR src IS NOT NULL THEN 'positive' ELSE 'unlabeled' END AS label,
    CASE WHEN rel IS NOT NULL THEN 'self_report' ELSE src END AS source, coalesce(rel, CASE WHEN src IS NOT NULL THEN 'Edit' END) AS detail, label_time
  FROM i LEFT JOIN s USING (bundle_id, path) LEFT JOIN d USING (bundle_id, path) LEFT JOIN t USING (bundle_id, path)),
w AS (SELECT *, coalesce(greatest(0, (epoch_us((SELECT max(event_time) FROM v_feedback)) - epoch_us(label_time)) / 86400e6), 0) AS age FROM l),
y AS (SELECT *, CASE label WHEN 'unlabeled' THEN 0 ELSE (CASE source WHEN 'hook' THEN 1.0 WHEN 'git' THEN 0.8 ELSE CASE detail WHEN 'informed_edit' THEN 0.9 WHEN 'informed_context' THEN 0.7 ELSE 1.0 END END)
  * pow(2::DOUBLE, -age / 30) END::DOUBLE AS weight FROM w)"""


@query("g6_labels", _LABELS + "SELECT bundle_id, path, kind, embedding_score, label, source, detail FROM l")
def labels(spark, sf):
    return feedback.labels(*_log(spark, sf)).drop("label_time")


@query("g7_label_times", _LABELS + "SELECT bundle_id, path, CAST(label_time AS VARCHAR) IS NOT NULL AS timed, epoch_us(label_time) AS label_us FROM l")
def label_times(spark, sf):
    rows = feedback.labels(*_log(spark, sf))
    return rows.select("bundle_id", "path", F.col("label_time").isNotNull().alias("timed"), F.unix_micros("label_time").alias("label_us"))


def _weighted(spark, sf):
    events, ranked = _log(spark, sf)
    now = events.agg(F.max("event_time")).scalar()
    return feedback.weighted_labels(feedback.labels(events, ranked), now)


@query("g8_weighted_labels", _LABELS + "SELECT bundle_id, path, label, round(weight, 6) AS weight FROM y")
def weighted_labels(spark, sf):
    return _weighted(spark, sf).select("bundle_id", "path", "label", r6("weight"))


def _fit_sql(cells: str, prior: str) -> str:
    grid = ", ".join(f"({t}::DOUBLE)" for t in K.THRESHOLD_GRID)
    return f"""(SELECT c.kind, {prior} AS prior, count(*) FILTER (label <> 'unlabeled') AS n, coalesce(sum(weight) FILTER (label = 'positive'), 0) AS pw,
    coalesce(sum(weight) FILTER (label = 'noise'), 0) AS nw FROM {cells} c GROUP BY ALL),
  g AS (SELECT kind, t, s - pow(t - prior, 2) / (2 * 0.07 * 0.07) AS total FROM (SELECT c.kind, {prior} AS prior, t,
      sum(CASE label WHEN 'positive' THEN weight WHEN 'noise' THEN -weight ELSE 0 END * CASE WHEN embedding_score >= t THEN 1 ELSE -1 END) AS s
    FROM {cells} c, (VALUES {grid}) AS v(t) GROUP BY ALL)),
  """


_TUNE = _LABELS + """,
a AS (SELECT split_part(kind, '/', 1) AS kind, embedding_score, label, weight FROM y UNION ALL SELECT * FROM (VALUES ('code', 0, 'unlabeled', 0), ('doc', 0, 'unlabeled', 0), ('config', 0, 'unlabeled', 0), ('test', 0, 'unlabeled', 0))),
st AS """ + _fit_sql("a", "0.3::DOUBLE") + """
pf AS (SELECT st.kind, st.prior, CASE WHEN n < 10 THEN st.prior ELSE (SELECT t FROM g WHERE g.kind = st.kind ORDER BY total DESC, t LIMIT 1) END AS fit, n, pw, nw FROM st),
b AS (SELECT y.kind, embedding_score, label, weight, fit AS p FROM y JOIN pf ON pf.kind = split_part(y.kind, '/', 1) WHERE contains(y.kind, '/')),
st2 AS """ + _fit_sql("b", "p").replace("g AS (", "g2 AS (") + """
sf AS (SELECT st2.kind, st2.prior, CASE WHEN n < 10 THEN st2.prior ELSE (SELECT t FROM g2 WHERE g2.kind = st2.kind ORDER BY total DESC, t LIMIT 1) END AS fit, n, pw, nw FROM st2),
fits AS (SELECT *, CASE WHEN n < 10 THEN 'prior_only' WHEN n >= 50 THEN 'strong' ELSE 'weak' END AS confidence FROM (SELECT * FROM pf UNION ALL SELECT * FROM sf))
"""


@query("g9_tune", _TUNE + """SELECT kind, prior AS prior_threshold, fit AS fitted_threshold, n AS label_count, round(pw, 6) AS positive_weight,
  round(nw, 6) AS noise_weight, confidence FROM fits WHERE NOT contains(kind, '/')""")
def tune(spark, sf):
    fits = feedback.tune(_weighted(spark, sf)).where("not contains(kind, '/')")
    return fits.withColumn("positive_weight", r6("positive_weight")).withColumn("noise_weight", r6("noise_weight"))


@query("g10_tune_subkinds", _TUNE + """SELECT kind, prior AS prior_threshold, fit AS fitted_threshold, n AS label_count, round(pw, 6) AS positive_weight,
  round(nw, 6) AS noise_weight, confidence FROM fits WHERE contains(kind, '/')""")
def tune_subkinds(spark, sf):
    fits = feedback.tune(_weighted(spark, sf)).where("contains(kind, '/')")
    return fits.withColumn("positive_weight", r6("positive_weight")).withColumn("noise_weight", r6("noise_weight"))


@query("g11_learned_thresholds", _TUNE + """
SELECT key, coalesce(l.q, 0.3)::DOUBLE AS qualify FROM (SELECT kind AS key, round_even(fit, 4) AS q FROM fits WHERE NOT contains(kind, '/') OR confidence <> 'prior_only'
  UNION ALL SELECT '_default', 0.3) l""")
def learned_thresholds(spark, sf):
    base = ranking.default_thresholds(spark).select(F.lit("default").alias("source"), "key", "qualify", "tiebreak")
    layers = feedback.apply_layer(base, feedback.learned_layer(feedback.tune(_weighted(spark, sf))))
    return ranking.merge_thresholds(layers).select("key", "qualify")
