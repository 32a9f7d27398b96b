"""Feedback analytics: attribution, evaluation, labels and threshold tuning.

``events`` is the feedback log (seq, event_time, event_type, bundle_id, path, action, relevance), ``ranked`` its bundle
entries one per row (seq, event_time, bundle_id, pos, path, kind, embedding_score, …). ``seq`` numbers the log's rows
without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths, scoring, text as T
from .skew import salted_join, union_all

LABEL_EVENTS = ["tool_use", "self_report", "git_edit"]


def explode_bundles(events: DataFrame) -> DataFrame:
    """Bundle entries of the log, one row per ranked path."""
    emitted = events.where("event_type = 'bundle_emitted'")
    carried = [c for c in ("repo", "seq", "event_time", "bundle_id") if c in events.columns]
    rows = emitted.select(*carried, F.posexplode("ranked_paths").alias("pos", "_e"))
    return rows.select(*carried, "pos", "_e.*").where("path is not null")


def bundle_events(ranked: DataFrame, tasks: DataFrame, ranker: str = "lexical") -> DataFrame:
    """``bundle_emitted`` rows: everything ranked for a task (files, then docs, then tests), with kinds and scores.

    ``ranked`` is (task_id, section, rank, path, kind, subkind, score, heuristic_score, embedding_score), section 0, 1, 2.
    """
    kind = paths.full_kind(F.coalesce(F.nullif("kind", F.lit("")), F.lit("code")), "subkind")
    entry = F.struct("section", "rank", F.struct(
        "path", kind.alias("kind"), F.col("score").cast("double").alias("score"), F.coalesce("heuristic_score", F.lit(0.0)).alias("heuristic_score"),
        F.coalesce("embedding_score", F.lit(0.0)).alias("embedding_score")).alias("e"))
    listed = ranked.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("_l"))
    out = tasks.join(listed, "task_id", "left")
    empty = F.array().cast("array<struct<path:string,kind:string,score:double,heuristic_score:double,embedding_score:double>>")
    return out.select(
        F.lit("bundle_emitted").alias("event_type"), "repo", "task_id",
        F.left(F.sha2(F.concat_ws("|", "repo", F.col("task_id").cast("string"), "task"), 256), F.lit(16)).alias("bundle_id"),
        F.col("task").alias("task_raw"), F.coalesce(F.transform("_l", lambda x: x["e"]), empty).alias("ranked_paths"),
        F.lit(ranker).alias("ranker"), F.lit("internal").alias("source"),
    )


def attribute(events: DataFrame, ranked: DataFrame, window_seconds: int = 1800, max_events: int = 200) -> DataFrame:
    """For each tool use, the newest bundle before it that holds its path, within both bounds; else null.

    A match lies at most ``max_events`` log rows back, so the log is cut into blocks of that many rows and each bundle
    entry is offered to its own block and the next. The as-of window then runs inside (path, block): it never holds
    more than two blocks of log rows, however hot the path is. Times count in whole seconds and rise with ``seq``.
    """
    from pyspark.sql import Window as W

    block = F.floor(F.col("seq") / F.lit(max_events))
    shown = ranked.select("repo", "path", "seq", F.struct("seq", "event_time", "bundle_id").alias("b"))
    offered = shown.withColumn("block", F.explode(F.array(block, block + 1)))
    uses = events.where("event_type = 'tool_use' and path is not null").select(
        "repo", "path", "seq", "event_time", "action", block.alias("block"))
    merged = uses.unionByName(offered, allowMissingColumns=True)
    earlier = W.partitionBy("repo", "path", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    held = merged.withColumn("_b", F.last("b", ignorenulls=True).over(earlier)).where("b is null")
    cutoff = F.date_trunc("second", F.col("event_time") - F.expr(f"interval {window_seconds} seconds"))
    near = (F.col("seq") - F.col("_b.seq") <= max_events) & (F.date_trunc("second", F.col("_b.event_time")) >= cutoff)
    return held.select("repo", "seq", "event_time", "path", "action", F.when(near, F.col("_b.bundle_id")).alias("bundle_id"))


def mark_used(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(self_report events of the valid labels, recorded and skipped counts per bundle)."""
    blank = F.coalesce(T.strip("path"), F.lit("")) == ""
    valid = ~blank & F.coalesce(F.col("relevance").isin(K.RELEVANCES), F.lit(False))
    checked = labels.where(F.coalesce("bundle_id", F.lit("")) != "").withColumn("_ok", valid)
    rows = checked.where("_ok").drop("_ok").withColumn("event_type", F.lit("self_report")).withColumn("source", F.lit("self_report"))
    counts = checked.groupBy("bundle_id").agg(F.count_if("_ok").alias("recorded"), F.count_if(~F.col("_ok")).alias("skipped"))
    return rows, counts


def bundle_index(ranked: DataFrame) -> DataFrame:
    """(bundle_id, path) with the entry that counts: of a repeated bundle id the last emission, of a path its last entry."""
    last = ranked.groupBy("bundle_id").agg(F.max("seq").alias("seq"))
    facts = [c for c in ranked.columns if c not in ("bundle_id", "path", "seq", "pos", "event_time", "repo")]
    latest = salted_join(ranked, last, ["bundle_id", "seq"], ["path", "pos"], "left_semi")
    return latest.groupBy("bundle_id", "path").agg(
        F.max_by(F.struct(*facts), "pos").alias("_e"), F.max("seq").alias("emitted_seq")
    ).select("bundle_id", "path", "emitted_seq", "_e.*")


def reap(events: DataFrame, ranked: DataFrame, edits: DataFrame) -> DataFrame:
    """``git_edit`` events for bundle paths edited in any worktree, not yet recorded, and one ``bundle_reaped`` per bundle.

    ``edits`` is (worktree, worktree_order, path). A path edited in several worktrees is reported from the first.
    """
    once = edits.groupBy("path").agg(F.min_by("worktree", "worktree_order").alias("worktree"))
    index = bundle_index(ranked).select("bundle_id", "path", "emitted_seq")
    seen = events.where("event_type = 'git_edit'").groupBy("bundle_id", "path").agg(F.max("seq").alias("_seen"))
    fresh = salted_join(index, once, ["path"], ["bundle_id"]).join(seen, ["bundle_id", "path"], "left").where(
        "_seen is null or _seen < emitted_seq")
    found = fresh.select(F.lit("git_edit").alias("event_type"), "bundle_id", "path", "worktree", F.lit("Edit").alias("action"))
    emitted = events.where("event_type = 'bundle_emitted' and coalesce(bundle_id, '') <> ''").select("bundle_id").distinct()
    absent = F.lit(None).cast("string")
    closed = emitted.select(F.lit("bundle_reaped").alias("event_type"), "bundle_id", absent.alias("path"),
                            absent.alias("worktree"), absent.alias("action"))
    return found.unionByName(closed).withColumn("source", F.lit("git"))


def reap_summary(events: DataFrame, ranked: DataFrame, edits: DataFrame) -> DataFrame:
    """How many bundles were scanned and edits emitted."""
    return reap(events, ranked, edits).agg(
        F.count_if(F.col("event_type") == "bundle_reaped").alias("bundles_scanned"),
        F.count_if(F.col("event_type") == "git_edit").alias("edits_emitted"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.bround(top / bottom, 4))


def evaluate(events: DataFrame, ranked: DataFrame, since: Column | None = None) -> DataFrame:
    """Precision, recall and noise rate per kind and ``overall``.

    Label events are first reduced to one row per (bundle, path), so no hot pair reaches the join in full.
    """
    if since is not None:
        keep = F.col("event_time").isNull() | (F.col("event_time") >= since)
        events, ranked = events.where(keep), ranked.where(keep)
    is_use = F.col("event_type") == "tool_use"
    good = (
        (is_use & F.col("action").isin(K.EDIT_ACTIONS)) | (F.col("event_type") == "git_edit")
        | ((F.col("event_type") == "self_report") & F.col("relevance").isin(K.POSITIVE_RELEVANCES))
    )
    noise = (F.col("event_type") == "self_report") & (F.col("relevance") == "noise")
    touched = events.where(F.col("event_type").isin(LABEL_EVENTS) & F.col("path").isNotNull()).groupBy("bundle_id", "path").agg(
        F.count_if(is_use).alias("uses"), F.max(F.coalesce(good, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(noise, F.lit(False)).cast("int")).alias("noise"))
    index = bundle_index(ranked).select("bundle_id", "path", F.col("kind").alias("bundle_kind"))
    joined = touched.join(index, ["bundle_id", "path"], "left")
    inside = F.col("bundle_kind").isNotNull()
    labelled = joined.select(
        F.when(inside, F.col("bundle_kind")).otherwise(paths.miss_kind("path")).alias("kind"),
        F.lit(0).cast("long").alias("bundle_paths"),
        F.when(inside, F.col("good")).otherwise(0).cast("long").alias("positives"),
        F.when(inside, F.col("noise")).otherwise(0).cast("long").alias("noise"),
        F.when(inside, F.lit(0)).otherwise(F.col("uses")).cast("long").alias("misses"),
    ).where("positives + noise + misses > 0")
    zero = F.lit(0).cast("long")
    shipped = ranked.select("kind", F.lit(1).cast("long").alias("bundle_paths"), zero.alias("positives"), zero.alias("noise"),
                            zero.alias("misses"))
    names = ["bundle_paths", "positives", "noise", "misses"]
    totals = shipped.unionByName(labelled).rollup("kind").agg(*[F.sum(n).alias(n) for n in names], F.grouping("kind").alias("_all"))
    out = totals.withColumn("kind", F.when(F.col("_all") == 1, "overall").otherwise(F.col("kind"))).fillna(0, names)
    p, b, n, m = (F.col(c) for c in ("positives", "bundle_paths", "noise", "misses"))
    return out.select("kind", *names, _ratio(p, b).alias("precision"), _ratio(p, p + m).alias("recall"),
                      _ratio(n, b).alias("noise_rate"))


def eval_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(F.col("event_type") == "bundle_emitted").alias("bundles"), F.count("*").alias("events_total"))


def labels(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per bundled path with its label: the last valid self report, else the first edit, else ``unlabeled``.

    ``label_time`` is the latest time of any use, report or edit of the pair.
    """
    kind = F.col("event_type")
    report = (kind == "self_report") & F.col("relevance").isin(K.RELEVANCES)
    edit = ((kind == "tool_use") & F.col("action").isin(K.EDIT_ACTIONS)) | (kind == "git_edit")
    origin = F.struct(
        F.when(kind == "git_edit", "git").otherwise("hook").alias("source"),
        F.when(kind == "git_edit", "Edit").otherwise(F.col("action")).alias("detail"))
    pairs = events.where(kind.isin(LABEL_EVENTS) & F.col("path").isNotNull() & F.col("bundle_id").isNotNull()).groupBy(
        "bundle_id", "path").agg(
        F.max_by("relevance", F.when(report, F.col("seq"))).alias("report"),
        F.min_by(origin, F.when(edit, F.col("seq"))).alias("edit"),
        F.max("event_time").alias("label_time"))
    out = bundle_index(ranked).join(pairs, ["bundle_id", "path"], "left")
    label = F.when(F.col("report") == "noise", "noise").when(
        F.col("report").isNotNull() | F.col("edit").isNotNull(), "positive").otherwise("unlabeled")
    return out.select(
        "bundle_id", "path", F.coalesce("kind", F.lit("code")).alias("kind"),
        F.coalesce(F.col("embedding_score").cast("double"), F.lit(0.0)).alias("embedding_score"), label.alias("label"),
        F.when(F.col("report").isNotNull(), "self_report").otherwise(F.col("edit.source")).alias("source"),
        F.coalesce("report", "edit.detail").alias("detail"), "label_time",
    )


def weighted_labels(labelled: DataFrame, now: Column, half_life: float = K.HALF_LIFE_DAYS) -> DataFrame:
    aged = labelled.withColumn("age_days", scoring.age_days("label_time", now))
    return aged.withColumn("weight", scoring.label_weight("label", "source", "detail", "age_days", half_life))


# ---- tuning ----------------------------------------------------------------------------------------------------------


def _fit(cells: DataFrame, sigma: float, min_labels: int, grid: list[float]) -> DataFrame:
    """Best threshold per cell (kind, prior, label rows): data score plus a Gaussian prior, over a fixed grid.

    All grid points are summed in one aggregation, so the labels are neither repeated nor gathered.
    """
    known = F.col("label").isin("positive", "noise")
    signed = F.when(F.col("label") == "positive", F.col("weight")).when(F.col("label") == "noise", -F.col("weight"))
    sums = [F.sum(F.when(F.col("embedding_score") >= t, signed).otherwise(-signed)) for t in grid]
    stats = cells.groupBy("kind", "prior_threshold").agg(
        F.count_if(known).alias("label_count"),
        F.coalesce(F.sum(F.when(F.col("label") == "positive", F.col("weight"))), F.lit(0.0)).alias("positive_weight"),
        F.coalesce(F.sum(F.when(F.col("label") == "noise", F.col("weight"))), F.lit(0.0)).alias("noise_weight"),
        F.array(*sums).alias("_scores"),
    )
    points = F.array(*[F.lit(t) for t in grid])
    gap = lambda t: t - F.col("prior_threshold")
    totals = F.zip_with("_scores", points, lambda s, t: F.struct(
        (s - gap(t) * gap(t) / F.lit(2 * sigma * sigma)).alias("total"), (-t).alias("neg"), t.alias("t")))
    thin = F.col("label_count") < min_labels
    return stats.select(
        "kind", "prior_threshold",
        F.when(thin, F.col("prior_threshold")).otherwise(F.array_max(totals)["t"]).alias("fitted_threshold"),
        "label_count", "positive_weight", "noise_weight",
        F.when(thin, "prior_only").when(F.col("label_count") >= K.STRONG_LABELS, "strong").otherwise("weak").alias("confidence"),
    )


def tune(
    weighted: DataFrame, base: dict[str, float] | None = None, sigma: float = K.PRIOR_SIGMA, min_labels: int = K.MIN_LABELS,
    grid: list[float] | None = None,
) -> DataFrame:
    """Fitted thresholds: parent kinds on all their labels, then each subkind with its parent's fit as prior."""
    grid = grid or K.THRESHOLD_GRID
    base = base or {**{k: K.DEFAULT_THRESHOLD for k in K.KNOWN_KINDS}, "_default": K.DEFAULT_THRESHOLD}
    prior = F.lit(base.get("_default", K.DEFAULT_THRESHOLD))
    for k, v in base.items():
        if k != "_default":
            prior = F.when(F.col("kind") == k, F.lit(v)).otherwise(prior)
    rows = weighted.select("kind", "embedding_score", "label", "weight")
    listed = weighted.sparkSession.createDataFrame([(k,) for k in base if k != "_default"], "kind string").select(
        "kind", F.lit(0.0).alias("embedding_score"), F.lit("unlabeled").alias("label"), F.lit(0.0).alias("weight"))
    parents = rows.withColumn("kind", paths.parent_kind("kind")).unionByName(listed).withColumn("prior_threshold", prior)
    parent_fits = _fit(parents, sigma, min_labels, grid)
    fitted = parent_fits.select(F.col("kind").alias("parent"), F.col("fitted_threshold").alias("prior_threshold"))
    nested = rows.where(F.col("kind").contains("/")).withColumn("parent", paths.parent_kind("kind"))
    return parent_fits.unionByName(_fit(nested.join(fitted, "parent").drop("parent"), sigma, min_labels, grid))


def learned_layer(fits: DataFrame) -> DataFrame:
    """The fits as a ``learned`` threshold layer; subkinds that kept their prior are left to their parent."""
    kept = fits.where(~F.col("kind").contains("/") | (F.col("confidence") != "prior_only"))
    return kept.select(
        F.lit("learned").alias("source"), F.col("kind").alias("key"),
        F.bround("fitted_threshold", 4).alias("qualify"), F.lit(None).cast("double").alias("tiebreak"))


def apply_layer(layers: DataFrame, learned: DataFrame) -> DataFrame:
    """Threshold layers with the learned qualify values replaced and everything else kept."""
    other = layers.where("source <> 'learned'")
    kept = layers.where("source = 'learned' and tiebreak is not null").withColumn("qualify", F.lit(None).cast("double"))
    return union_all([f.select("source", "key", F.col("qualify").cast("string"), F.col("tiebreak").cast("string"))
                      for f in (other, kept, learned)])
