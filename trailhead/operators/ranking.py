"""Ranking of documents and files for batches of tasks.

The corpus is inverted: distinct (file, token) rows meet the tasks' tokens in an equi-join on (repo, token). Which pairs of a task and a
file are formed at all is decided by bounds on their scores (:mod:`impact`). Pairs that share nothing are never formed; the two groups
that may rank without a shared token — files similar by vector, and high-value documents — take part as given pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K, paths, scoring, text as T
from ..session import settle
from . import impact
from .skew import fits, shuffled, top_k, union_all

HIGH_DOC_SCORE = 12.0
MAX_BROADCAST_TASKS = 20_000    # tasks whose ranked rows (at most 8 each) may be broadcast; about 30 MB
MAX_BROADCAST_FACTS = 60_000    # files whose facts go to the scored pairs; about 20 MB
MAX_BROADCAST_BYTES = 8 << 20   # of their texts, whose words go with each ranked row

_LAYERS = {"default": 0, "file": 1, "learned": 2, "env": 3}


# ---- thresholds ------------------------------------------------------------------------------------------------------


def default_thresholds(spark) -> DataFrame:
    rows = [(k, K.DEFAULT_THRESHOLD, K.DEFAULT_TIEBREAK) for k in [*K.KNOWN_KINDS, "_default"]]
    return spark.createDataFrame(rows, "key string, qualify double, tiebreak double")


def merge_thresholds(layers: DataFrame) -> DataFrame:
    """One (key, qualify, tiebreak) row per key from (source, key, qualify, tiebreak) layers.

    Later layers win: default, file, learned, env. Unknown kinds and values that are no numbers are dropped; the env
    layer takes plain kinds only, in any case.
    """
    known = [*K.KNOWN_KINDS, "_default"]
    key = F.when(F.col("source") == "env", F.lower("key")).otherwise(F.col("key"))
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(p)) for s, p in _LAYERS.items()])
    rows = layers.select(
        key.alias("key"), rank.alias("rank"), F.col("source"),
        F.col("qualify").cast("string").try_cast("double").alias("q"),
        F.col("tiebreak").cast("string").try_cast("double").alias("t"),
    )
    nested = F.col("key").contains("/") & paths.parent_kind("key").isin(K.KNOWN_KINDS) & (F.col("source") != "env")
    valid = rows.where((F.col("key").isin(known) | nested) & F.col("rank").isNotNull())

    def latest(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("rank")))

    return valid.groupBy("key").agg(latest("q").alias("qualify"), latest("t").alias("tiebreak"))


def resolve_thresholds(df: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Add ``qualify`` and ``tiebreak``: the first present of kind/subkind, kind and ``_default``, else 0.3 and 0.05."""
    if thresholds is None:
        return df.withColumn("qualify", F.lit(K.DEFAULT_THRESHOLD)).withColumn("tiebreak", F.lit(K.DEFAULT_TIEBREAK))

    def keyed(name: str, tag: str) -> DataFrame:
        return thresholds.select(F.col("key").alias(name), F.col("qualify").alias(f"_q{tag}"), F.col("tiebreak").alias(f"_t{tag}"))

    fallback = thresholds.where("key = '_default'").agg(F.max("qualify").alias("q"), F.max("tiebreak").alias("t"))
    out = df.withColumn("_full", paths.full_kind("kind", "subkind"))
    out = out.join(keyed("_full", "1"), "_full", "left").join(keyed("kind", "2"), "kind", "left")
    return (
        out.withColumn("qualify", F.coalesce("_q1", "_q2", fallback.select("q").scalar(), F.lit(K.DEFAULT_THRESHOLD)))
        .withColumn("tiebreak", F.coalesce("_t1", "_t2", fallback.select("t").scalar(), F.lit(K.DEFAULT_TIEBREAK)))
        .drop("_full", "_q1", "_q2", "_t1", "_t2")
    )


# ---- evidence --------------------------------------------------------------------------------------------------------


def task_terms(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", "repo", F.explode(T.token_set("task")).alias("token"))


def file_terms(files: DataFrame) -> DataFrame:
    """One row per file, field group and distinct token, with the fields it occurs in."""
    name, path, content = T.token_set(paths.name("path")), T.token_set("path"), T.token_set("content")
    zero, one = F.lit(0), F.lit(1)
    in_content = F.transform(content, lambda t: F.struct(
        t.alias("token"), zero.alias("n_name"), zero.alias("n_path"), one.alias("n_content")))
    in_path = F.transform(path, lambda t: F.struct(
        t.alias("token"), F.array_contains(name, t).cast("int").alias("n_name"), one.alias("n_path"), zero.alias("n_content")))
    carried = ["repo", "path", "kind", "subkind", "doc_score", "qualify", "tiebreak"]
    return files.select(*carried, F.inline(F.concat(in_content, in_path)))


def _facts(files: DataFrame) -> DataFrame:
    """What files are scored by, as a stored table. Else Spark infers the files' filters for the paths of the pairs they meet, and
    works a kind out of each pair's path."""
    return settle(files.select("repo", "path", *impact.FACTS), "facts")


def _given(pairs: DataFrame, facts: DataFrame, e: Column) -> DataFrame:
    """Pairs (task_id, repo, path) that take part whatever tokens they share, with their files' facts and vector score."""
    side = F.broadcast(facts) if fits(facts, MAX_BROADCAST_FACTS) else shuffled(facts)
    return pairs.select("task_id", "repo", "path", e.cast("double").alias("e")).join(side, ["repo", "path"])


def _best(tasks: DataFrame, files: DataFrame, emb: DataFrame | None, judge: impact.Judge, k: int, extra: DataFrame | None = None,
          report: dict | None = None, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` judged pairs per task, and all judged pairs formed; see :func:`impact.best_pairs`."""
    none, given = F.lit(None).cast("double"), None
    if emb is not None or extra is not None:
        facts = _facts(files) if facts is None else facts
        parts = [] if emb is None else [_given(emb, facts, F.col("score"))]
        parts += [] if extra is None else [_given(extra, facts, none)]
        given = settle(union_all(parts), "given")       # read by several steps
    return impact.best_pairs(file_terms(files), task_terms(tasks), judge, k, given, no_score=None if emb is None else 0.0, report=report)


def _bytes(tasks: DataFrame) -> int:
    return tasks.agg(F.sum(F.octet_length("task"))).first()[0] or 0


def _with_text(winners: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Fetch the text of ranked rows. While the tasks are few the rows go to the texts, so no text is shuffled."""
    texts = files.select("repo", "path", "content")
    # Up to eight winners a task travel with the task's words; both the rows and the bytes are checked.
    small = F.broadcast(winners) if fits(tasks, MAX_BROADCAST_TASKS) and _bytes(tasks) <= MAX_BROADCAST_BYTES else winners
    return texts.join(small, ["repo", "path"])


def _explain(ranked: DataFrame, files: DataFrame, tasks: DataFrame, overlap: Column, default: str) -> DataFrame:
    """Add reason and snippet to the few rows that made the cut."""
    words = tasks.select("task_id", T.token_set("task").alias("task_tokens"))
    winners = ranked.join(words, "task_id")
    shown = _with_text(winners, files, tasks).withColumn("overlap", F.array_sort(overlap))
    return shown.select(
        "task_id", "repo", "path", "rank", "score", F.col("h").alias("heuristic_score"),
        F.coalesce("e", F.lit(0.0)).alias("embedding_score"), "kind", "subkind", "overlap",
        T.reason("overlap", "e", "qualify", default).alias("reason"), T.snippet("content", "overlap").alias("snippet"),
    )


def _shared(text: Column | str) -> Column:
    return F.array_intersect("task_tokens", T.token_set(text))


def rank_documents(
    tasks: DataFrame, files: DataFrame, emb: DataFrame | None = None, k: int = 6, thresholds: DataFrame | None = None,
    report: dict | None = None,
) -> DataFrame:
    """Best ``k`` documents per task. ``tasks`` is (task_id, repo, task); ``emb`` is (task_id, repo, path, score).

    ``report`` receives the numbers of pairs and bounds that were formed.
    """
    docs = resolve_thresholds(files.where(F.col("kind") == "doc"), thresholds)
    # A high-value document ranks even without evidence. It then scores its own value, so of those only the best k per
    # repo can be among a task's best k: any other is beaten by k documents that score at least as much.
    own = scoring.blend("doc_score", F.lit(0.0) if emb is not None else F.lit(None).cast("double"), "tiebreak")
    high = docs.where(F.col("doc_score") >= HIGH_DOC_SCORE).drop("content").withColumn("own", own)
    high = top_k(high, ["repo"], [F.col("own").desc(), "path"], k, "_n")
    extra = high.select("repo", "path").join(tasks.select("task_id", "repo"), "repo")

    def judge(pairs: DataFrame) -> DataFrame:
        h = F.col("doc_score") + 4.0 * F.col("n_path") + F.col("n_content")
        similar = F.coalesce(F.col("e") >= F.col("qualify"), F.lit(False))
        worthy = (F.col("n_path") > 0) | (F.col("n_content") >= 2) | (F.col("doc_score") >= HIGH_DOC_SCORE)
        scored = pairs.withColumn("h", h).withColumn("score", scoring.blend("h", "e", "tiebreak"))
        return scored.withColumn("ok", (similar | worthy) & (F.col("score") > 0))

    ranked, _ = _best(tasks, docs, emb, judge, k, extra, report)
    overlap = F.array_intersect("task_tokens", F.array_union(T.token_set("path"), T.token_set("content")))
    return _explain(ranked, files, tasks, overlap, "High-value documentation for repository context")


def _judge_files(pairs: DataFrame) -> DataFrame:
    h = 6.0 * F.col("n_name") + 3.0 * F.col("n_path") + F.col("n_content")
    h = F.when(F.col("kind") == "config", h * 0.5).otherwise(h)
    named = (F.col("n_name") > 0) | (F.col("n_path") > 0) | (F.col("n_content") >= 2)
    scored = pairs.withColumn("h", h).withColumn("score", scoring.blend("h", "e", "tiebreak")).withColumn("lexical", named).withColumn(
        "similar", F.coalesce(F.col("e") >= F.col("qualify"), F.lit(False)))
    return scored.withColumn("ok", (F.col("similar") | F.col("lexical")) & (F.col("score") > 0))


def _able(files: DataFrame, thresholds: DataFrame | None) -> DataFrame:
    return resolve_thresholds(files.where(F.col("kind").isin("code", "config")), thresholds)


def _scored(emb: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a pair (task_id, repo, path) of ``emb`` and a file of ``facts``: its ``score``, with the file's thresholds."""
    return _given(emb, facts, F.col("score")).groupBy("task_id", "repo", "path").agg(
        F.max("e").alias("score"), F.max("qualify").alias("qualify"), F.max("tiebreak").alias("tiebreak"))


def contenders(scored: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    """The pairs of ``scored`` that may be among a task's best ``k``.

    A pair's words move its score by less than the tie-break weight. Similar pairs rank whatever words they share, so a pair whose score stays
    below that of a task's k-th similar one can't rank, whatever its words, and also not with a similarity of 0 in place of its own.
    """
    e, weight = F.greatest(F.lit(0.0), F.col("score")), F.col("tiebreak")
    sure = scored.withColumn("low", e + F.least(F.lit(0.0), weight)).where((F.col("score") >= F.col("qualify")) & (F.col("low") > 0))
    last = top_k(sure, ["task_id"], [F.col("low").desc()], k).where(F.col("rank") == k).select("task_id", F.col("low").alias("_low"))
    if fits(tasks, MAX_BROADCAST_TASKS):
        last = F.broadcast(last)
    beaten = e + F.greatest(F.lit(0.0), weight) < F.col("_low")
    return scored.join(last, "task_id", "left").where(~F.coalesce(beaten, F.lit(False))).drop("_low")


def _best_files(tasks: DataFrame, files: DataFrame, emb: DataFrame | None, k: int, thresholds: DataFrame | None, report: dict | None = None,
                facts: DataFrame | None = None):
    return _best(tasks, _able(files, thresholds), emb, _judge_files, k, report=report, facts=facts)


def _file_overlap() -> Column:
    name, path, content = _shared(paths.name("path")), _shared("path"), _shared("content")
    return F.when(F.size(name) > 0, name).when(F.size(path) > 0, path).otherwise(content)


def explored_tasks(tasks: DataFrame, epsilon: float, seed: int = 0) -> DataFrame:
    """Tasks drawn for exploration: a reproducible draw per task instead of a random number."""
    draw = F.pmod(F.xxhash64("task_id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return tasks.where(draw < F.lit(float(epsilon)))


def explore(pairs: DataFrame, tasks: DataFrame, files: DataFrame, epsilon: float, seed: int = 0, probes: int = 2) -> DataFrame:
    """The best below-threshold candidates of the drawn tasks, scored by their raw similarity."""
    drawn = explored_tasks(tasks, epsilon, seed).select("task_id")
    near = pairs.where(~F.col("similar") & ~F.col("lexical") & (F.col("e") > 0)).join(drawn, "task_id", "left_semi")
    best = top_k(near, ["task_id"], [F.col("e").desc(), "path"], probes)
    shown = _with_text(best, files, tasks)
    none = F.array().cast("array<string>")
    return shown.select(
        "task_id", "repo", "path", "rank", F.col("e").alias("score"), F.col("h").alias("heuristic_score"),
        F.col("e").alias("embedding_score"), "kind", "subkind", none.alias("overlap"),
        F.format_string("Exploration probe (cosine %.2f below threshold %.2f)", "e", "qualify").alias("reason"),
        T.snippet("content", none).alias("snippet"),
    )


def rank_files(
    tasks: DataFrame, files: DataFrame, emb: DataFrame | None = None, k: int = 8, thresholds: DataFrame | None = None,
    epsilon: float = 0.05, seed: int = 0, report: dict | None = None,
) -> DataFrame:
    """Best ``k`` code and config files per task, plus exploration probes when vector scores are given.

    Vector scores may be given for all tasks × files: only those of files that can rank meet the words.
    """
    facts = None if emb is None else _facts(_able(files, thresholds))
    scored = None if emb is None else settle(_scored(emb, facts), "scores")
    ranked, _ = _best_files(tasks, files, None if emb is None else contenders(scored, tasks, k), k, thresholds, report, facts)
    out = _explain(ranked, files, tasks, _file_overlap(), "Task tokens align with file name and content")
    if emb is None or epsilon <= 0:
        return out
    sizes = out.groupBy("task_id").agg(F.max("rank").alias("_last"))
    probes = exploration_probes(tasks, files, scored, epsilon, seed, thresholds, facts).join(sizes, "task_id", "left")
    probes = probes.withColumn("rank", F.col("rank") + F.coalesce("_last", F.lit(0))).drop("_last")
    return out.unionByName(probes)


def exploration_probes(
    tasks: DataFrame, files: DataFrame, emb: DataFrame, epsilon: float = 0.05, seed: int = 0,
    thresholds: DataFrame | None = None, facts: DataFrame | None = None,
) -> DataFrame:
    """The probes alone. Only pairs of drawn tasks with a similarity above 0 can be probes, so no others are formed."""
    able, drawn = _able(files, thresholds), explored_tasks(tasks, epsilon, seed)
    near = _given(emb.where("score > 0").join(drawn, "task_id", "left_semi"), _facts(able) if facts is None else facts, F.col("score"))
    return explore(impact.given_pairs(file_terms(able), task_terms(drawn), _judge_files, near), tasks, files, epsilon, seed)
