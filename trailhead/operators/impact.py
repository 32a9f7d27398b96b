"""Exact best-k files per task without the pairs of frequent tokens.

A (task, file) pair is worth forming only if it can be among a task's best k. Three bounds decide that, each on rows that don't grow
with tasks × files:

1. **Lists.** The files that hold a token in one way (in the content, in the path, in the name) are a list, and all files of a list gain the
   same counts by it. Per task the shortest lists, up to ``seed_pairs`` files in all, are paired; their pairs are counted in full, and
   the k-th best gives the task a threshold.
2. **Shelves.** Files of a repo that are scored alike (same kind, own value and thresholds) are a shelf. A file without any short list holds at
   most the task's other lists, so the score of their summed counts bounds every such file; shelves that stay below the threshold end there.
3. **Blocks.** What is left is bounded the same way by blocks of ``block_files`` files that follow each other by path. Per task blocks are opened
   by falling bound and rising path, a few at first and then four times as many, until the threshold stops them all.

A block with a bound equal to the threshold is opened only if its first path comes before the k-th file's, for ties go to the smaller path.
So results equal those of all pairs. Where all pairs are few (``direct_pairs``, counted from the lists' lengths) they are simply formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .skew import fits, salted_join, top_k, union_all

FACTS = ["kind", "subkind", "doc_score", "qualify", "tiebreak"]
COUNTS = ["n_name", "n_path", "n_content"]
LIST = ["repo", "token", *COUNTS]
PAIR = ["task_id", "repo", "path"]

DIRECT_PAIRS = 4_000_000        # (task, token, file) rows that are formed without bounds; about 200 MB shuffled
SEED_PAIRS = 256                # files of short lists, a task
BLOCK_FILES = 64
MAX_BROADCAST_TERMS = 200_000   # (task, token) rows; about 20 MB

#: Adds ``score`` and boolean ``ok`` to pairs with FACTS, COUNTS and ``e``. Both may only rise with the counts.
Judge = Callable[[DataFrame], DataFrame]


def meet(terms: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Join postings with the few rows that want them, spread where a key is hot."""
    if fits(wanted, MAX_BROADCAST_TERMS):
        return terms.join(F.broadcast(wanted), on)
    return salted_join(terms, wanted, on, spread_by=["path"])


def _summed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and COUNTS of what a file's ``sets`` share with a task's ``tokens``."""
    shared = F.transform("sets", lambda x: F.struct(*[x[c].alias(c) for c in COUNTS], (x["times"] * F.size(F.array_intersect(x["tokens"], F.col("tokens")))).alias("n")))
    sums = [F.aggregate("_shared", F.lit(0).cast("long"), lambda s, x: s + x[c] * x["n"]).cast("double").alias(c) for c in COUNTS]
    return rows.withColumn("_shared", shared).select(*keep, *sums)


def _by_file(held: DataFrame) -> DataFrame:
    """(repo, path, FACTS, sets): a file's rows as sets of distinct tokens that occur ``times`` with the same COUNTS."""
    file = ["repo", "path", *FACTS]
    rows = held.repartition("repo", "path").groupBy(*file, *COUNTS, "token").agg(F.count("*").alias("times"))
    alike = rows.groupBy(*file, *COUNTS, "times").agg(F.collect_list("token").alias("tokens"))
    return alike.groupBy(*file).agg(F.collect_list(F.struct(*COUNTS, "times", "tokens")).alias("sets"))


def all_pairs(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every (task, file) that shares a token, with its counts."""
    met = meet(postings, wanted, ["repo", "token"])
    return met.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in FACTS], *[F.sum(c).cast("double").alias(c) for c in COUNTS])


def given_pairs(postings: DataFrame, wanted: DataFrame, judge: Judge, given: DataFrame) -> DataFrame:
    """The ``given`` pairs (PAIR, FACTS, e), one row a pair, judged by all tokens they share. No other pair is formed."""
    wanted = settle(wanted, "wanted")
    held = meet(postings, wanted.select("repo", "token").distinct(), ["repo", "token"]).select("repo", "path", "token", *COUNTS)
    pairs = settle(given.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in [*FACTS, "e"]]), "given")
    met = meet(pairs.select(*PAIR).join(held, ["repo", "path"]), wanted, ["task_id", "repo", "token"])
    counts = met.groupBy(*PAIR).agg(*[F.sum(c).cast("double").alias(c) for c in COUNTS])
    return judge(pairs.join(counts, PAIR, "left").fillna(0.0, COUNTS))


def best_pairs(
    postings: DataFrame, wanted: DataFrame, judge: Judge, k: int, given: DataFrame | None = None, no_score: float | None = None,
    direct_pairs: int | None = None, seed_pairs: int | None = None, block_files: int | None = None, report: dict | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(best k judged pairs per task with ``rank``, judged pairs that hold at least these and all ``given`` ones).

    ``postings`` is (repo, path, FACTS, token, COUNTS), a row per file, token and place; ``wanted`` is (task_id, repo, token). ``given`` pairs
    (PAIR, FACTS, e) take part with or without shared tokens; other pairs have ``no_score`` for ``e``. ``report`` receives the numbers
    of rows formed.
    """
    direct_pairs = DIRECT_PAIRS if direct_pairs is None else direct_pairs
    seed_pairs = SEED_PAIRS if seed_pairs is None else seed_pairs
    block_files = BLOCK_FILES if block_files is None else block_files
    report = {} if report is None else report
    wanted = settle(wanted, "wanted")
    vocabulary = wanted.select("repo", "token").distinct()
    held = settle(meet(postings, vocabulary, ["repo", "token"]).select("repo", "path", *FACTS, "token", *COUNTS), "postings")
    lists = settle(held.groupBy(*LIST).agg(F.count("*").alias("files")), "lists")
    priced = wanted.join(lists, ["repo", "token"])
    formed = priced.agg(F.sum("files")).first()[0] or 0
    order = [F.col("score").desc(), "path"]

    def complete(pairs: DataFrame) -> DataFrame:
        """Counted pairs and the given ones, one row a pair, judged."""
        none = F.lit(None).cast("double")
        rows = pairs.select(*PAIR, *FACTS, *COUNTS, none.alias("e"))
        if given is not None:
            rows = rows.unionByName(given.select(*PAIR, *FACTS, *[F.lit(0.0).alias(c) for c in COUNTS], "e"))
            rows = rows.groupBy(*PAIR).agg(*[F.max(c).alias(c) for c in [*FACTS, *COUNTS, "e"]])
        return judge(rows.withColumn("e", F.coalesce("e", F.lit(no_score).cast("double"))))

    if formed <= direct_pairs:
        report["pairs"] = formed
        pairs = complete(all_pairs(held, wanted))
        return top_k(pairs.where("ok"), ["task_id"], order, k), pairs

    # Shelves are told apart by the text of their facts; blocks follow the order of repo, shelf and path.
    shelf = F.to_json(F.struct(*FACTS))
    vectors = settle(_by_file(held).withColumn("shelf", shelf), "sets")     # a range is dealt by a sample, which reads it twice
    place = F.monotonically_increasing_id()
    vectors = settle(vectors.repartitionByRange("repo", "shelf", "path").sortWithinPartitions("repo", "shelf", "path").withColumn(
        "block", F.concat_ws(":", F.shiftright(place, 33), F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / block_files).cast("long"))), "vectors")
    words = settle(wanted.groupBy("task_id").agg(F.collect_list("token").alias("tokens")), "words")

    def counted(rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(words), "task_id") if fits(wanted, MAX_BROADCAST_TERMS) else rows.join(words, "task_id")
        return _summed(joined, [*PAIR, *FACTS])

    upto = F.sum("files").over(W.partitionBy("task_id").orderBy("files", "token", *COUNTS).rowsBetween(W.unboundedPreceding, 0))
    priced = settle(priced.withColumn("seed", upto <= seed_pairs), "priced")
    seeds = meet(held, priced.where("seed").select("task_id", *LIST), LIST).select(*PAIR)
    if given is not None:
        seeds = seeds.unionByName(given.select(*PAIR))
    pairs = settle(complete(counted(seeds.distinct().join(vectors, ["repo", "path"]))), "pairs")
    top = settle(top_k(pairs.where("ok"), ["task_id"], order, k), "top")
    report["seeds"] = pairs.count()

    def open_to(bounds: DataFrame, best: DataFrame) -> DataFrame:
        """Rows (task_id, score, first, …) that may hold a better file than the task's k-th."""
        last = best.where(F.col("rank") == k).select("task_id", F.col("score").alias("_low"), F.col("path").alias("_at"))
        beats = F.col("_low").isNull() | (F.col("score") > F.col("_low")) | ((F.col("score") == F.col("_low")) & (F.col("first") < F.col("_at")))
        return bounds.join(last, "task_id", "left").where(beats).drop("_low", "_at")

    def bounded(rows: DataFrame, by: list[str]) -> DataFrame:
        """The most that a file with all these lists scores. A negative tie-break weight would fall with the counts, so 0 bounds it."""
        sums = rows.groupBy("task_id", "repo", "shelf", *by).agg(
            *[F.max(c).alias(c) for c in FACTS], *[F.sum(c).cast("double").alias(c) for c in COUNTS], F.min("first").alias("first"))
        sums = sums.withColumns({"tiebreak": F.greatest("tiebreak", F.lit(0.0)), "e": F.lit(no_score).cast("double")})
        return judge(sums).where("ok").select("task_id", "repo", "shelf", *by, "first", "score")

    rest = priced.where("not seed").select("task_id", *LIST)
    shelves = held.withColumn("shelf", shelf).groupBy("shelf", *LIST).agg(*[F.max(c).alias(c) for c in FACTS], F.min("path").alias("first"))
    left = open_to(bounded(rest.join(shelves, LIST), []), top).select("task_id", "shelf")
    in_blocks = vectors.select("repo", "shelf", "block", "path", *FACTS, F.inline("sets")).withColumn("token", F.explode("tokens")).groupBy("repo", "shelf", "block", "token", *COUNTS).agg(
        *[F.max(c).alias(c) for c in FACTS], F.min("path").alias("first"))
    left = settle(bounded(rest.join(left, "task_id").join(in_blocks, [*LIST, "shelf"]), ["block"]), "blocks")
    report["blocks"] = left.count()
    width, found = 4, [pairs]
    while True:
        left = settle(open_to(left, top), "blocks")
        if left.isEmpty():
            break
        chosen = settle(top_k(left, ["task_id"], [F.col("score").desc(), "first"], width, "_nth").select("task_id", "block"), "chosen")
        fresh = counted(chosen.join(vectors, "block")).where("n_name + n_path + n_content > 0")
        fresh = fresh.join(pairs.select(*PAIR), PAIR, "left_anti").withColumn("e", F.lit(no_score).cast("double"))
        fresh = settle(judge(fresh), "pairs")
        found.append(fresh)
        top = settle(top_k(top.drop("rank").unionByName(fresh.where("ok").select(*top.drop("rank").columns)), ["task_id"], order, k), "top")
        left = left.join(chosen, ["task_id", "block"], "left_anti")
        width *= 4
    report["opened"] = sum(f.count() for f in found[1:])
    return top, union_all([f.select(*pairs.columns) for f in found])
