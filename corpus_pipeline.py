"""A training-data pipeline over ``documents``: five stages, each one operator of ``trailhead.llm`` on all that its predecessor kept.

Every stage but the last returns the columns of ``documents``. A stage's result is written as Parquet and read again by the next.
Null and empty texts fail the quality rules; an empty table stays empty through all stages; repeated rows are judged alike, and
one of them is left after near-duplicate removal. Columns that ``documents`` has beyond its own pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailhead.llm import bpe, line_dedup, mixing, quality, weighted_minhash
from trailhead.llm.common import table, unpacked
from trailhead.llm.queries import byte_bpe_50k
from trailhead.session import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field and the word rules keep."""
    field = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.assess(docs, field).where("kept").select(*unpacked(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line nearly equals; those left without a word go. ``n_chars`` follows the text."""
    done = line_dedup.dedup(docs, short=True).where((F.size("removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept"), "n_chars": F.coalesce(F.length("kept").cast("long"), F.col("row")["n_chars"])}
    return done.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return weighted_minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, sources weighed 3, 1, 2 in turn and 150 % of all words in total."""
    return mixing.take(docs, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, with the check that they decode to the text."""
    keep = [c for c in docs.columns if c != "n_chars"]
    done = bpe.encode(docs, byte_bpe_50k(), keep=keep, decoded="decoded")
    return done.select("row.doc_id", "row.lang", "row.source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("row.text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicates),
    ("source mix", mix_sources),
    ("bpe", encode),
]

#: The field's fit, samples of shingles, Newton steps and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
