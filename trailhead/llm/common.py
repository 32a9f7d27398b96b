"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import BATCH_LIMITS, bound_batches  # noqa: F401

#: A word: a maximal run of characters that are not ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """The input row (or its columns ``keep``) as one struct ``row`` beside the operator's own columns: no input name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(like: DataFrame) -> list[Column]:
    """The input's columns again, out of ``row``."""
    return [F.col("row").getField(c).alias(c) for c in like.columns]


def id128(*columns: Column) -> Column:
    """128-bit key of some columns: two 64-bit hashes under different seeds."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(97), *columns).alias("b"))


BITMAP = 32_768     # bits of one of Spark's bitmaps


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, bitmaps: int = 2048) -> DataFrame:
    """``df`` with boolean ``maybe``: false only where the 64-bit ``key`` certainly isn't a ``member`` key.

    Sends one bit table of at most ``bitmaps`` times 8 KiB to the tasks, so that a join after it shuffles few rows that have no match. A
    table that fills up lets more rows through and stays right.
    """
    def bucket(h: Column) -> Column:
        return F.pmod(h, F.lit(bitmaps)).cast("int")

    def place(h: Column) -> Column:
        return F.pmod(F.shiftright(h, 24), F.lit(BITMAP)).cast("int")

    bits = members.select(bucket(member).alias("_bucket"), place(member).cast("long").alias("_bit")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_bit").alias("_bits"))
    # Read once into 32-bit words: four bytes each, the lowest bit of the first byte comes first.
    words = F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 32 - 1)), lambda i: F.conv(
        F.hex(F.substring(F.col("_bits"), i * 4 + 1, F.lit(4))), 16, 10).cast("long"))
    bits = bits.select("_bucket", words.alias("_words"))
    at = F.col("_at") % 32
    looked = df.withColumns({"_b": bucket(key), "_at": place(key)}).join(F.broadcast(bits), F.col("_b") == F.col("_bucket"), "left")
    found = F.getbit(F.get("_words", F.floor(F.col("_at") / 32).cast("int")), 24 - 8 * F.floor(at / 8).cast("int") + at % 8) == 1
    return looked.withColumn("maybe", F.coalesce(found, F.lit(False))).drop("_b", "_at", "_bucket", "_words")
