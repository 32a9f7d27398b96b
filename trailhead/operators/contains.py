"""Which texts hold which words as a substring, joined on each word's rarest part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .skew import fits, salted_join, top_k

MAX_BROADCAST_NEEDLES = 100_000     # (needle, part) rows sent to the texts; about 10 MB
GRAM = 3
MAX_TRIED_GRAMS = 256               # distinct runs up to which each text is searched for them; it is cut into all its runs beyond


def _parts(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _met(texts: DataFrame, wanted: DataFrame, on: list[str], how: str, spread_by: list[str]) -> DataFrame:
    if fits(wanted, MAX_BROADCAST_NEEDLES):
        return texts.join(F.broadcast(wanted), on, how)
    return salted_join(texts, wanted, on, spread_by, how)


def candidates(texts: DataFrame, needles: DataFrame, by: list[str], text: str, needle: str, spread_by: list[str]) -> DataFrame:
    """Pairs that :func:`contains_join` compares.

    A needle is looked up by that run of three of its characters (all of it, if shorter) that the fewest texts of its key hold, as counted
    first. A needle with a run that no text holds drops out there, so the pairs compared stay near the matches even where most needles begin alike.
    ``spread_by`` are columns of ``texts`` that tell rows of a hot key apart.
    """
    needles = settle(needles.select(*by, needle).dropna().distinct(), "needles")
    size = F.least(F.length(needle), F.lit(GRAM))
    whole = F.when(F.length(needle) >= GRAM, _parts(F.col(needle), GRAM)).otherwise(F.array(F.col(needle)))
    asked = settle(needles.select(*by, needle, size.alias("_size"), F.explode(whole).alias("_gram")), "grams")
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())        # 0 to 3
    if not sizes:
        return texts.join(needles, by).limit(0)
    texts = texts.where(F.col(text).isNotNull())

    def spread(grams: DataFrame) -> DataFrame:
        """A row per text and run of it; of few ``grams`` only those are looked for."""
        tried = [r[0] for r in grams.select("_gram").distinct().limit(MAX_TRIED_GRAMS + 1).collect()]
        if 0 < len(tried) <= MAX_TRIED_GRAMS:
            parts = F.filter(F.array(*map(F.lit, sorted(tried))), lambda g: F.contains(F.col(text), g))
        else:
            parts = F.concat(*[_parts(F.col(text), n) if n else F.array(F.lit("")) for n in sizes])
        return texts.withColumn("_gram", F.explode(parts))

    on = [*by, "_gram"]
    held = _met(spread(asked).select(*on, *[c for c in spread_by if c not in on]), asked.select(*on).distinct(), on, "left_semi", spread_by)
    counts = settle(held.groupBy(*on).agg(F.count("*").alias("_texts")), "counts")
    # A gram that no text holds counts 0 and is chosen, which drops its needle in the join.
    priced = asked.join(counts, on, "left").fillna(0, ["_texts"])
    chosen = settle(top_k(priced, [*by, needle], ["_texts", "_gram"], 1, "_n").where("_texts > 0").select(*on, needle), "chosen")
    return _met(spread(chosen), chosen, on, "inner", spread_by).drop("_gram")


def contains_join(texts: DataFrame, needles: DataFrame, by: list[str], text: str, needle: str, spread_by: list[str]) -> DataFrame:
    """Pairs of ``texts`` (by…, text, …) and distinct ``needles`` (by…, needle) where the text holds the needle; upper and lower case differ.

    The empty needle is in every text.
    """
    return candidates(texts, needles, by, text, needle, spread_by).where(F.contains(text, needle))
