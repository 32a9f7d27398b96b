"""Substring joins on the rarest part of each word."""

import random

import pytest

from trailhead.operators import contains

TEXT = "repo string, id int, text string"
WORD = "repo string, word string"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contains_join_equals_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(contains, "MAX_BROADCAST_NEEDLES", limit)
    _equals_all_pairs(spark)


@pytest.mark.parametrize("tried", [0, 5, 10_000])
def test_few_runs_are_looked_for_and_many_are_cut_out_alike(spark, monkeypatch, tried):
    monkeypatch.setattr(contains, "MAX_TRIED_GRAMS", tried)
    _equals_all_pairs(spark)


def _equals_all_pairs(spark):
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    texts = [(rng.choice("xy"), i, draw(rng.randint(0, 14))) for i in range(150)] + [("x", 900, None)]
    words = [(rng.choice("xyz"), draw(rng.randint(0, 6))) for _ in range(60)] + [("x", ""), ("x", None), (None, "a"), ("x", "a"), ("x", "a")]
    got = contains.contains_join(spark.createDataFrame(texts, TEXT), spark.createDataFrame(words, WORD), ["repo"], "text", "word", ["id"])
    want = {(r, i, t, w) for r, i, t in texts for s, w in words if r == s and t is not None and w is not None and w in t}
    rows = [tuple(r) for r in got.select("repo", "id", "text", "word").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_few_pairs_are_compared_where_words_begin_alike(spark):
    """Every word begins with `pre` and every text holds `pre`: by first characters all of 300 × 2,000 pairs would be compared."""
    rng = random.Random(9)
    words = sorted({"pre" + "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)})
    texts = [("r", i, f"prefix of {rng.choice(words)} and more") for i in range(2000)]
    frames = spark.createDataFrame(texts, TEXT), spark.createDataFrame([("r", w) for w in words], WORD)
    pairs = contains.candidates(*frames, ["repo"], "text", "word", ["id"]).count()
    matches = contains.contains_join(*frames, ["repo"], "text", "word", ["id"]).count()
    assert matches >= 2000 and pairs < 8 * matches and pairs < 0.05 * len(words) * len(texts), (pairs, matches)


def test_empty_sides(spark):
    texts, words = spark.createDataFrame([("r", 1, "abc")], TEXT), spark.createDataFrame([("r", "b")], WORD)
    join = lambda t, w: contains.contains_join(t, w, ["repo"], "text", "word", ["id"]).count()
    assert (join(texts, words), join(texts.limit(0), words), join(texts, words.limit(0))) == (1, 0, 0)
