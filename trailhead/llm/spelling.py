"""Spelling variants: words one edit apart, grouped under their most frequent form, by a bit-sliced position index.

The index of a group of words is one bitset over the group for every (position, letter) that occurs: bit j is set where word j has that
letter at that position. A word is compared with all words of the group at once, by walking over its letters with three bitsets: words that
agree so far without an error, words with one letter replaced, and words that hold one letter more, whose letters are read one position
further on. Each step is a few word-parallel ANDs and ORs, and what is left at the end is the set of words one edit away.

Two words one edit apart agree on the first half of their letters or on the remaining ones (counted from the end), for the edit
lies in one of the two. So groups are dealt by the shorter length and the hash of either half: a group holds words of two neighbouring lengths that
share a half, the walk covers the other half only, and suffix groups are walked on reversed words. Pairs that share both are
counted among the prefixes. Large groups are cut into pieces of bounded letters, and every pair of pieces is one task group; a task
holds two pieces. Words found are never written as pairs: a task gives back for each word how many near words it met and the best of them.

Words are counted in the JVM, combined before the shuffle. Forms are followed to their roots by doubling steps; as a form is ten times as
frequent as its word, there are few.

Defined cases: a null or empty text has no words. A null id counts as an id that alters no word. Rows that repeat an id count again.
An empty table gives no rows. Words of any length take part whole. Ties of frequency go to the smallest word in code-point order.
Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle

#: Letters of a run (fixed value).
LETTERS = r"A-Za-zÀ-ÿ"
PREFIX, SUFFIX = 0, 1
NEAR = "word string, n_near long, form_n long, form string"


def typos(run: Column, doc_id: Column, every: int) -> Column:
    """The run, or the run without one letter where ``every`` divides the checksum of id and run: a fixed, repeatable set of slips."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_letters: int = 7, least_count: int = 2, slip_every: int | None = None,
) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``least_letters`` letters and ``least_count`` occurrences.

    ``slip_every`` alters a fixed share of runs per document by one letter (see :func:`typos`) before they are counted.
    """
    # Runs only get shorter, so those too short to begin with are not even extracted.
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    found = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(runs).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = typos(lower, F.col("id"), slip_every) if slip_every else lower
    counted = found.select(word.alias("word")).where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


class Index:
    """Bitsets by (position, letter) over a list of words, each of length ``m`` or ``m`` + 1, whose first ``skip`` letters count as equal."""

    def __init__(self, words: list[str], m: int, skip: int):
        self.m, self.skip = m, skip
        places: dict[tuple[int, str], list[int]] = {}
        for j, w in enumerate(words):
            for i in range(skip, len(w)):
                places.setdefault((i, w[i]), []).append(j)
        self.bits = {key: self._set(js) for key, js in places.items()}
        self.all = (1 << len(words)) - 1
        self.long = self._set([j for j, w in enumerate(words) if len(w) == m + 1])

    @staticmethod
    def _set(js: list[int]) -> int:
        if not js:
            return 0
        out = bytearray(js[-1] // 8 + 1)
        for j in js:
            out[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(out, "little")

    def near(self, word: str) -> tuple[int, int]:
        """Words one replaced letter, and words one further letter away from a word of length ``m``."""
        bits, none = self.bits, 0
        same, replaced, longer = self.all, 0, 0
        for i in range(self.skip, self.m):
            letter = word[i]
            here = bits.get((i, letter), none)
            longer = (longer | same) & bits.get((i + 1, letter), none)
            agree = same & here
            replaced = (replaced & here) | (same ^ agree)
            same = agree
            if not (same or replaced or longer):
                return 0, 0
        return replaced & ~self.long, (longer | same) & self.long


def members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def _meet(index: list[tuple[str, int]], askers: list[tuple[str, int]], m: int, family: int, best: dict[str, list]) -> None:
    """Compare ``askers`` of length ``m`` with the words of ``index``; ``best`` gets [near words, largest n, its word] by word."""
    half = m // 2
    skip = half if family == PREFIX else m - half
    turned = [w if family == PREFIX else w[::-1] for w, _ in index]
    slices = Index(turned, m, skip)
    for word, n in askers:
        asked = word if family == PREFIX else word[::-1]
        replaced, longer = slices.near(asked)
        for j in members(replaced | longer):
            other, other_n = index[j]
            # Groups are dealt by a hash of the shared half; words of another half are no pair of this group.
            if other == word or turned[j][:skip] != asked[:skip]:
                continue
            if family == SUFFIX and len(other) > m and other[:half] == word[:half]:
                continue        # met among the prefixes too
            pairs = ((word, other, other_n), (other, word, n)) if len(other) > m else ((word, other, other_n),)
            for a, b, b_n in pairs:
                held = best.get(a)
                if held is None:
                    best[a] = [1, b_n, b]
                else:
                    held[0] += 1
                    if (-b_n, b) < (-held[1], held[2]):
                        held[1:] = b_n, b


def near_words(words: DataFrame, piece_letters: int = 200_000) -> DataFrame:
    """(word, n_near, form_n, form) for each word of ``words(word, n)`` that has a word one edit away: how many, and the most frequent."""
    size = F.length("word")

    def keyed(m: Column, role: str) -> Column:
        half = F.floor(m / 2).cast("int")
        return F.array(*[
            F.struct(m.cast("int").alias("m"), F.lit(f).alias("family"), F.xxhash64(part).alias("half"), F.lit(role).alias("role"))
            for f, part in ((PREFIX, F.left("word", half)), (SUFFIX, F.right("word", m - half)))])

    # Words of length m ask in groups of their own length and are found in these and in those of one letter less.
    dealt = words.select("word", "n", F.inline(F.concat(keyed(size, "short"), keyed(size - 1, "long"))))
    group = ["m", "family", "half"]
    sums = dealt.groupBy(*group).agg(
        F.sum(F.length("word")).alias("letters"), F.count("*").alias("words"), F.count_if(F.col("role") == "short").alias("asking"))
    # Groups of one word, or without one that asks, have no pairs; most end here.
    useful = sums.where("asking > 0 and words > 1").select(*group, F.ceil(F.col("letters") / piece_letters).cast("int").alias("pieces"))
    placed = dealt.join(useful, group).withColumn("piece", F.pmod(F.xxhash64(F.lit(3), "word"), F.col("pieces")).cast("int"))
    others = F.sequence(F.lit(0), F.col("pieces") - 1)

    def tile(i: Column, asks: bool) -> Column:
        pair = (i, F.col("piece")) if asks else (F.col("piece"), i)
        return F.struct(pair[0].alias("a"), pair[1].alias("b"), F.lit(asks).alias("asks"))

    # Tile (a, b): the words of piece b ask the index of piece a.
    tiles = F.concat(F.transform(others, lambda i: tile(i, False)), F.when(F.col("role") == "short", F.transform(others, lambda i: tile(i, True))).otherwise(
        F.array().cast("array<struct<a:int,b:int,asks:boolean>>")))
    spread = placed.select(*group, F.inline(tiles), "word", "n")
    key = [*group, "a", "b"]
    ordered = spread.repartition(*key).sortWithinPartitions(*key)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}
        current, index, askers = None, [], []

        def flush() -> pa.RecordBatch:
            rows = [(w, c, n, f) for w, (c, n, f) in best.items()]
            best.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(col, kind) for col, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "form_n", "form"])

        for batch in batches:
            for m, family, half, a, b, asks, word, n in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if (at := (m, family, half, a, b)) != current:
                    if index and askers:
                        _meet(index, askers, current[0], current[1], best)
                    current, index, askers = at, [], []
                (askers if asks else index).append((word, n))
            if len(best) > 50_000:
                yield flush()
        if index and askers:
            _meet(index, askers, current[0], current[1], best)
        if best:
            yield flush()

    met = ordered.select(*key, "asks", "word", "n").mapInArrow(task, NEAR)
    first = F.min(F.struct((-F.col("form_n")).alias("rank"), F.col("form").alias("form"))).alias("first")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.rank")).alias("form_n"), "first.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of ``forms(word, form)`` that starts at a word ends. Chains may not run in circles."""
    reached = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # Every step doubles the part of the chain that is behind a word.
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = settle(reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return reached


def group(words: DataFrame, ratio: int = 10, piece_letters: int = 200_000) -> DataFrame:
    """``words(word, n)`` with form, root, n_near and form_n: the form is the most frequent near word if that is ``ratio`` times as frequent."""
    words = settle(words.select("word", "n"), "words")
    near = settle(near_words(words, piece_letters), "near")
    known = words.join(near, "word", "left").withColumns({
        "form": F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form")), "form_n": F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n"))})
    known = settle(known, "forms")
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
