"""Line dedup by a deletion-neighbourhood join: of lines within one edited word of each other, the earliest stays.

Edits are insertions, deletions and substitutions of one word. Two lines are that close exactly when leaving out word i of both
gives the same words (substitution), or leaving out a word of one gives the other (insertion, deletion). So every line emits all
its one-word deletions as hashed keys (with their place, for substitutions) and itself, equal keys meet in a join, and the
word-level edit distance is verified on the words. A key's rows are never paired with each other: all that matters is whether
an earlier line is close, so each key is reduced to its earliest line, map side first.

A line with a partner shares its first or its last half with it, counted by the shorter of the two, and of eight parts all but one.
Lines without another line that does so can have no partner and emit no variants. Both tests are exact and leave few lines.

Lines are taken in order of (document id, null last; hash of the text; place in the text). A line goes if an equal or close line
comes earlier, whether or not that one stays. Of lines with under ``min_words`` words only equal ones go, as an edit there can't be
told from chance, and only with ``short``; otherwise they stay. Lines without a word are no copies of each other and stay.

Only DataFrame functions are used. Defined cases: a null text stays null, an empty one empty. Rows with the same id and the same
text are one document: all of them keep or lose the same lines. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import maybe_in, packed

PARTS = 8
BLANK = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANK), "")


def _hash(*columns: Column) -> Column:
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(97), *columns).alias("b"))


def _without_part(words: Column, parts: int) -> Column:
    """Keys of the line without one of ``parts`` equal parts, for partners of equal length or one word shorter, and (read there) longer.

    One edit lies in one part, so close lines agree in a key: what comes before the part is counted from the start, what comes
    behind it from the end.
    """
    n = F.size(words)

    def keys(m: Column) -> list[Column]:
        cut = [F.floor(m * p / parts).cast("int") for p in range(parts + 1)]
        return [F.xxhash64(F.lit(p), m, F.slice(words, F.lit(1), cut[p]), F.slice(words, n - (m - cut[p + 1]) + 1, m - cut[p + 1]))
                for p in range(parts)]

    return F.array(*keys(n), *keys(n - 1))


def _partnered(keyed: DataFrame) -> DataFrame:
    """(a, part): 64-bit names of the lines of ``keyed(a, part, key)`` that share a key with another line, and the key's number."""
    shared = settle(keyed.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select("key"), "shared")
    likely = maybe_in(keyed, F.col("key"), shared, F.col("key")).where("maybe").select("a", "part", "key")
    return likely.join(shared, "key", "left_semi").select("a", "part").distinct()


def _prefix(a: Column, b: Column) -> Column:
    """Number of words that both begin with."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.least(F.size(a), F.size(b))).otherwise(at - 1)


def within_one(a: Column, b: Column) -> Column:
    """Whether the word-level edit distance is at most one."""
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (_prefix(a, b) + _prefix(F.reverse(a), F.reverse(b)) >= longer - 1)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc, sig, no, words) of the lines with at least ``least`` words; ``doc`` and ``sig`` name the document."""
    split = docs.select("doc", "sig", F.posexplode(F.split("value", "\n")).alias("no", "line"))
    return split.select("doc", "sig", "no", _words(F.col("line")).alias("words")).where(F.size("words") >= least)


def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("last"), "doc", "sig", "no")


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, short: bool = False) -> DataFrame:
    """(doc, sig, removed): the numbers (from 0, ascending) of the lines that go, for documents that lose any.

    ``doc`` is the id and ``sig`` the 64-bit hash of the text.
    """
    named = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("sig"), F.col(text).alias("value")).where("value is not null")
    rows = _lines(named, 1 if short else min_words)
    halves = F.when(F.size("words") >= min_words, _without_part(F.col("words"), 2))      # null: only equal lines count
    found = settle(rows.select("doc", "sig", "no", _hash(F.col("words")).alias("line"), halves.alias("halves")), "lines")
    firsts = settle(found.groupBy("line").agg(F.min(_place()).alias("place")), "firsts")

    # First places of lines that share a half with another line.
    likely = _partnered(found.select("line.a", F.posexplode("halves").alias("part", "key"))).select("a").distinct()
    wanted = firsts.join(likely, firsts["line.a"] == likely["a"], "left_semi").groupBy("place.doc", "place.sig").agg(F.collect_set("place.no").alias("nos"))
    at = settle(wanted.select(F.col("doc").alias("d"), F.col("sig").alias("s"), "nos"), "wanted")      # nos: a document's own lines
    # Their words, from the documents that hold them.
    holders = maybe_in(named, F.col("sig"), at, F.col("s")).where("maybe").drop("maybe")
    holders = holders.join(at, holders["doc"].eqNullSafe(at["d"]) & (holders["sig"] == at["s"]))
    lines = holders.select("doc", "sig", F.explode("nos").alias("no"), F.split("value", "\n").alias("all")).select(
        "doc", "sig", "no", _words(F.element_at("all", F.col("no") + 1)).alias("words"))
    held = settle(lines.select(_hash(F.col("words")).alias("line"), _place().alias("place"), "words").dropDuplicates(["line"]), "likely")
    # Of these, lines that agree with another in all but an eighth.
    close = _partnered(held.select("line.a", F.posexplode(_without_part(F.col("words"), PARTS)).alias("part", "key")))
    close = close.groupBy("a").agg(F.collect_set("part").alias("parts"))       # at most 2 * PARTS
    held = settle(held.join(close, held["line.a"] == close["a"]).drop("a"), "close")

    # The deletion neighbourhood: (length, place of the deletion or 0, hash), and which side of a match the row is.
    n = F.size("words")
    without = F.concat(F.slice("words", F.lit(1), F.col("i") - 1), F.slice("words", F.col("i") + 1, n))
    # Only words of the parts that the line may differ in; behind the last part's words there may be one more where it is longer.
    in_part = held.select("line", "place", n.alias("n"), "words", F.explode("parts").alias("part")).withColumn("longer", F.col("part") >= PARTS)
    p, m = F.col("part") % PARTS, F.col("n") - F.col("longer").cast("int")
    low, high = F.floor(m * p / PARTS).cast("int") + 1, F.floor(m * (p + 1) / PARTS).cast("int") + F.col("longer").cast("int")
    places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    cut = in_part.select("line", "place", "n", "words", "longer", F.explode(places).alias("i")).select(
        "line", "place", "n", "i", "longer", _hash(without).alias("h"))
    whole = held.select("line", "place", n.alias("m"), F.lit(0).alias("i"), F.col("line").alias("h"), F.lit("whole").alias("side"))
    changed = cut.select("line", "place", F.when(F.col("longer"), F.col("n") - 1).otherwise(F.col("n")).alias("m"),
                         F.when(F.col("longer"), 0).otherwise(F.col("i")).alias("i"), "h", F.when(F.col("longer"), "longer").otherwise("changed").alias("side"))
    variants = changed.unionByName(whole)
    variants = settle(variants, "variants")
    keys = ["m", "i", "h"]
    me = F.struct("place", "line")
    earliest = (variants.groupBy(*keys).agg(
        F.min(F.when(F.col("side") != "whole", me)).alias("cut"), F.min(F.when(F.col("side") == "whole", me)).alias("whole"),
        F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select(*keys, "cut", "whole"))
    met = variants.join(earliest, keys).select(
        "line", "place", F.when(F.col("side") == "longer", F.col("whole")).otherwise(F.col("cut")).alias("other"))
    pairs = met.where("other.place < place").select("line", F.col("other.line").alias("earlier")).distinct()
    words = held.select("line", "words")
    checked = (pairs.join(words, "line").join(words.select(F.col("line").alias("earlier"), F.col("words").alias("theirs")), "earlier")
               .where(within_one(F.col("words"), F.col("theirs"))))
    close = checked.select("line").distinct().withColumn("close", F.lit(True))

    judged = firsts.join(close, "line", "left")
    gone = (found.select("doc", "sig", "no", "line").join(judged, "line")
            .where(F.col("close").isNotNull() | (_place() != F.col("place"))))
    return gone.groupBy("doc", "sig").agg(F.sort_array(F.collect_set("no")).alias("removed"))    # bounded by a document's lines


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 5, short: bool = False) -> DataFrame:
    """Every row as struct ``row`` with ``n_lines``, ``removed`` (line numbers) and ``kept``, its text without them."""
    gone = removed_lines(docs, doc_id, text, min_words, short).select(F.col("doc").alias("d"), F.col("sig").alias("s"), "removed")
    rows = packed(docs, doc=F.col(doc_id), sig=F.xxhash64(text), value=F.col(text))
    gone = settle(gone, "gone")
    told = maybe_in(rows, F.col("sig"), gone, F.col("s"))
    hit = told.where("maybe").join(gone, F.col("doc").eqNullSafe(gone["d"]) & (F.col("sig") == gone["s"]), "left").drop("maybe", "d", "s")
    joined = hit.unionByName(told.where("not maybe").drop("maybe").withColumn("removed", F.lit(None).cast("array<int>")))
    lines = F.split("value", "\n")
    # The stretches between removed lines, so that the work is in proportion to the text.
    edges = F.concat(F.array(F.lit(-1)), F.col("removed"), F.array(F.size("all")))
    stretch = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda j: F.slice(
        F.col("all"), F.element_at("edges", j) + 2, F.element_at("edges", j + 1) - F.element_at("edges", j) - 1))
    kept = F.when(F.col("removed").isNull(), F.col("value")).otherwise(F.array_join(F.flatten(stretch), "\n"))
    return (joined.withColumn("all", lines).withColumn("edges", edges)
            .select("row", F.when(F.col("value").isNull(), 0).otherwise(F.size("all")).alias("n_lines"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), kept.alias("kept")))
