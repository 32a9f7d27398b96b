"""Personal data by rules and by bootstrapped contextual extraction.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers: the leftmost matches of each kind that do not overlap;
a match that fails its kind's condition is dropped. These are the seeds.

Contexts do the rest. A mention is a seed, or an identifier-like word (a digit or ``@`` in it, and four or more
characters) that no seed touches. Its patterns are the word before it and the word behind it, each with the mention's
shape (runs of digits, letters and signs), both whole, however long, and also where they are mentions themselves; and, whatever the shape, the words on both sides and the two words before it. Patterns and instances (the mentions' texts) form a graph. Starting from seeds with confidence
1, rounds of two aggregations spread it: a pattern's confidence for a kind is the mean confidence of its distinct instances,
shrunk by ``prior`` doubtful ones; an instance that isn't a seed is as sure as its best pattern. Patterns at or above ``threshold`` with at least ``support``
distinct instances then mark the mentions that they meet as spans of their kind. Seeds stay whatever the graph says.

Only DataFrame functions are used. Offsets are code points; ends are exclusive. Defined cases: a null or empty text has no spans, an empty table no rows.
Rows are judged one by one and repeats count once as an instance. A mention that several kinds claim takes the surest, then the
first in the order email, ip, card, phone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .common import packed

# The kinds in order and their expressions. Possessive quantifiers match the same texts without deep recursion; a run is
# entered at its beginning only (or where the last match ended), which also finds the same and keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
REGEX = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's expression to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
MENTION = r"(?:(?<![^\x20\x09-\x0D])|\G)(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]++"
SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
NEAR = 64           # code points on either side that nearly always hold the context words; where they don't, all between two matches is kept
BLOCK = 256


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks: a fold copies its array at each step, so it is kept short."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def fold(values: Column, start: Column) -> Column:
        sums = F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(sums, F.lit(2), F.size(sums) - 1)

    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
    bases = F.concat(F.array(F.lit(0)), fold(totals, F.lit(0)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(
        F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), bases.alias("base")), lambda z: F.when(
            z["block"].isNull(), F.array().cast("array<int>")).otherwise(fold(z["block"], z["base"])))))


def _tail(piece: Column) -> Column:
    """An end of ``piece`` that holds its last two words whole."""
    end = F.substring(piece, -NEAR, NEAR)
    return F.when(end.rlike(r"[\x20\x09-\x0D][^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$"), end).otherwise(piece)


def _head(piece: Column) -> Column:
    """A beginning of ``piece`` that holds its first word whole."""
    start = F.substring(piece, 1, NEAR)
    return F.when(start.rlike(r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]"), start).otherwise(piece)


def _joined(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _find(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df(…, value)`` with, for each name, the spans of its expression's matches in column ``s_<name>``; ``value`` goes.

    What lies between matches gives their offsets. A span's ``before`` and ``after`` are text around it that holds two words before and one
    behind it whole, be they long or matches themselves. Each step is a projection of its own, so that nothing is worked out twice.
    """
    rest = [c for c in df.columns if c != "value"]

    def worth(name: str) -> Column:
        need = NEEDS.get(name, "")
        digit = F.col("value").rlike("[0-9]") if name not in ("email", "mention") else F.lit(True)
        return digit & F.contains("value", F.lit(need)) if need else digit

    cut = df.select(*rest, *[F.when(worth(k), F.split("value", r, -1)).alias(f"g_{k}") for k, r in names.items()],
                    *[F.when(worth(k), F.regexp_extract_all("value", F.lit(r), F.lit(0))).alias(f"h_{k}") for k, r in names.items()])
    empty = F.array().cast(SPAN)
    out = cut.select(*rest, *[f"h_{k}" for k in names], *[c for k in names for c in (
        F.transform(f"g_{k}", lambda g: F.length(g)).alias(f"l_{k}"),
        F.transform(f"g_{k}", lambda g: F.struct(_tail(g).alias("before"), _head(g).alias("after"))).alias(f"c_{k}"))])
    n = {k: F.size(f"h_{k}") for k in names}
    out = out.select(*rest, *[c for k in names for c in (f"h_{k}", f"c_{k}", F.zip_with(
        F.slice(f"l_{k}", F.lit(1), n[k]), f"h_{k}", lambda g, h: g + F.length(h)).alias(f"l_{k}"))])
    out = out.select(*rest, *[c for k in names for c in (f"h_{k}", f"c_{k}", F.when(n[k] > 0, _running(F.col(f"l_{k}"))).alias(f"e_{k}"))])
    return out.select(*rest, *[F.when(n[k] > 0, F.transform(
        F.arrays_zip(F.col(f"h_{k}").alias("h"), F.col(f"e_{k}").alias("e")), _placed(k))).otherwise(empty).alias(f"s_{k}") for k in names])


def _placed(name: str) -> Callable[[Column, Column], Column]:
    """A match with its offsets and the text around it: the pieces next to it and, as these may hold too few words, the matches beyond them."""

    def piece(i: Column, side: str) -> Column:
        return F.get(F.col(f"c_{name}"), i)[side]

    def match(i: Column) -> Column:
        return F.get(F.col(f"h_{name}"), i)

    return lambda z, i: F.struct(
        (z["e"] - F.length(z["h"])).alias("start"), z["e"].alias("end"), z["h"].alias("text"),
        _joined(match(i - 2), piece(i - 1, "before"), match(i - 1), piece(i, "before")).alias("before"),
        _joined(piece(i + 1, "after"), match(i + 1), piece(i + 2, "after")).alias("after"))


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.try_to_number(c, F.lit("9")).cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    """The condition on a kind's matches."""

    def holds(span: Column) -> Column:
        text = span["text"]
        if kind == "ip":
            return text.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
        if kind == "card":
            digits = F.regexp_replace(text, "[ -]", "")
            return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
        if kind == "phone":
            return F.length(F.regexp_replace(text, "[^0-9]", "")).between(8, 15)
        return F.lit(True)

    return holds


def _tag(span: Column, **first: Column) -> Column:
    """A span's offsets behind another field."""
    return F.struct(*[v.alias(k) for k, v in first.items()], span["start"].alias("start"), span["end"].alias("end"))


def _of_kind(kind: Column) -> Callable[[Column], Column]:
    return lambda span: F.struct(kind.alias("kind"), span.alias("span"))


def _ranked(rank: int) -> Callable[[Column], Column]:
    return lambda span: _tag(span, o=F.lit(rank))


def base_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row as ``row`` with ``uid``, the kinds' valid spans ``s_<kind>`` and ``mentions``, identifier-like words.

    A stored table: uids are fixed.
    """
    given = packed(docs, keep, value=F.coalesce(F.col(text), F.lit("")))
    found = _find(given, {**REGEX, "mention": MENTION})
    found = found.select("row", "s_mention", *[F.filter(f"s_{k}", _valid(k)).alias(f"s_{k}") for k in KINDS])
    trimmed = F.transform("s_mention", lambda m: F.struct(
        (m["start"] + F.length(F.regexp_extract(m["text"], r"^[(\[\"']*", 0))).alias("start"),
        (m["end"] - F.length(F.regexp_extract(m["text"], r"[.,;:!?)\]\"']*$", 0))).alias("end"),
        F.regexp_extract(m["text"], r"^[(\[\"']*(.*?)[.,;:!?)\]\"']*$", 1).alias("text"), m["before"].alias("before"), m["after"].alias("after")))
    words = F.filter(trimmed, lambda m: F.length(m["text"]) >= 4)
    return settle(found.select("row", F.monotonically_increasing_id().alias("uid"), *[f"s_{k}" for k in KINDS], words.alias("mentions")), "spans")


def _apart(rows: DataFrame) -> DataFrame:
    """``rows(uid, kind, span)`` without mentions (kind null) that a seed overlaps."""
    start, seed = F.col("span.start"), F.col("kind").isNotNull()
    up = W.partitionBy("uid").orderBy(start).rangeBetween(W.unboundedPreceding, 0)         # a document's own spans
    down = W.partitionBy("uid").orderBy(start.desc()).rangeBetween(W.unboundedPreceding, 0)
    seen = rows.withColumns({"reach": F.max(F.when(seed, F.col("span.end"))).over(up), "next": F.min(F.when(seed, start)).over(down)})
    free = (F.coalesce("reach", start) <= start) & (F.coalesce("next", F.col("span.end")) >= F.col("span.end"))
    return seen.where(seed | free).drop("reach", "next")


def _patterned(mentions: DataFrame) -> DataFrame:
    """``mentions(…, span)`` with ``instance`` and one row for each of its patterns; without a context word there is none.

    One context word counts together with the mention's shape, two context words whatever the shape.
    """
    word = r"[^\x20\x09-\x0D]+"
    before, after = F.lower("span.before"), F.lower("span.after")
    sides = mentions.withColumns({
        "instance": F.col("span.text"), "shape": F.regexp_replace(F.regexp_replace("span.text", "[0-9]+", "0"), r"\p{L}+", "a"),
        "far": F.regexp_extract(before, rf"(?:^|[\x20\x09-\x0D])({word})[\x20\x09-\x0D]+{word}[\x20\x09-\x0D]*$", 1),
        "left": F.regexp_extract(before, rf"({word})[\x20\x09-\x0D]*$", 1),
        "right": F.regexp_extract(after, rf"^[\x20\x09-\x0D]*({word})", 1)})
    far, left, right = F.col("far") != "", F.col("left") != "", F.col("right") != ""

    def pattern(**parts: str | Column) -> Column:
        return F.struct(*[F.coalesce(F.col(parts[k]) if k in parts else F.lit(""), F.lit("")).alias(k) for k in ("far", "left", "right", "shape")])

    made = F.filter(F.array(
        F.when(left, pattern(left="left", shape="shape")), F.when(right, pattern(right="right", shape="shape")),
        F.when(left & right, pattern(left="left", right="right")), F.when(far, pattern(far="far", left="left"))), lambda p: p.isNotNull())
    return sides.withColumn("pattern", F.explode(made)).drop("shape", "far", "left", "right")


def discover(found: DataFrame, rounds: int = 3, threshold: float = 0.8, support: int = 5, prior: float = 1.0) -> DataFrame:
    """(uid, kind, start, end): mentions that high-confidence patterns mark; ``found`` comes from :func:`base_spans`."""
    tagged = F.flatten(F.array(*[F.transform(f"s_{k}", _of_kind(F.lit(k))) for k in KINDS],
                               F.transform("mentions", _of_kind(F.lit(None).cast("string")))))
    rows = settle(_patterned(_apart(found.select("uid", F.explode(tagged).alias("t")).select("uid", "t.*"))), "contexts")
    edges = rows.select("pattern", "instance", "kind").distinct()
    # Seeds matter to unseen mentions only through patterns that both have.
    open_ = edges.where("kind is null").select("pattern").distinct()
    edges = settle(edges.join(open_, "pattern", "left_semi"), "edges")
    degree = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    degree = settle(degree.where(F.col("n") >= support), "degrees")
    seeds = edges.where("kind is not null").select("instance", "kind").distinct().withColumn("conf", F.lit(1.0))
    unknown = edges.join(edges.where("kind is not null").select("instance").distinct(), "instance", "left_anti").select("pattern", "instance")
    sure, patterns = seeds, None
    pairs = edges.select("pattern", "instance").distinct()
    for _ in range(rounds):
        held = pairs.join(sure, "instance").groupBy("pattern", "kind").agg(F.sum("conf").alias("held"))
        patterns = settle(held.join(degree, "pattern").select("pattern", "kind", F.round(F.col("held") / (F.col("n") + prior), 9).alias("conf")), "patterns")
        spread = unknown.join(patterns, "pattern").groupBy("instance", "kind").agg(F.max("conf").alias("conf"))
        sure = settle(seeds.unionByName(spread), "instances")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    hits = rows.where("kind is null").drop("kind").join(patterns.where(F.col("conf") >= threshold), "pattern")
    best = hits.groupBy("uid", "span.start", "span.end").agg(F.min(F.struct((-F.col("conf")).alias("c"), order.alias("o"), "kind")).alias("b"))
    return best.select("uid", "b.kind", "start", "end")


def extract(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """Every row as ``row`` with ``base`` and ``spans``: arrays of (kind, start, end) in the kinds' order, then by start."""
    found = base_spans(docs, text, keep)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    added = discover(found, **how).groupBy("uid").agg(F.collect_list(F.struct(rank.alias("o"), "start", "end")).alias("added"))    # a document's own words
    base = F.flatten(F.array(*[F.transform(f"s_{k}", _ranked(i)) for i, k in enumerate(KINDS, 1)]))
    whole = found.select("uid", "row", base.alias("base")).join(added, "uid", "left").withColumn(
        "all", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<o:int,start:int,end:int>>")))))

    def named(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(
            F.element_at(F.array(*map(F.lit, KINDS)), s["o"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return whole.select("row", named("base").alias("base"), named("all").alias("spans"))
