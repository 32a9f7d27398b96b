"""Mixing sources to target token weights by entropy balancing.

Each document gets a rate (copies on average). Of all rates that make every source's tokens meet its target and stay at or below
``cap``, the ones wanted are closest in relative entropy to one copy each. By convex duality they have the form
``min(cap, exp(lambda * size / mean size))`` with one multiplier a source, where the dual's gradient (tokens taken less target) is
zero. Newton steps find the multipliers: each step is one aggregation of gradient and curvature over all documents, kept inside
a bracket that halves when a step leaves it. As a rate depends on source and size only, the aggregation runs over the counts of
(source, size), which Spark makes once. Sums are whole numbers of millionths, so their order can't change a digit and reruns agree.

Rates become copies by systematic rounding: with the source's documents in order of size, copies are the steps of the rounded
running sum of rates, begun at the best of ``offsets`` starting points. Neighbours have like sizes, so errors cancel and a
source's tokens differ from the target by less than about one of its largest documents. Running sums are taken over blocks of a
bounded number of documents and then inside a block, so no task holds a source.

Defined cases: null or empty text has size 0 and, like every document of size 0, is taken as its rate of 1 says (it adds no words).
A null source is a source of its own, last. An empty table gives an empty result. Repeated rows are documents of their own; rows
equal in id, source and size are told apart at random but get the same copies in total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import settle
from .common import WORD, packed, unpacked

MILLION = 1_000_000
EXACT = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all sizes; none gets more than ``cap`` times
    its size, what is over is shared again by weight. Sources are gone through by cap / weight: the capped ones come first.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1     # one row a source
    s = sizes.withColumn("weight", F.element_at(w, (rank % len(weights) + 1).cast("int"))).withColumn(
        "most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    capped = F.col("most") <= F.col("weight") * F.col("level")
    # The level of the first source that isn't capped holds for all behind it.
    s = s.withColumn("capped", capped).withColumn("first_level", F.min(F.when(~F.col("capped"), F.struct(
        F.col("most") / F.col("weight"), "level"))).over(W.partitionBy()))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(
        F.col("weight") * F.col("first_level.level")).alias("target"))


def balance(counts: DataFrame, goals: DataFrame, cap: float, tolerance: float = 1e-6, max_steps: int = 80) -> DataFrame:
    """(source, lam): multipliers under which rates ``min(cap, exp(lam * size / mean))`` take each source's target.

    ``counts(source, size, n)`` are the documents; ``goals(source, mean, target, source_size)``. ``lam`` is null where the target is the whole cap.
    """
    state = goals.withColumns({
        "lam": F.when(F.col("target") < cap * F.col("source_size") * (1 - 1e-9), F.lit(0.0)),
        "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "done": F.lit(False)})
    state = settle(state, "balance")
    for _ in range(max_steps):
        if state.where("lam is not null and not done").isEmpty():
            break
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
        part = F.round(F.col("n") * F.col("size") * rate * MILLION).cast(EXACT)
        bent = F.round(F.when(rate < cap, F.col("n") * F.col("size") * z * rate * MILLION).otherwise(F.lit(0.0))).cast(EXACT)
        open_ = state.where("lam is not null and not done").select(F.col("source").alias("s"), "lam", "mean")
        sums = (counts.where("size > 0").join(open_, counts["source"].eqNullSafe(F.col("s")))
                .groupBy("s").agg((F.sum(part).cast("double") / MILLION).alias("taken"), (F.sum(bent).cast("double") / MILLION).alias("bend")))
        st = state.join(sums, state["source"].eqNullSafe(sums["s"]), "left")
        over = F.col("taken") > F.col("target")
        low = F.when(over | F.col("taken").isNull(), F.col("low")).otherwise(F.col("lam"))
        high = F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("taken") - F.col("target")) / F.col("bend")
        # Outside the bracket, or without curvature: its middle, or twice as far where it is open.
        wide = F.coalesce((F.col("low") + F.col("high")) / 2, F.when(over, F.least(F.col("lam") * 2, F.col("lam") - 1)).otherwise(
            F.greatest(F.col("lam") * 2, F.col("lam") + 1)))
        fits = (F.col("bend") > 0) & (F.abs(newton - F.col("lam")) < 4 * (1 + F.abs(F.col("lam")))) & (
            F.coalesce(newton > F.col("low"), F.lit(True)) & F.coalesce(newton < F.col("high"), F.lit(True)))
        near = F.abs(F.col("taken") - F.col("target")) <= tolerance * F.col("target")
        moved = st.withColumns({"low": low, "high": high}).withColumn(
            "next", F.when(F.col("taken").isNull() | near, F.col("lam")).when(fits, newton).otherwise(wide))
        state = settle(moved.select("source", "mean", "target", "source_size", F.coalesce("next", "lam").alias("lam"), "low", "high",
                                    (F.col("done") | F.coalesce(near, F.lit(True))).alias("done")), "balance")
    return state.select("source", F.round("lam", 9).alias("lam"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, doc_id: str = "doc_id",
    source: str = "source", size: str = "size", block: int = 10_000, offsets: int = 64,
) -> DataFrame:
    """Every input row as struct ``row`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    ``block`` is the number of documents that a running sum goes over at a time. Rows are shuffled: leave texts out, as
    :func:`take` does.
    """
    sized = settle(packed(docs, doc=F.col(doc_id), source=F.col(source), size=F.col(size).cast("long")), "sized")
    counts = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = settle(targets(totals.select("source", "source_size"), list(weights), share, cap).alias("t").join(
        totals.select(F.col("source").alias("s"), "docs"), F.col("t.source").eqNullSafe(F.col("s"))).select(
        "t.*", (F.col("source_size") / F.col("docs")).alias("mean")), "targets")
    lam = balance(counts, goals, cap)
    rated = goals.alias("g").join(lam.select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), "source_size", "target", "mean", "lam")
    full = F.col("lam").isNull() & (F.col("size") > 0)
    raw = F.when(full, F.lit(float(cap))).when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rate = F.round(raw * MILLION).cast("long")      # whole millionths: running sums are exact
    cell = F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / block)).alias("cell")

    # Blocks: documents of one source, size and cell. Their number and rate give every running sum before a block.
    sizes = counts.join(rated, counts["source"].eqNullSafe(F.col("s"))).select(
        F.col("source").alias("ks"), F.col("size").alias("kz"), "n", "source_size", "target", rate.alias("rate"))
    sizes = settle(sizes, "rates")
    wide = sized.join(sizes, sized["source"].eqNullSafe(F.col("ks")) & (F.col("size") == F.col("kz")))
    placed = wide.select("row", "doc", "source", "size", "source_size", "target", "rate", "n", cell)
    cells = placed.groupBy("source", "size", "cell").agg(F.count("*").alias("m"), F.first("rate").alias("rate"))
    ahead = W.partitionBy("source").orderBy("size", "cell").rowsBetween(W.unboundedPreceding, -1)    # one row a block
    cells = settle(cells.withColumn("ahead", F.coalesce(F.sum(F.col("m") * F.col("rate")).over(ahead), F.lit(0))), "blocks")

    # The starting point whose rounding comes nearest to the target.
    def steps(upto, start):
        return F.floor((upto + start) / F.lit(MILLION)).cast("long")

    starts = [(2 * i + 1) * MILLION // (2 * offsets) for i in range(offsets)]
    exact = F.sum(F.col("m") * F.col("rate") * F.col("size")).cast("double") / MILLION
    sums = cells.groupBy("source").agg(exact.alias("want"), *[F.sum(
        (steps(F.col("ahead") + F.col("m") * F.col("rate"), F.lit(b)) - steps(F.col("ahead"), F.lit(b))) * F.col("size")).alias(f"b{b}")
        for b in starts])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"b{b}") - F.col("want")).alias("off"), F.lit(b).alias("start")) for b in starts]))
    chosen = sums.select(F.col("source").alias("cs"), best["start"].alias("start"))
    led = cells.join(chosen, cells["source"].eqNullSafe(F.col("cs"))).select(
        F.col("source").alias("ls"), F.col("size").alias("lz"), F.col("cell").alias("lc"), "ahead", "start")

    within = W.partitionBy("source", "size", "cell").orderBy(F.col("doc").asc_nulls_last(), F.xxhash64("row"))
    nth = placed.withColumn("nth", F.row_number().over(within))
    mixed = nth.join(led, nth["source"].eqNullSafe(F.col("ls")) & (F.col("size") == F.col("lz")) & (F.col("cell") == F.col("lc")))
    upto = F.col("ahead") + F.col("nth") * F.col("rate") + F.col("start")
    copies = F.floor(upto / F.lit(MILLION)) - F.floor((upto - F.col("rate")) / F.lit(MILLION))
    return mixed.select("row", "size", "source_size", "target", (F.col("rate") / MILLION).alias("rate"), copies.cast("int").alias("copies"))


def take(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its copies say, columns as before."""
    rows = settle(packed(docs, uid=F.monotonically_increasing_id(), doc=F.col(doc_id), source=F.col(source), size=word_count(F.col(text))), "docs")
    copies = mix(rows.select("uid", "doc", "source", "size"), doc_id="doc", **how).where("copies > 0").select("row.uid", "copies")
    return rows.join(copies, "uid").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*unpacked(docs))
