"""Exact top-k inner products by block-at-a-time pruning.

Candidates are laid out in blocks of neighbouring rows. A block's forward index is its ids and one matrix; beside it stand the
largest and smallest value of every term (component). A query's bound for a block is the sum over its terms of weight times the
block's maximum (minimum, for negative weights). A task goes through the blocks of its partition in chunks: per query, blocks
are taken in order of falling bounds and scored through their forward index until the next bound is below the k-th score, so
every block left out is proven to hold no better row. Each task keeps k rows a query; the rows of all tasks meet in a ranking
that pre-limits before it shuffles.

Queries are sent to the tasks in slices of ``slice_rows`` rows, a proven bound on what is broadcast; candidates never move after
the one layout shuffle. Blocks are cut from rows ordered by their strongest component, so that their bounds are tight; the order
changes the speed, never the result.

Values are rounded down after scaling, so scores are whole numbers. Sums that floats hold exactly are multiplied as floats, others
with Python's integers; scores beyond 64 bits are held at its ends. Vectors of unlike length count as padded with zeros.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a null id; an empty vector has score 0 with
everything. Ties go to the smaller id. Rows that repeat an id all count, but no row is its own id's answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import settle

OUT = "query_id long, vec_id long, score long"
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): rows whose vector is there and finite, components as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull()).where(~bad)


def _matrix(vectors, scale: float, width: int) -> np.ndarray:
    """Scaled and floored rows as exact doubles, or as Python integers where doubles could not hold a sum."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(scale * out)
    if not np.isfinite(out).all():
        out = np.clip(out, -np.finfo(float).max, np.finfo(float).max)
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of products stays a whole number that a double holds."""
    return a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0**52


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    if _exact(q, m):
        return (q @ m.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    full = whole(q).astype(object) @ whole(m).astype(object).T
    return np.clip(full, *LONG).astype(np.int64)


def _small(scores: np.ndarray) -> bool:
    return scores.size == 0 or max(abs(int(scores.min())), abs(int(scores.max()))) < 1 << 52


class _Running:
    """The k best so far of every query of one slice; ``held`` tells the places that are filled, as any number may be an id."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, k: int):
        self.query_ids, self.q, self.k = query_ids, q, k
        self.ids = np.zeros((len(q), k), np.int64)
        self.held = np.zeros((len(q), k), bool)
        self.scores = np.full((len(q), k), LONG[0], np.int64)

    def offer(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> None:
        scores = _products(self.q[rows], m)
        own = self.query_ids[rows][:, None] == ids[None, :]
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, own.shape)], 1)
        all_scores = np.concatenate([self.scores[rows], np.where(own, LONG[0], scores)], 1)
        empty = np.concatenate([~self.held[rows], own], 1)
        # Empty places sort last: among the lowest scores, behind every id.
        key_ids = np.where(empty, LONG[1], all_ids)
        if _small(np.where(empty, 0, all_scores)):
            width = min(self.k, all_ids.shape[1])
            ranked = np.where(empty, -np.inf, all_scores.astype(np.float64))
            order = np.lexsort((key_ids, -ranked), axis=1)[:, :width]
        else:
            order = np.stack([np.array(sorted(range(all_ids.shape[1]), key=lambda j: (bool(e[j]), -int(s[j]), int(i[j])))[: self.k])
                              for e, s, i in zip(empty, all_scores, key_ids)])
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)
        self.held[rows] = ~np.take_along_axis(empty, order, 1)
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)

    def search(self, blocks: list[tuple[np.ndarray, np.ndarray]]) -> int:
        """Offer the blocks in order of their bounds; returns how many (query, block) pairs were scored."""
        if not len(self.q) or not blocks:
            return 0
        high = np.stack([m.max(0) for _, m in blocks])
        low = np.stack([m.min(0) for _, m in blocks])
        up, down = np.maximum(self.q, 0), np.minimum(self.q, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.nan_to_num(up @ high.T + down @ low.T, nan=np.inf)
        if not (_exact(self.q, high) and _exact(self.q, low)):
            bound = bound + np.abs(bound) * 1e-9 + 1     # rounding may not hide a block
        order = np.argsort(-bound, axis=1, kind="stable")
        live, scored = np.arange(len(self.q)), 0
        for step in range(len(blocks)):
            full = self.held[live, -1]
            kth = np.where(full, self.scores[live, -1].astype(np.float64), -np.inf)
            live = live[bound[live, order[live, step]] >= kth]
            if not len(live):
                break
            taken = order[live, step]
            for b in np.unique(taken):
                rows = live[taken == b]
                self.offer(rows, *blocks[b])
                scored += len(rows)
        return scored

    def frame(self) -> pd.DataFrame:
        kept = self.held
        return pd.DataFrame({"query_id": np.repeat(self.query_ids, kept.sum(1)), "vec_id": self.ids[kept], "score": self.scores[kept]})


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 20, scale: float = 1.0, block_rows: int = 256, slice_rows: int = 8192,
    chunk_blocks: int = 64, query_step: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``queries(id, v)`` its ``k`` best rows of ``candidates(id, v)``.

    Both frames come from :func:`usable`. ``block_rows`` rows make a block, ``chunk_blocks`` blocks are held by a task at a time,
    ``slice_rows`` queries are broadcast at a time.
    """
    spark = candidates.sparkSession
    strongest = F.array_position(F.transform("v", F.abs), F.array_max(F.transform("v", F.abs))).cast("int")
    laid = candidates.withColumns({"term": strongest}).withColumn("up", F.try_element_at("v", F.col("term")) > 0)
    rows = settle(laid.repartitionByRange("term", "up", "id").sortWithinPartitions("term", "up", "id").select("id", "v"), "forward")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    n_slices = max(1, -(-queries.count() // slice_rows))
    # Slices by hash hold about slice_rows rows each; a slice is one bounded broadcast.
    sliced = settle(queries.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(n_slices))).repartitionByRange(n_slices, "slice"), "queries")
    found = None
    for s in range(n_slices):
        part = sliced.where(F.col("slice") == s).select("id", "v").toPandas()
        width_s = max([width, *map(len, part["v"])]) if len(part) else width
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(np.int64), _matrix(part["v"], scale, width_s)))

        def task(batches: Iterator[pd.DataFrame], sent=sent, width_s=width_s) -> Iterator[pd.DataFrame]:
            query_ids, q = sent.value
            runs = [_Running(query_ids[i:i + query_step], q[i:i + query_step], k) for i in range(0, len(q), query_step)]
            chunk: list[tuple[np.ndarray, np.ndarray]] = []
            for batch in batches:
                ids = batch["id"].to_numpy(np.int64)
                m = _matrix(batch["v"], scale, width_s)
                for i in range(0, len(ids), block_rows):
                    chunk.append((ids[i:i + block_rows], m[i:i + block_rows]))
                if len(chunk) >= chunk_blocks:
                    for r in runs:
                        r.search(chunk)
                    chunk = []
            for r in runs:
                r.search(chunk)
                yield r.frame()

        tops = rows.mapInPandas(task, OUT)
        found = tops if found is None else found.unionByName(tops)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
