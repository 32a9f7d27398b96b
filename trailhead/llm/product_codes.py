"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Equal vectors are first put together, so that copies never meet as pairs. Each distinct vector, scaled to length one, is then indexed:

- **Coarse lists.** The dimensions are cut in two halves, each with a codebook of about the square root of (distinct vectors /
  ``list_rows``) centres; the pair of nearest centres names the vector's list. Lists thereby grow in number with the data while the
  codebooks that go to the tasks stay small (at most ``MAX_CENTRES`` centres a half).
- **Codes.** What is left after the centres is quantised in ``parts`` subspaces of ``codes`` entries each, one byte a subspace, and
  the length of the remaining error is kept beside the code.
- **Probes.** A vector looks into every list whose region comes within ``reach`` times the link radius of it: the distances to
  the bisecting planes of both halves, squared and added. A link is found if either end looks into the other's list. ``reach`` of 0.7072 is
  enough for any data, as of two vectors on both sides of the planes one is always that near; the default relies on the difference
  of two near vectors being spread over the dimensions, and the README has measured figures.
- **Table look-up.** In a list, distances from whole vectors to codes are sums over per-subspace tables. A pair is passed on unless that
  distance is above the radius plus the code's own error, which the triangle inequality proves to be no link.
- **Exact rerank.** Pairs that are passed on get their cosine in double precision.

Lists of one first-half centre are dealt together, in tiles of bounded rows: a centre that draws many vectors is cut into pieces,
and every pair of pieces is one task group. A tile gives back one row a vector: the links counted, and the least vector it is joined
with inside the tile. Links as such are never written, so groups of thousands of near copies don't multiply rows. Each link is
counted in one tile only, by the vectors' written probe lists. The tiles' rows are summed, and their joins go through connected components.

The codebooks are fitted on a sample of at most ``SAMPLE_VALUES`` numbers (``SAMPLE_ROWS`` vectors), drawn by hash; all vectors are indexed.

Defined cases: vectors that are null, empty, zero or hold null or non-finite entries link with nothing; neither do rows without an id,
which have a null component and are kept. Shorter vectors count as filled up with zeros. Rows that repeat an id are vectors of their own.
Copies link with each other like any near vectors. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import id128, packed
from .components import components
from .dense import binaries, entries, finite, matrix, stacked

SAMPLE_ROWS = 32_768
SAMPLE_VALUES = 1 << 21         # 16 MB of doubles
MAX_CENTRES = 8_192             # a half
BLOCK = 1 << 20                 # pairs whose tables are summed at a time
MEMBER, PROBER = 1, 2


@dataclass(frozen=True)
class Codebook:
    """Everything a task needs to place, encode and compare vectors of ``width`` dimensions."""

    width: int
    centres: tuple[np.ndarray, np.ndarray]
    words: list[np.ndarray]         # per subspace: its entries

    @property
    def half(self) -> int:
        return (self.width + 1) // 2

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half:]

    def cuts(self) -> list[slice]:
        ends = np.cumsum([0, *(w.shape[1] for w in self.words)])
        return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]

    def residual(self, x: np.ndarray, own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return x - np.hstack([c[o] for c, o in zip(self.centres, own)])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), np.finfo(float).tiny)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(1)), np.finfo(float).tiny)[:, None]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1), 0)


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from random rows; a centre that loses all rows stays where it is."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([_squares(x[i:i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        order = np.argsort(nearest, kind="stable")
        held, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        c[held] = sums / np.diff([*first, len(x)])[:, None]
    return c


def fit(sample: np.ndarray, rows: int, list_rows: int = 64, parts: int = 16, codes: int = 64, seed: int = 7) -> Codebook:
    """Codebooks for ``rows`` vectors from a sample of unit vectors."""
    rng, width = np.random.default_rng(seed), sample.shape[1]
    half = (width + 1) // 2
    k = int(min(MAX_CENTRES, max(1, round((rows / list_rows) ** 0.5)), max(1, len(sample) // 4)))
    centres = tuple(_centres(part, k, rng) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, :half], sample[:, half:]))
    own = tuple(_squares(part, c).argmin(1) for part, c in zip((sample[:, :half], sample[:, half:]), centres))
    left = (sample - np.hstack([c[o] for c, o in zip(centres, own)]))[:8192]
    words = [_centres(left[:, cut], codes, rng) for cut in np.array_split(np.arange(width), min(parts, width))]
    return Codebook(width, centres, words)


def _place(book: Codebook, x: np.ndarray, radius: float):
    """Per vector: both own centres, and the rows and lists of all its probes, the own list first in each row's run."""
    own, near = [], []
    for part, c in zip(book.halves(x), book.centres):
        d = _squares(part, c)
        home = d.argmin(1)
        apart = np.sqrt(_squares(c, c))[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.maximum((d - d[np.arange(len(x)), home][:, None]) / (2 * apart), 0)
        plane[~(apart > 0)] = 0       # centres that coincide
        plane[np.arange(len(x)), home] = 0
        own.append(home)
        near.append(plane)
    row1, list1 = np.nonzero(near[0] <= radius)
    row2, list2 = np.nonzero(near[1] <= radius)
    n1, n2 = np.bincount(row1, minlength=len(x)), np.bincount(row2, minlength=len(x))
    start2 = np.cumsum(n2) - n2
    # Every probe of the first half meets every probe of the second half of its row.
    times = n2[row1]
    rows = np.repeat(row1, times)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times) + start2[rows]
    first, second = np.repeat(list1, times), list2[at]
    close = near[0][rows, first] ** 2 + near[1][rows, second] ** 2 <= radius * radius
    return own, rows[close], first[close], second[close]


INDEX = "node long, copies long, x binary, home int, cell long, probes binary, lists array<int>, code binary, error float"


def _indexed(reps: DataFrame, book, width: int, radius: float) -> DataFrame:
    """One row per distinct vector: its list, code and probes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Codebook = book.value
        k2 = len(b.centres[1])
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                raw = matrix(part.column(2), width)
                x = unit(raw)
                own, rows, first, second = _place(b, x, radius)
                left = b.residual(x, own)
                code = np.stack([_squares(left[:, c], w).argmin(1) for c, w in zip(b.cuts(), b.words)], 1)
                error = np.sqrt(sum(((left[:, c] - w[code[:, j]]) ** 2).sum(1) for j, (c, w) in enumerate(zip(b.cuts(), b.words))))
                ends = np.searchsorted(rows, np.arange(len(x) + 1))
                cells = first.astype(np.int64) * k2 + second
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), binaries(raw if (raw != raw.astype(np.float32)).any() else raw.astype(np.float32)),
                    pa.array(own[0].astype(np.int32)), pa.array(own[0].astype(np.int64) * k2 + own[1]),
                    pa.array([cells[p:q].tobytes() for p, q in zip(ends[:-1], ends[1:])], pa.binary()),
                    pa.array([np.unique(first[p:q]).astype(np.int32) for p, q in zip(ends[:-1], ends[1:])], pa.list_(pa.int32())),
                    binaries(code.astype(np.uint8)), pa.array(error.astype(np.float32))],
                    ["node", "copies", "x", "home", "cell", "probes", "lists", "code", "error"])

    return reps.select("node", "copies", "v").mapInArrow(task, INDEX)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i]; ``label`` holds each row's group, named by its least row."""
    while len(a):
        p, q = label[a], label[b]
        differ = p != q
        a, b, p, q = a[differ], b[differ], p[differ], q[differ]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _tile_links(b: Codebook, table: pa.Table, threshold: float) -> pa.Table:
    """Links between the members and probers of one tile: per linked vector its number and the least vector it is joined with."""
    n, first = table.num_rows, table["list"][0].as_py()
    node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    cell, role, error = table["cell"].to_numpy(), table["role"].to_numpy(), table["error"].to_numpy()
    x = np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * b.width else np.float64).astype(np.float64)
                  for v in table["x"].combine_chunks().to_pylist()])
    x = unit(x)
    code = stacked(table["code"].combine_chunks(), "u1", len(b.words))
    probes = [np.frombuffer(p, np.int64) for p in table["probes"].to_pylist()]
    k2, radius = len(b.centres[1]), np.sqrt(max(0.0, 2 - 2 * threshold))
    links, label = np.zeros(n, np.int64), np.arange(n)

    members = np.flatnonzero(role & MEMBER)
    members = members[np.argsort(cell[members], kind="stable")]
    prober_row = np.repeat(np.arange(n), [len(p) if r & PROBER else 0 for p, r in zip(probes, role)])
    prober_cell = np.concatenate([p for p, r in zip(probes, role) if r & PROBER] or [np.zeros(0, np.int64)])
    here = prober_cell // k2 == first
    prober_row, prober_cell = prober_row[here], prober_cell[here]
    order = np.argsort(prober_cell, kind="stable")
    prober_row, prober_cell = prober_row[order], prober_cell[order]
    # (row, list) pairs of all members' probes: tells whether a link is also met from the other side.
    looks = np.sort(np.concatenate([probes[m] * n + m for m in members] or [np.zeros(0, np.int64)])) if k2 * len(b.centres[0]) < 2**62 // n else None
    member_cells, m_first = np.unique(cell[members], return_index=True)
    m_last = [*m_first[1:], len(members)]
    p_first, p_last = np.searchsorted(prober_cell, member_cells), np.searchsorted(prober_cell, member_cells, "right")

    def both_ways(at: np.ndarray, y: np.ndarray) -> np.ndarray:
        if looks is None:
            return np.array([c in set(probes[m].tolist()) for c, m in zip(at.tolist(), y.tolist())], bool)
        keys = at * n + y
        place = np.minimum(np.searchsorted(looks, keys), len(looks) - 1)
        return looks[place] == keys

    for c, m0, m1, p0, p1 in zip(member_cells.tolist(), m_first, m_last, p_first, p_last):
        ys = members[m0:m1]
        middle = np.hstack([b.centres[0][c // k2], b.centres[1][c % k2]])
        step = max(1, BLOCK // len(ys))
        for i in range(p0, p1, step):
            xs = prober_row[i:min(i + step, p1)]
            left = (x[xs] - middle).astype(np.float32)
            far = np.zeros((len(xs), len(ys)), np.float32)
            for j, (cut, words) in enumerate(zip(b.cuts(), b.words)):
                far += _squares(left[:, cut], words.astype(np.float32)).take(code[ys, j], axis=1)
            limit = (radius + error[ys] + 1e-3) ** 2
            p, q = np.nonzero(far <= limit)
            for s in range(0, len(p), 65_536):
                a, d = xs[p[s:s + 65_536]], ys[q[s:s + 65_536]]
                linked = np.einsum("ij,ij->i", x[a], x[d]) >= threshold
                linked &= np.where(cell[a] == c, node[a] < node[d], node[a] != node[d])
                a, d = a[linked], d[linked]
                again = (cell[a] != c) & both_ways(cell[a], d) & (cell[a] < c)     # counted from the other side
                _union(label, a, d)
                a, d = a[~again], d[~again]
                np.add.at(links, a, copies[d])
                np.add.at(links, d, copies[a])
    out = (links > 0) | (label != np.arange(n)) | np.isin(np.arange(n), label[label != np.arange(n)])
    return pa.table({"node": node[out], "links": links[out], "root": node[label[out]]})


def links(
    reps: DataFrame, threshold: float = 0.95, list_rows: int = 64, reach: float = 0.2, parts: int = 16, codes: int = 64,
    tile_rows: int = 32_768, seed: int = 7,
) -> DataFrame:
    """(node, links, root): per tile, the links of a vector weighted by ``copies``, and a vector it is joined with.

    ``reps`` is (node, copies, v) with distinct ``node`` and distinct finite vectors other than zero.
    """
    spark = reps.sparkSession
    rows, width = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    if not rows:
        return spark.createDataFrame([], "node long, links long, root long")
    most = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    drawn = reps.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int(min(1.0, most / rows) * (1 << 30))).select("v").limit(2 * most)
    sample = drawn.toArrow()["v"].combine_chunks()
    sample = unit(matrix(sample, width)) if len(sample) else np.eye(1, width)
    book = spark.sparkContext.broadcast(fit(sample, rows, list_rows, parts, codes, seed))
    radius = reach * max(0.0, 2 - 2 * threshold) ** 0.5
    index = settle(_indexed(reps, book, width, radius), "index")
    # One row for each first-half centre, at most MAX_CENTRES.
    pieces = index.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("pieces"))
    dealt = index.withColumn("list", F.explode("lists")).join(F.broadcast(pieces), "list")
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    others = F.sequence(F.lit(0), F.col("pieces") - 1)

    def tiles(role):
        return F.transform(others, lambda i: F.struct(
            F.when(F.lit(role == MEMBER), F.col("piece")).otherwise(i).alias("a"), F.when(F.lit(role == MEMBER), i).otherwise(F.col("piece")).alias("b"),
            F.when((F.col("home") == F.col("list")) & (i == F.col("piece")), MEMBER + PROBER).otherwise(role).alias("role")))

    at_home = F.col("home") == F.col("list")
    both = F.when(at_home, F.concat(tiles(PROBER), F.filter(tiles(MEMBER), lambda t: t["role"] == MEMBER))).otherwise(tiles(PROBER))
    dealt = dealt.withColumn("piece", piece).select(
        "list", F.inline(both), "node", "copies", "x", "cell", "code", "error", "probes")

    def task(table: pa.Table) -> pa.Table:
        return _tile_links(book.value, table, threshold)

    return dealt.groupBy("list", "a", "b").applyInArrow(task, "node long, links long, root long")


def classes(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, keep: list[str] | None = None, **index) -> DataFrame:
    """``row`` (the input row, or its columns ``keep``), ``n_links``, ``component_id`` and ``kept`` for every row.

    ``index`` are the parameters of :func:`links`.
    """
    v = entries(df, vector)
    rows = packed(df, keep, id=F.col(f"`{id_col}`").cast("long"), v=v)
    sound = finite(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("key", F.when(sound, id128("v")))
    one = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    reps = settle(one.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = settle(links(reps.select("node", "copies", "v"), threshold, **index), "links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select("node", "root"), "node", "root").select(F.col("id").alias("node"), F.col("root").alias("part"))
    named = joined.join(reps.select("node", "id"), "node")
    named = named.join(named.groupBy("part").agg(F.min("id").alias("component")), "part").select("node", "component")
    facts = reps.select("node", "key", "id", "copies").join(counted, "node", "left").join(named, "node", "left").select(
        "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    return rows.select("row", "id", "key").join(facts, "key", "left").select(
        "row", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"))
