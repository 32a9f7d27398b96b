"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed. A pass over the distributed vectors multiplies it with a thin block, as the sum of
Xᵀ(X Q) over centred tiles of rows; the driver holds blocks of (dimensions × block columns) only. A few Lanczos steps bound the
spectrum from below. Each round then applies a Chebyshev polynomial by its three-term recurrence, one pass a degree: it stays small
over the unwanted interval and grows fast beyond it, so the block turns towards the leading eigenvectors. QR and a Rayleigh-Ritz
step follow, whose product with the covariance also gives the residuals. Rounds end when every wanted residual is certified below
``tolerance`` times the largest eigenvalue. A block that gains too little in a round is widened with new random columns, up to all
dimensions, where Rayleigh-Ritz alone is exact; so the end does not depend on gaps in the spectrum.

The fit list holds each distinct vector once, as whole numbers floor(scale * c). It is written to the shared folder as packed tiles
(two bytes an entry where the values allow), read by every pass. Sums are whole numbers, and rows are centred by an exact whole
shift before the remaining fraction is taken off, so no digits cancel. A constant added to all entries changes none of the results;
``offset`` therefore enters the reported sums only.

Defined cases: a vector that is null or holds null or non-finite entries is left out of the result. Shorter vectors count as filled
up with zeros. Scaled entries are held at ±2^62. Rows may repeat: copies count once in the fit and all get their row. An empty table
gives no rows. Components whose eigenvalue is below 1e-10 of the largest can't be scaled to one and are left out, so fewer than
``components`` come back for data of low rank and none where all vectors are equal. Equal eigenvalues have no order of their own; any
basis of their space may come. A deviation that 64 bits can't hold is null. Other columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import packed
from .dense import binaries, entries, finite, matrix

HELD = 1 << 62
LEAST = 1e-10       # of the largest eigenvalue
FAN = 256           # partial sums that the driver takes in one by one


@dataclass(frozen=True)
class Whitening:
    """Eigenvalues in falling order, eigenvectors as columns, and what the fit proved about them."""

    n: int
    sums: list[int]         # of scaled entries plus offset, per dimension
    offset: int
    scale: float
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float         # largest |V q - e q| of a component, as a share of the largest eigenvalue
    identity_error: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values

    def plain_sums(self) -> list[int]:
        return [s - self.n * self.offset for s in self.sums]


def _scaled(m: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * m), -HELD, HELD).astype(np.int64)


def _tiles(rows: DataFrame, vector: str, width: int, scale: float) -> DataFrame:
    """(item, data): the distinct scaled vectors, many to a row, each entry in ``item`` bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _scaled(matrix(batch.column(0), width), scale)
            small = (np.abs(m) < 1 << 15).all(1)
            for part, dtype in ((m[small], "<i2"), (m[~small], "<i8")):
                if len(part):
                    yield pa.RecordBatch.from_arrays([binaries(part.astype(dtype))], ["x"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0)
            sizes = pc.binary_length(x)
            for size in pc.unique(sizes).to_pylist():
                data = b"".join(x.filter(pc.equal(sizes, size)).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([size // width], pa.int32()), pa.array([data], pa.binary())], ["item", "data"])

    distinct = rows.select(vector).mapInArrow(pack, "x binary").distinct()
    return settle(distinct.mapInArrow(tile, "item int, data binary"), "vectors")


def _total(tiles: DataFrame, width: int, task: Callable[[np.ndarray], np.ndarray]):
    """The sum of ``task(rows)`` over all tiles; null without a tile. Partial sums meet in the order of their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = task(np.frombuffer(data.as_buffer(), f"<i{item}").reshape(-1, width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["part", "data"])

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table({"part": table["part"][:1], "data": pa.array([pickle.dumps(sum(map(pickle.loads, table["data"].to_pylist())))], pa.binary())})

    sums = tiles.mapInArrow(run, "part int, data binary")
    if tiles.rdd.getNumPartitions() > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(meet, "part int, data binary")
    parts = sorted(sums.collect())
    return sum(pickle.loads(p["data"]) for p in parts) if parts else None


class _Covariance:
    """The covariance of the tiles as something that multiplies blocks, one pass each."""

    def __init__(self, tiles: DataFrame, width: int):
        self.tiles, self.width, self.passes = tiles, width, 0

        def count(y: np.ndarray) -> np.ndarray:
            exact = y.astype(np.int64) if int(np.abs(y).max(initial=0)) < 1 << 40 else y.astype(object)
            return np.array([len(y), *map(int, exact.sum(0))], object)

        found = _total(tiles, width, count)
        self.n, self.sums = (0, [0] * width) if found is None else (int(found[0]), [int(s) for s in found[1:]])
        if self.n:
            self.shift = np.array([s // self.n for s in self.sums], np.int64)
            self.rest = np.array([(s % self.n) / self.n for s in self.sums])
            centre = self.centre
            self.trace = float(_total(tiles, width, lambda y: (centre(y) ** 2).sum(0)).sum()) / self.n
        else:
            self.trace = 0.0

    @property
    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        shift, rest = self.shift, self.rest
        return lambda y: (y.astype(np.int64) - shift).astype(np.float64) - rest

    def times(self, q: np.ndarray) -> np.ndarray:
        sent, centre = self.tiles.sparkSession.sparkContext.broadcast(q), self.centre

        def task(y: np.ndarray) -> np.ndarray:
            x = centre(y)
            return x.T @ (x @ sent.value)

        out = _total(self.tiles, self.width, task) / self.n
        sent.destroy()
        self.passes += 1
        return out

    def whitened_gram(self, w: np.ndarray) -> np.ndarray:
        centre = self.centre

        def task(y: np.ndarray) -> np.ndarray:
            z = centre(y) @ w
            return z.T @ z

        return _total(self.tiles, self.width, task) / self.n


def _floor_of_spectrum(v: _Covariance, rng: np.random.Generator, steps: int) -> float:
    """A number that the smallest eigenvalue is unlikely to be below, from a few Lanczos steps; later rounds correct it."""
    q = rng.standard_normal(v.width)
    basis, a, b = [q / np.linalg.norm(q)], [], []
    while True:
        w = v.times(basis[-1][:, None])[:, 0]
        a.append(float(w @ basis[-1]))
        for u in basis * 2:     # twice: keeps the basis orthogonal
            w = w - (w @ u) * u
        size = float(np.linalg.norm(w))
        low = float(np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))[0])
        if len(a) >= steps or size <= 1e-12 * max(map(abs, a)):
            return max(0.0, low - size)
        b.append(size)
        basis.append(w / size)


def _filtered(v: _Covariance, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance, small over [low, cut] and about 1 at ``top``, times the block."""
    half, mid = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - mid)
    before, now = q, (vq - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (v.times(now) - mid * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def _ritz(v: _Covariance, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(block)
    vq = v.times(q)
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def _leading(v: _Covariance, k: int, guard: int, degree: int, tolerance: float, max_rounds: int, seed: int):
    """(values, vectors, residual): the k leading eigenpairs."""
    rng = np.random.default_rng(seed)
    size = min(v.width, k + guard)
    low = _floor_of_spectrum(v, rng, min(v.width, 10)) if size < v.width else 0.0
    values, q, vq = _ritz(v, rng.standard_normal((v.width, size)))
    last = np.inf
    for _ in range(max_rounds):
        top = float(values[0])
        if top <= 0:
            return values[:0], q[:, :0], 0.0
        gaps = np.linalg.norm(vq - q * values, axis=0)[:k] / top
        worst = float(gaps.max())
        # Rounding sets a floor: a residual near it that no longer falls is as certified as it can be.
        if worst <= tolerance or q.shape[1] == v.width or (worst <= 100 * tolerance and worst > last / 2):
            sure = values[:k] > LEAST * top
            return values[:k][sure], q[:, :k][:, sure], worst
        if worst > last / 10:
            more = min(v.width, 2 * q.shape[1]) - q.shape[1]
            values, q, vq = _ritz(v, np.hstack([q, rng.standard_normal((v.width, more))]))
            last = np.inf
            continue
        last = worst
        low = min(low, max(0.0, 0.9 * float(values[-1])))
        cut = float(values[-1])
        if cut - low <= 1e-9 * top:
            low = max(0.0, cut - 1e-3 * top)
            cut = max(cut, low + 1e-9 * top)
        values, q, vq = _ritz(v, _filtered(v, q, vq, degree, low, cut, top))
    raise RuntimeError(f"no certified eigenvectors after {max_rounds} rounds: residual {worst:.2g} of the largest eigenvalue")


def fit(
    df: DataFrame, vector: str = "embedding", components: int = 16, scale: float = 64.0, offset: int = 1_000_000, guard: int = 16,
    degree: int = 8, tolerance: float = 1e-13, max_rounds: int = 100, seed: int = 7,
) -> Whitening:
    """The leading ``components`` eigenpairs of the covariance of the distinct scaled vectors.

    ``guard`` further columns speed the rounds up. Raises an error rather than return pairs that aren't certified.
    """
    rows = df.select(entries(df, vector).alias("v")).where(finite(F.col("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    v = _Covariance(_tiles(rows, "v", width, scale), width) if width else None
    if v is None or not v.n or not v.trace:
        n, sums = (v.n, v.sums) if v else (0, [])
        return Whitening(n, [s + n * offset for s in sums], offset, scale, np.zeros(0), np.zeros((width, 0)), 0.0, 0.0, 0.0, 0)
    values, vectors, residual = _leading(v, min(components, width), guard, degree, tolerance, max_rounds, seed)
    error = float(np.abs(v.whitened_gram(vectors / np.sqrt(values)) - np.eye(len(values))).max(initial=0))
    return Whitening(v.n, [s + v.n * offset for s in v.sums], offset, scale, values, vectors, v.trace, residual, error, v.passes)


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the input row, or its columns ``keep``), ``deviation`` and ``whitened``, an array with one number a component."""
    rows = packed(df, keep, v=entries(df, vector)).where(finite(F.col("v")))
    width, n, sums = len(model.vectors), model.n, model.plain_sums()
    sent = df.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))
    scale, k, most = model.scale, len(model.values), max(map(abs, sums), default=0)
    shift = np.array([s // n for s in sums] if n else [], np.int64)
    rest = np.array([(s % n) / n for s in sums] if n else [])
    out = rows.select("row").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.array().cast("array<double>")}).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _scaled(matrix(batch.column(1), width), scale)
            far = n * int(np.abs(y).max(initial=0)) + most
            exact = far * far * max(width, 1) < 1 << 63
            gap = n * (y if exact else y.astype(object)) - np.array(sums, np.int64 if exact else object)
            squares = (gap * gap).sum(1) if width else np.zeros(len(y), np.int64)
            deviation = pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())
            z = ((y - shift).astype(np.float64) - rest) @ sent.value
            ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
            whitened = pa.ListArray.from_arrays(ends, pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, whitened], ["row", "deviation", "whitened"])

    return rows.select("row", "v").mapInArrow(task, out)
