"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles: count in the document times inverse document frequency. Frequencies
are counted over all documents in ``2 ** bits`` hashed features, a bounded table that is sent to the tasks. These counts serve for sampling and are
upper bounds of a shingle's own. Consistent weighted sampling draws ``bands * rows`` samples a document such that two documents' samples agree with the probability of their weighted
Jaccard similarity. Documents that agree in all rows of a band are candidates; these are verified by the weighted Jaccard similarity
of their whole texts under exact frequencies: where the bounds leave the verdict open, a second pass counts the exact frequencies of
the open candidates' shingles over all documents. Classes are the connected components of verified links.

A band's bucket may hold very many documents. They are not paired with each other: in each round a bucket's documents are
compared with one leader, other rounds have other leaders, and documents already in the leader's class are left out. For documents that
still share a bucket with another class an exact prefix filter ends the search: similar texts share one of their rarest shingles, so
documents of different classes that do are compared, and no link between them is lost. Candidates whose samples agree
in less than ``screen`` of all places are not verified (at a similarity of 0.8 under the sampling weights and 48 samples under one in 100,000; the
sampling weights are the hashed ones, so candidates are found by them, and only their verification is exact).

Equal texts are one from the beginning. Defined cases: a text with fewer words than a shingle is one shingle; texts without words (and null texts) have none
and are alone. Ids are compared by (id, hash of the text); rows equal in both are one document. A null id sorts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .common import BITMAP, bound_batches, packed, unpacked
from .components import components

SLICES = 64
BLOCK = 512             # documents of a cell that meet as many others in a task at a time
HELD = 1 << 20          # shingles of texts that a task keeps for the next pairs; 16 MB
CHUNK = 16_384          # shingles that are sampled at a time: they stay in the processor's cache
STEP = 1 << 15          # bytes of a text that are hashed at a time
SPAN = 1 << 17          # letters of texts that are cut into shingles together
MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64))])


class Shingler:
    """Distinct shingle hashes of a text and their counts.

    A word's hash is the sum of a random number for each byte times a power of an odd base by its place, from running sums over the whole text.
    """

    def __init__(self, width: int = 5):
        self.width = width
        self.letter = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.inverse = pow(int(MIX), -1, 1 << 64)
        self.up, self.down = _powers(int(MIX), STEP), _powers(self.inverse, STEP)

    def words(self, text: str, exact: Callable[[bytes], int] | None = None, long: int = 32) -> np.ndarray:
        """A hash for each word; of words over ``long`` bytes by ``exact``, if given: sums of powers can be equal by design in long ones."""
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        out, starts, ends = self._hashed(data)
        if exact:
            for i in np.flatnonzero(ends - starts > long).tolist():
                out[i] = exact(data[starts[i]:ends[i]].tobytes())
        return out

    def _hashed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' hashes, wherever they stand, and where they begin and end."""
        gap = np.ones(len(data) + 2, bool)
        gap[1:-1] = self.space[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])        # where words begin and end, in turn
        sums, carry = np.zeros(len(edges), np.uint64), np.zeros(1, np.uint64)
        for lo in range(0, len(data), STEP):
            part = self.letter[data[lo:lo + STEP]] * self.up[:len(data) - lo]
            if lo:
                part *= np.uint64(pow(int(MIX), lo, 1 << 64))
            np.cumsum(part, out=part)
            part += carry
            i, j = np.searchsorted(edges, (lo + 1, lo + len(part) + 1))
            sums[i:j] = part[edges[i:j] - lo - 1]
            carry = part[-1:].copy()
        starts = edges[::2]
        out = (sums[1::2] - sums[::2]) * self.down[starts % STEP]
        if len(data) > STEP:
            out *= _powers(pow(self.inverse, STEP, 1 << 64), len(data) // STEP + 1)[starts // STEP]
        return (out ^ (out >> np.uint64(32))) * MIX, starts, edges[1::2]

    def _shingled(self, h: np.ndarray, at: slice | np.ndarray, words: int) -> np.ndarray:
        """Hashes of the runs of ``words`` words that begin at ``at``."""
        n = len(h) - words + 1
        out = np.zeros(n if isinstance(at, slice) else len(at), np.uint64)
        for k in range(words):
            out = (out ^ (out >> np.uint64(31))) * MIX + (h[k:k + n] if isinstance(at, slice) else h[at + k])
        out = (out ^ (out >> np.uint64(29))) * MIX
        out ^= out >> np.uint64(32)
        return out

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h = self.words(text or "")
        n = max(len(h) - self.width + 1, min(len(h), 1))
        out = self._shingled(h, slice(None), min(self.width, len(h))) if n else np.zeros(0, np.uint64)
        out.sort()
        at = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]])[:n])
        return out[at], np.diff(at, append=n)

    def many(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of many texts, for some at a time: their shingles and counts one text after the other, and where each text's begin, with the end."""
        part, size = [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size >= SPAN:
                yield self._some(part)
                part, size = [], 0
        if part:
            yield self._some(part)

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        h, starts, _ = self._hashed(np.frombuffer(b" ".join(raw), np.uint8))
        first = np.searchsorted(starts, np.cumsum([0, *[len(r) + 1 for r in raw]]))      # the first word of each text
        words = np.diff(first)
        runs = np.where(words >= self.width, words - self.width + 1, np.minimum(words, 1))
        begins = np.concatenate([[0], np.cumsum(runs)])
        of = np.repeat(np.arange(len(texts)), runs)
        out = np.empty(len(of), np.uint64)
        if (words >= self.width).any():
            place = first[of] + np.arange(len(of)) - begins[of]
            long = words[of] >= self.width
            out[long] = self._shingled(h, slice(None), self.width)[place[long]]
        for n in range(1, self.width):
            short = np.flatnonzero(words == n)
            if len(short):
                out[begins[short]] = self._shingled(h, first[short], n)
        for i in np.flatnonzero(runs > 1).tolist():
            out[begins[i]:begins[i + 1]].sort()
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        return out[at], np.diff(at, append=len(out)), np.searchsorted(at, begins)


def shingled(docs: DataFrame, text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with the bytes of its sorted distinct shingles, ``tokens``, and of their ``counts`` in place of the text."""
    keep = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            tokens, times, runs = [np.empty(0, np.uint64)], [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
            for found, counts, begins in shingle.many(batch.column(text).to_pylist()):
                tokens.append(found)
                times.append(counts.astype(np.int32))
                runs.append(np.diff(begins))
            ends = np.cumsum(np.concatenate(runs))
            packed = [pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((ends * x[0].itemsize).astype(np.int32)), pa.py_buffer(np.concatenate(x))])
                      for x in (tokens, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *packed], [*keep, "tokens", "counts"])

    return docs.mapInArrow(cut, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "tokens binary, counts binary"]))


def _unpacked(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of their bytes, one row after the other, and where each row's begin, with the end."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data if data is not None else b"", np.uint8)[ends[0]:ends[-1]].view(kind)
    return values, (ends - ends[0]) // np.dtype(kind).itemsize


def frequencies(docs: DataFrame, text: str = "text", bits: int = 20, width: int = 5) -> tuple[int, np.ndarray]:
    """Number of documents with shingles, and of documents with each hashed feature: over all documents, ``8 * 2**bits`` bytes."""
    return feature_counts(shingled(docs.select(F.col(text).alias("text")), "text", width), bits)


def feature_counts(sets: DataFrame, bits: int = 20) -> tuple[int, np.ndarray]:
    """:func:`frequencies` of ``sets(tokens)``."""
    size, part = 1 << bits, (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, np.int64), 0
        for batch in batches:
            found, begins = _unpacked(batch.column(0), np.uint64)
            n += int((np.diff(begins) > 0).sum())
            places = (found >> np.uint64(64 - bits)).astype(np.int64)      # ascending in a text, like the hashes
            new = np.diff(places, prepend=-1) != 0
            new[begins[:-1][np.diff(begins) > 0]] = True
            np.add.at(seen, places[new], 1)
        if n:
            rows = [seen[i * part:(i + 1) * part].tobytes() for i in range(SLICES)]
            yield pa.record_batch({"slice": pa.array([*range(SLICES), -1], pa.int32()), "counts": pa.array([*rows, np.int64(n).tobytes()], pa.binary())})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch["slice"], batch["counts"]):
                counts = np.frombuffer(raw, np.int64)
                total[s] = total[s] + counts if s in total else counts
        yield pd.DataFrame({"slice": list(total), "counts": [c.tobytes() for c in total.values()]})

    kind = "slice int, counts binary"
    found = sets.select("tokens").mapInArrow(count, kind).repartition("slice").mapInPandas(add, kind).collect()
    by = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in found}
    n = int(by[-1][0]) if by else 0
    return n, np.concatenate([by[i] for i in range(SLICES)]) if by else np.zeros(size, np.int64)


class Weights:
    """Inverse document frequency by hashed feature: never above a shingle's own, which is never above ``most``."""

    def __init__(self, n: int, seen: np.ndarray):
        self.shift = np.uint64(64 - (len(seen).bit_length() - 1))
        self.idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
        self.most = float(np.log((1 + n) / 2) + 1)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) * self.idf[(shingles >> self.shift).astype(np.int64)]


class Sampler:
    """Improved consistent weighted sampling. A sample is the value at its minimum, which names shingle and level at once."""

    def __init__(self, samples: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Gamma(2, 1) at 65,536 equally probable places, once for the level's step r and once for log c.
        grid = (np.arange(65536) + 0.5) / 65536
        x = np.linspace(0, 40, 400_001)
        gamma = np.interp(grid, 1 - np.exp(-x) * (1 + x), x)
        self.r, self.inverse, self.log_c = gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32)

    def __call__(self, shingles: np.ndarray, log_w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Samples (documents × samples) of concatenated documents that begin at ``starts``."""
        out = np.empty((len(starts), len(self.odd)), np.float32)
        for k, odd in enumerate(self.odd):
            bits = (shingles * odd).view(np.uint16).reshape(-1, 4)
            at = bits[:, 3].astype(np.intp)
            r, beta = self.r[at], bits[:, 1] * np.float32(1 / 65536)
            level = np.floor(log_w * self.inverse[at] + beta)
            value = self.log_c[bits[:, 2].astype(np.intp)] - r * (level - beta + 1)
            out[:, k] = np.minimum.reduceat(value, starts)
        return out


def signatures(sets: DataFrame, weights: Weights, samples: int) -> DataFrame:
    """(doc, sig, total, most, samples): of each row of ``sets(doc, sig, tokens, counts)`` the whole weight, a bound of its exact value, and the samples, as whole numbers; null without shingles."""
    sent = sets.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, sampler = sent.value, Sampler(samples)
        for batch in batches:
            total, most, drawn = [], [], []
            found, begins = _unpacked(batch.column("tokens"), np.uint64)
            counts, _ = _unpacked(batch.column("counts"), np.int32)
            w = weigh(found, counts)
            for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
                total.append(float(w[a:b].sum(dtype=np.float64)) if b > a else None)
                most.append(float(counts[a:b].sum() * weigh.most) if b > a else None)
            some = np.diff(begins) > 0
            ends = np.concatenate([[0], samples * np.cumsum(some)])
            cut = begins[:-1][some]
            # So many shingles at a time, or one text, stay in the cache.
            lots = np.flatnonzero(np.diff(cut // CHUNK, prepend=-1)) if len(cut) else []
            for i, j in zip(lots, [*lots[1:], len(cut)]):
                lo, hi = cut[i], cut[j] if j < len(cut) else len(found)
                drawn.append(sampler(found[lo:hi], np.log(w[lo:hi]), cut[i:j] - lo))
            flat = np.concatenate(drawn).view(np.int32).ravel() if drawn else np.empty(0, np.int32)
            missing = pa.array([t is None for t in total], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=missing)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("sig"), pa.array(total, pa.float64()), pa.array(most, pa.float64()), lists],
                ["doc", "sig", "total", "most", "samples"])

    kinds = dict(sets.dtypes)
    return sets.select("doc", "sig", "tokens", "counts").mapInArrow(task, f"doc {kinds['doc']}, sig {kinds['sig']}, total double, most double, samples array<int>")


def jaccard(weights, a, b) -> float:
    """Weighted Jaccard similarity of two (shingles, counts)."""
    wa, wb = weights(*a).astype(np.float64), weights(*b).astype(np.float64)
    return _similarity(a[0], wa, b[0], wb)


def _similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high else 0.0


def decided(weights: Weights, a, b, threshold: float) -> bool | None:
    """Whether two (shingles, counts) are similar enough under any frequencies that the hashed ones bound; None if that depends on them.

    Similar means that the sum of (smaller count - threshold * larger count) * weight is not negative: linear in the weights.
    """
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least, most = weights(a[0][ia], np.ones(len(ia))).astype(np.float64), weights.most
    part = np.minimum(a[1][ia], b[1][ib]) - threshold * np.maximum(a[1][ia], b[1][ib])
    up, down = np.maximum(part, 0), np.minimum(part, 0)
    alone_least = alone_most = 0.0
    for (shingles, counts), at in ((a, ia), (b, ib)):
        rest = np.ones(len(shingles), bool)
        rest[at] = False
        alone_least += threshold * weights(shingles[rest], counts[rest]).sum(dtype=np.float64)
        alone_most += threshold * counts[rest].sum() * most
    margin = 1e-5 * (alone_most + (up - down).sum() * most)      # the table holds 32-bit floats
    if up.sum() * most + (down * least).sum() - alone_least < -margin:
        return False
    return True if (up * least).sum() + down.sum() * most - alone_most > margin else None


def _rare_shingles(texts: DataFrame, weights: Weights, threshold: float, width: int) -> DataFrame:
    """(token, id, root): of each text of ``texts(id, root, text)`` the rarest shingles, as many as it can lack in nothing similar.

    Two texts at the threshold share at least that part of either's weight, so they share a shingle among what comes first in any
    order of all shingles until the rest is too light, whatever the exact weights between the bounds. Rare ones come first, by the table of frequencies.
    """
    sent = texts.sparkSession.sparkContext.broadcast(weights)
    kinds = texts.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, shingle = sent.value, Shingler(width)
        for batch in batches:
            tokens, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, value in enumerate(batch.column("text")):
                found, counts = shingle(value.as_py())
                order = np.lexsort((found, -weigh.idf[(found >> weigh.shift).astype(np.int64)]))
                w = weigh(found, counts).astype(np.float64)[order]
                rest = (counts.sum() - np.cumsum(counts[order])) * weigh.most
                n = int(np.searchsorted(threshold * np.cumsum(w) - (1 - threshold) * rest * 1.0001, 0, side="right")) + 1
                tokens.append(found[order[:n]])
                rows.append(np.full(min(n, len(found)), i))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), batch.column("id").take(at), batch.column("root").take(at)],
                                             ["token", "id", "root"])

    kind = {c: kinds[c].dataType.simpleString() for c in ("id", "root")}
    return texts.select("id", "root", "text").mapInArrow(task, f"token long, id {kind['id']}, root {kind['root']}")


def _screening(unit: np.ndarray, side: np.ndarray, kind: np.ndarray, total: np.ndarray, most: np.ndarray, samples: np.ndarray, threshold: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), numbers of rows of the same unit, a of side 0 and b of side 1, of different kinds, whose weights and samples leave the threshold possible. Rows come by unit."""
    ends = [0, *(np.flatnonzero(np.diff(unit)) + 1), len(unit)]
    for lo, hi in zip(ends, ends[1:]):
        left, right = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
        step = max(1, (1 << 18) // max(1, len(right)))      # a tile's counts stay small
        for i in range(0, len(left), step):
            a = left[i:i + step]
            may = (kind[a][:, None] != kind[right]) & (most[a][:, None] >= total[right] * threshold * 0.9999) & (most[right] >= (total[a] * threshold * 0.9999)[:, None])
            x, y = np.nonzero(may)
            if not len(x):
                continue
            for j in range(0, len(x), CHUNK):
                u, v = a[x[j:j + CHUNK]], right[y[j:j + CHUNK]]
                near = (samples[u] == samples[v]).sum(1) >= least
                yield u[near], v[near]


def _near(rare: DataFrame, facts: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b, unit): documents of different classes that weights and samples leave possible, and the hash of the cell and blocks where they met, among them all that share a shingle of ``rare(token, id, root)``.

    Of each shingle the largest class stands against the others, no pairs within it. Documents that meet a class by however many shingles stand in its cell
    once, and meet its members and each other there: in arrays, in blocks of at most ``BLOCK``, so only what passes the screen becomes a row.
    """
    sizes = rare.groupBy("token", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("token").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    strays = settle(rare.join(most.select("token", F.col("m.root").alias("top")), "token").where("root <> top").select("top", "id", "root").distinct(), "strays")
    members = settle(rare.select("id", "root").distinct().join(strays.select(F.col("top").alias("root")).distinct(), "root", "left_semi")
                     .select(F.col("root").alias("top"), "id", "root"), "members")
    everyone = strays.unionByName(members)
    blocks = strays.groupBy("top").agg(F.count("*").alias("n_a")).join(everyone.groupBy("top").agg(F.count("*").alias("n_b")), "top").select(
        "top", *[F.ceil(F.col(f"n_{k}") / BLOCK).cast("int").alias(f"n_{k}") for k in "ab"])

    def placed(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
        """Each row in its own block, with every block of the other side."""
        at = rows.join(blocks, "top").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        return at.select(F.xxhash64("top", "a", "b").alias("unit"), F.lit(side).alias("side"), "id", F.xxhash64("root").alias("kind"))

    rows = placed(strays, 0, "a", "b").unionByName(placed(everyone, 1, "b", "a")).join(facts.select("id", "total", "most", "samples"), "id")
    rows = rows.repartition("unit").sortWithinPartitions("unit").select("unit", "side", "kind", "total", "most", "samples", "id")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            if not len(table):
                return
            unit, side, kind, total, most = (table.column(c).to_numpy() for c in ("unit", "side", "kind", "total", "most"))
            drawn = table.column("samples").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            ids = table.column("id").combine_chunks()
            for a, b in _screening(unit, side, kind, total, most, drawn, threshold, least):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(unit[a])], ["a", "b", "unit"])

        held = None      # the rows of the last unit so far
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            unit = held.column("unit").to_numpy()
            whole = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0       # ascending
            yield from pairs(held.slice(0, whole))
            held = held.slice(whole)
        if held is not None:
            yield from pairs(held)

    kind = facts.schema["id"].dataType.simpleString()
    return rows.mapInArrow(meet, f"a {kind}, b {kind}, unit long")


def _judged(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float, width: int) -> DataFrame:
    """(a, b, sure) of ``pairs(a, b, unit)``, see :func:`decided`; -1 is open. A text goes once to each unit, however many pairs it has there."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    kind = texts.schema["id"].dataType.simpleString()
    none = F.lit(None)
    bodies = pairs.select("unit", F.explode(F.array("a", "b")).alias("a")).distinct().join(texts.withColumnRenamed("id", "a"), "a")
    rows = bodies.select("unit", F.lit(0).alias("side"), "a", none.cast(kind).alias("b"), "text").unionByName(
        pairs.select("unit", F.lit(1).alias("side"), "a", "b", none.cast("string").alias("text")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh, shingle = sent.value, Shingler(width)
        unit, held = None, {}
        for batch in batches:
            at, told = [], []
            sides, units = batch.column("side").to_pylist(), batch.column("unit").to_pylist()
            a, b = ([None if d is None else tuple(d.values()) for d in batch.column(c).to_pylist()] for c in "ab")
            for i, (u, side) in enumerate(zip(units, sides)):
                if u != unit:
                    unit, held = u, {}
                if side == 0:       # a unit's texts come before its pairs
                    held[a[i]] = shingle(batch.column("text")[i].as_py())
                else:
                    sure = decided(weigh, held[a[i]], held[b[i]], threshold)
                    at.append(i)
                    told.append(-1 if sure is None else int(sure))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take), pa.array(told, pa.int32())], ["a", "b", "sure"])

    # By number: a pair is few bytes and much work, so partitions that are small are not joined.
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "unit").sortWithinPartitions("unit", "side").mapInArrow(judge, f"a {kind}, b {kind}, sure int")


def _exact(open_: DataFrame, texts: DataFrame, sets: DataFrame, n: int, threshold: float, width: int, bits: int = 27) -> DataFrame:
    """The pairs ``open_(a, b)`` that are similar enough under the exact document frequencies of their shingles among all ``sets(tokens)``.

    Only shingles of these pairs are counted: others are left out before the shuffle by a table of ``2 ** bits`` bits, which loses none.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            for i in range(len(batch)):
                found, counts = shingle(batch.column("text")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.full(len(found), i))), pa.array(found.view(np.int64)), pa.array(counts)],
                                                 ["id", "token", "count"])

    ids = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parts = settle(texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(emit, f"id {kind}, token long, count long"), "shingles")
    asked = settle(parts.select("token").distinct(), "asked")
    size = 1 << (bits - 15)
    slots = asked.select(F.pmod("token", F.lit(size)).cast("int").alias("slot"), F.pmod(F.shiftright("token", 24), F.lit(BITMAP)).alias("bit"))
    table = np.zeros((size, BITMAP // 8), np.uint8)
    for row in settle(slots.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits")), "bits").toLocalIterator():      # at most ``size`` rows of 4 KiB
        table[row["slot"]] = np.frombuffer(row["bits"], np.uint8)
    sent = sets.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            t = _unpacked(batch.column(0), np.int64)[0]
            bit = (t >> 24) % BITMAP
            tokens, many = np.unique(t[(wanted[t % size, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1], return_counts=True)
            yield pa.record_batch({"token": pa.array(tokens), "n": pa.array(many, pa.int64())})

    seen = sets.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).join(asked, "token", "left_semi")
    weight = F.col("count") * (F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1)
    weighed = parts.join(seen, "token").select("id", "token", weight.alias("w")).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("token", "w"))).alias("all"))      # a document's own shingles
    weighed = settle(weighed.select("id", F.col("all.token").alias("t"), F.col("all.w").alias("w")), "weighed")
    sent.destroy()

    @F.pandas_udf("boolean")
    def similar(ta: pd.Series, wa: pd.Series, tb: pd.Series, wb: pd.Series) -> pd.Series:
        return pd.Series([_similarity(*(np.asarray(x) for x in row)) >= threshold - 1e-12 for row in zip(ta, wa, tb, wb)], dtype=bool)

    one, two = (weighed.select(F.col("id").alias(k), F.col("t").alias(f"t{k}"), F.col("w").alias(f"w{k}")) for k in "ab")
    return open_.join(one, "a").join(two, "b").where(similar("ta", "wa", "tb", "wb")).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame, weights: Weights, n: int, threshold: float, width: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough; ``texts(id, text)``, and ``sets(tokens)`` of all ``n`` documents with shingles. Pairs with a ``unit`` are
    verified there."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("int")
    def verdict(left: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weigh, shingle = sent.value, Shingler(width)
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}       # texts of a class meet the same others again and again
        size = 0

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal size
            if text not in known:
                found = shingle(text)
                size += len(found[0])
                if size > HELD:
                    known.clear()
                    size = len(found[0])
                known[text] = found
            return known[text]

        for a, b in left:
            out = []
            for x, y in zip(a, b):
                sure = decided(weigh, of(x), of(y), threshold)
                out.append(-1 if sure is None else int(sure))
            yield pd.Series(out, dtype="int32")

    if "unit" in pairs.columns:
        told = _judged(pairs, texts, weights, threshold, width)
    else:
        one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        told = pairs.join(one, "a").join(two, "b").select("a", "b", verdict("ta", "tb").alias("sure"))
    told = settle(told.where("sure <> 0"), "told")
    sent.destroy()
    open_ = told.where("sure < 0").select("a", "b")
    sure = told.where("sure > 0").select("a", "b")
    return sure if open_.isEmpty() else sure.unionByName(_exact(open_, texts, sets, n, threshold, width))


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, bands: int = 16, rows: int = 3,
    bits: int = 20, screen: float = 0.5, rounds: int = 3,
) -> DataFrame:
    """(doc, sig, class_id, n_links, first): each document's class, named by the class's smallest id.

    ``n_links`` counts verified links of the document's text to other texts (found links suffice to connect a class; not every pair of a class is
    compared). ``first`` marks the one document of each class to keep. ``sig`` is the 64-bit hash of the text.
    """
    bound_batches(docs.sparkSession)
    samples = bands * rows
    named = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("sig"), F.col(text).alias("text"))
    sets = settle(shingled(named, "text", width), "sets")       # every pass over all documents reads these
    n_docs, seen = feature_counts(sets, bits)
    weights = Weights(n_docs, seen)
    drawn = settle(signatures(sets, weights, samples), "samples")
    # Equal texts (equal hash, weight and samples) are one; the smallest id stands for them.
    same = ["sig", "total", "samples"]
    texts = settle(drawn.where("samples is not null").groupBy(*same).agg(F.min("doc").alias("id"), F.min("most").alias("most")), "texts").withColumn("id", F.struct("id", "sig"))

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(
        i.alias("band"), F.xxhash64(F.slice("samples", i * rows + 1, F.lit(rows))).alias("h")))
    slots = texts.select("id", F.explode(keys).alias("slot"))
    crowded = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    slots = settle(slots.join(crowded, "slot"), "slots")
    met = slots.groupBy("id").agg(F.sum("n").alias("met"))
    facts = texts.join(met, "id").select("id", "total", "most", "samples", "met")
    facts = settle(facts, "facts")
    ids = facts.select(F.col("id.id").alias("doc"), F.col("id.sig").alias("sig"))
    wanted = ids.select(F.col("doc").alias("d"), F.col("sig").alias("s"))
    bodies = settle(named.join(wanted, named["doc"].eqNullSafe(wanted["d"]) & (named["sig"] == wanted["s"]), "left_semi")
                    .dropDuplicates(["doc", "sig"]).select(F.struct(F.col("doc").alias("id"), "sig").alias("id"), "text"), "bodies")

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs whose weights and samples leave the threshold possible."""
        f = pairs.join(facts.select(F.col("id").alias("a"), F.col("total").alias("wa"), F.col("most").alias("ma"), F.col("samples").alias("sa")), "a").join(
            facts.select(F.col("id").alias("b"), F.col("total").alias("wb"), F.col("most").alias("mb"), F.col("samples").alias("sb")), "b")
        agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return f.where((F.col("ma") >= threshold * F.col("wb") * 0.9999) & (F.col("mb") >= threshold * F.col("wa") * 0.9999) & (agree >= int(screen * samples))).select("a", "b")

    links = None
    tried = None
    slots = settle(slots.join(facts.select("id", "met"), "id").select("id", "slot", "met"), "slots")
    label = facts.select("id", F.col("id").alias("root"))
    for n in range(rounds + 1):
        placed = slots.join(label, "id") if n else slots.withColumn("root", F.col("id"))
        if n < rounds:
            # First the document that most others meet leads, which for a text and its copies is the text; then others by chance.
            chance = F.xxhash64(F.lit(n), "id", "slot")
            rank = F.struct((F.when(F.lit(n == 0), -F.col("met")).otherwise(chance)).alias("r"), F.col("id").alias("b"), F.col("root").alias("lead"))
            lead = placed.groupBy("slot").agg(F.min(rank).alias("l"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
            pairs = placed.join(lead.select("slot", "l.b", "l.lead"), "slot").where("root <> lead").select(F.col("id").alias("a"), "b")
        else:
            mixed = placed.groupBy("slot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("slot")
            rest = placed.join(mixed, "slot", "left_semi").select("id", "root").distinct()
            rare = settle(_rare_shingles(bodies.join(rest, "id"), weights, threshold, width), "rare")
            pairs = _near(rare, facts, threshold, int(screen * samples))
        named_by = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        pairs = pairs.select(*named_by).distinct() if n < rounds else pairs.select(*named_by, "unit").groupBy("a", "b").agg(F.min("unit").alias("unit"))
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(screened(pairs) if n < rounds else pairs, "pairs")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        if pairs.isEmpty():
            if n < rounds:
                continue
            break
        new = settle(_verified(pairs, bodies, sets, weights, n_docs, threshold, width), "links")
        if new.isEmpty():       # the classes stay
            continue
        links = new if links is None else links.unionByName(new)
        roots = components(links)
        label = settle(facts.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "roots")
    if links is None:
        of = label.select(F.col("id").alias("k"), "root", F.lit(0).cast("long").alias("n_links"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("n_links"))
        of = label.join(degree, label["id"] == degree["k"], "left").select(F.col("id").alias("k"), "root", "n_links")
    alone = F.struct(F.col("doc").alias("id"), "sig")
    by_text = texts.join(of, texts["id"] == of["k"], "left").select(
        *same, F.coalesce("root", "id").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    with_words = drawn.where("samples is not null").join(by_text, same).select("doc", "sig", "root", "n_links")
    wordless = drawn.where("samples is null").select("doc", "sig", alone.alias("root"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(wordless).select(
        "doc", "sig", F.col("root.id").alias("class_id"), "n_links", alone.eqNullSafe(F.col("root")).alias("first"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each class; columns as before."""
    first = classes(docs, doc_id, text, **how).where("first").select(F.col("doc").alias("d"), F.col("sig").alias("s"))
    rows = packed(docs, doc=F.col(doc_id), sig=F.xxhash64(text))
    kept = rows.join(first, rows["doc"].eqNullSafe(first["d"]) & (rows["sig"] == first["s"]), "left_semi")
    return kept.dropDuplicates(["doc", "sig"]).select(*unpacked(docs))
