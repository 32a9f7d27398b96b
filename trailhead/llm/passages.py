"""Where long equal strings can begin: content-chosen anchors, and the passages around those that occur more than once.

A document is a sequence of units (bytes or words). Of all runs of ``gram`` units inside a window of ``window`` units the one with the smallest hash
is the window's anchor (the leftmost, of equal ones). Equal windows have equal anchors at the same place, wherever they stand; so windows whose anchor occurs once
have no equal. The windows that share one anchor occurrence are neighbours; the units they cover are its passage.

First anchors are counted over all documents. Repeated ones go into a bit table of a fixed size that is sent to the tasks (full, it lets too much
through, never too little). A second pass lists the occurrences of repeated anchors; equal passages are then collapsed before anything is
compared, so a group of copies costs as much as one of them. Only anchors whose passages differ need a look inside: their distinct passages are fetched, once each.
An anchor with very many of them is decided window by window, by an aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import BITMAP, maybe_in, packed

ODD = 0x9E3779B97F4A7C15
SPAN = 1 << 23      # units of a document that are looked at together


@dataclass(frozen=True)
class Scheme:
    """Units of a text and their hashes; ``gram`` units make an anchor, ``window`` units the strings in question."""

    split: Callable[[str | None], object]               # text → bytes, or list of words
    hashes: Callable[[], Callable[[str | None], np.ndarray]]   # makes a function from a text to its units' 64-bit hashes
    join: Callable[[object], bytes]                     # a slice of units → bytes
    parts: Callable[[bytes], object]                    # and back
    gram: int
    window: int


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` units, by doubling."""
    with np.errstate(over="ignore"):
        power, run, length, out, done, base = h, 1, size, None, 0, np.uint64(ODD)
        while length:
            if length & 1:      # append a run of this power behind what there is
                if out is None:
                    out, done = power, run
                else:
                    n = len(h) - done - run + 1
                    out, done = out[:n] * base + power[done:done + n], done + run
            length >>= 1
            if length:
                n = len(power) - run
                power, run, base = power[:n] * base + power[run:run + n], 2 * run, base * base + np.uint64(2)
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def anchors(h: np.ndarray, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first window, number of windows, distance of the anchor from the first window) by anchor occurrence, in pieces of long documents."""
    last = len(h) - scheme.window + 1       # number of windows
    for at in range(0, max(last, 0), SPAN):
        part = h[at:at + SPAN + scheme.window - 1]
        grams = _grams(part, scheme.gram)
        low = np.uint64((1 << 24) - 1)
        key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, got = scheme.window - scheme.gram + 1, 1
        best = key
        while 2 * got <= width:
            best, got = np.minimum(best[:-got], best[got:]), 2 * got
        if got < width:
            best = np.minimum(best[:len(best) - (width - got)], best[width - got:])
        place = (best & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        yield grams[place[first]], first + at, count, place[first] - first


def _table(docs: DataFrame, scheme: Scheme, bitmaps: int) -> np.ndarray:
    """Bits of the anchors that occur more than once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = scheme.hashes()
        for batch in batches:
            for i in range(0, len(batch), 256):
                found = [a for v in batch.column(0)[i:i + 256] for a, _, _, _ in anchors(hashes(v.as_py()), scheme)]
                flat, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
                yield pa.record_batch({"anchor": pa.array(flat.view(np.int64)), "n": pa.array(n, pa.int64())})

    many = docs.select("value").mapInArrow(emit, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bits = many.select(F.pmod("anchor", F.lit(bitmaps)).cast("int").alias("bucket"),
                       F.pmod(F.shiftright("anchor", 24), F.lit(BITMAP)).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    table = np.zeros((bitmaps, BITMAP // 8), np.uint8)
    for row in settle(bits, "bits").toLocalIterator():      # at most ``bitmaps`` rows of 4 KiB
        table[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return table


def occurrences(docs: DataFrame, scheme: Scheme, bitmaps: int = 4096) -> DataFrame:
    """(anchor, body, doc, sig, start, n, off) of repeated anchors, ``off`` units behind ``start``, where its ``n`` windows begin.

    ``body`` is the hash of the passage. ``docs`` has (doc, sig, value). A stored table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_table(docs, scheme, bitmaps))
    kinds = dict(docs.dtypes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = scheme.hashes(), sent.value
        for batch in batches:
            which, anchor, body, start, count, off = [], [], [], [], [], []
            for i, v in enumerate(batch.column("value")):
                h = hashes(v.as_py())
                for a, first, n, far in anchors(h, scheme):
                    s = a.view(np.int64)
                    bit = (s >> 24) % BITMAP
                    hit = np.flatnonzero((table[s % bitmaps, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    anchor.append(s[hit])
                    start.append(first[hit])
                    count.append(n[hit])
                    off.append(far[hit])
                    which.append(np.full(len(hit), i))
                    raw = memoryview(np.ascontiguousarray(h)).cast("B")
                    body += [xxhash.xxh3_64_intdigest(raw[8 * x:8 * (x + y + scheme.window - 1)]) for x, y in zip(first[hit].tolist(), n[hit].tolist())]
            flat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            rows = pa.array(flat(which))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat(anchor)), pa.array(np.array(body, np.uint64).view(np.int64)), batch.column("doc").take(rows), batch.column("sig").take(rows),
                 pa.array(flat(start).astype(np.int32)), pa.array(flat(count).astype(np.int32)),
                 pa.array(flat(off).astype(np.int32))], ["anchor", "body", "doc", "sig", "start", "n", "off"])

    found = docs.select("doc", "sig", "value").mapInArrow(
        emit, f"anchor long, body long, doc {kinds['doc']}, sig {kinds['sig']}, start int, n int, off int")
    return settle(found, "occurrences")


def place() -> Column:
    """Where an occurrence stands, in the order of documents."""
    return F.struct(F.col("doc").isNull().alias("last"), "doc", "sig", "start", "n", "off")


def collapsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct passages of repeated anchors, each with its first place and number, and anchors with ``mixed`` (passages differ).

    Stored tables: (anchor, body, first, copies) and (anchor, mixed, copies).
    """
    distinct = settle(found.groupBy("anchor", "body").agg(F.min(place()).alias("first"), F.count("*").alias("copies")), "passages")
    groups = distinct.groupBy("anchor").agg((F.min("body") != F.max("body")).alias("mixed"), F.sum("copies").alias("copies"))
    return distinct, settle(groups.where("copies > 1"), "groups")


def fetched(docs: DataFrame, distinct: DataFrame, groups: DataFrame, scheme: Scheme, group_units: int, step: int) -> tuple[DataFrame, DataFrame | None]:
    """The distinct passages of mixed anchors, from their first documents: those that a task may hold together, and single windows of the others.

    The first is (grp, anchor, body, doc, sig, start, lo, units), ``grp`` the anchor, for anchors with at most ``group_units`` units of distinct passages.
    The second is (key, anchor, body, doc, sig, start, lo) for anchors with more, a row a window: ``lo`` counts windows from ``start`` on, and ``key`` is the
    128-bit hash of the window, so that they are compared by aggregations and no task holds an anchor's passages. Windows without an equal in another passage
    are left out where that is plain: a passage is cut into ``step`` windows each, at places counted from the anchor, and only those count whose
    core (what all of these windows cover) occurs in another passage as well. None if no anchor has that many.
    """
    mixed = groups.where("mixed").select("anchor")
    wanted = settle(distinct.join(mixed, "anchor", "left_semi").select("anchor", "body", "first"), "mixed")
    crowded = settle(wanted.groupBy("anchor").agg(F.sum(F.col("first.n") + (scheme.window - 1)).alias("units")).where(F.col("units") > group_units).select("anchor"), "crowded")
    if crowded.isEmpty():
        return _read(docs, wanted, scheme, None), None
    hot = wanted.join(crowded, "anchor", "left_semi")
    cores = settle(_read(docs, hot, scheme, step), "cores")
    shared = settle(cores.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp"), "shared")
    likely = maybe_in(cores, F.col("grp"), shared, F.col("grp")).where("maybe").drop("maybe").join(shared, "grp", "left_semi")
    return _read(docs, wanted.join(crowded, "anchor", "left_anti"), scheme, None), settle(_windows(likely, scheme), "windows")


def _read(docs: DataFrame, wanted: DataFrame, scheme: Scheme, step: int | None) -> DataFrame:
    """(grp, anchor, body, doc, sig, start, lo, units) of passages ``wanted(anchor, body, first)``: whole under their anchor, or ``step`` windows each under their core."""
    wanted = wanted.groupBy("first.doc", "first.sig").agg(
        F.collect_list(F.struct("anchor", "body", "first.start", "first.n", "first.off")).alias("parts"))      # a document's own passages
    wanted = settle(wanted.select(F.col("doc").alias("d"), F.col("sig").alias("s"), "parts"), "wanted")
    near = maybe_in(docs, F.col("sig"), wanted, F.col("s")).where("maybe").dropDuplicates(["doc", "sig"])
    joined = near.join(wanted, near["doc"].eqNullSafe(wanted["d"]) & (near["sig"] == wanted["s"])).select("doc", "sig", "value", "parts")
    kinds = dict(docs.dtypes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["grp", "anchor", "body", "lo", "row", "start", "units"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            for i in range(len(batch)):
                units, rows = scheme.split(batch.column("value")[i].as_py()), []
                for p in batch.column("parts")[i].as_py():
                    whole = [(0, p["n"], p["anchor"])]
                    if step:
                        whole = []
                        for at in range(-(p["off"] // step) * step - step, p["n"] - p["off"], step):      # windows at..at+step-1 from the anchor on
                            lo, hi = max(0, at + p["off"]), min(p["n"], at + p["off"] + step)
                            if lo < hi:     # the core is what all step windows cover; any of them holds it
                                core = p["start"] + p["off"] + at
                                core = scheme.join(units[core + step - 1:core + scheme.window])
                                whole.append((lo, hi - lo, xxhash.xxh3_64_intdigest(core, seed=(p["anchor"] + at) % (1 << 64)) - (1 << 63)))
                    for lo, n, grp in whole:
                        a = p["start"] + lo
                        rows.append((grp, p["anchor"], p["body"], lo, i, p["start"], scheme.join(units[a:a + n + scheme.window - 1])))
                columns = {k: pa.array(c, t) for k, c, t in zip(names, zip(*rows), types)}
                at = columns.pop("row")
                yield pa.RecordBatch.from_arrays([*columns.values(), batch.column("doc").take(at), batch.column("sig").take(at)], [*columns, "doc", "sig"])

    return joined.mapInArrow(cut, f"grp long, anchor long, body long, lo int, start int, units binary, doc {kinds['doc']}, sig {kinds['sig']}")


def _windows(cores: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, anchor, body, doc, sig, start, lo) of every window of ``cores``."""
    kinds = dict(cores.dtypes)
    same = ["anchor", "body", "start", "doc", "sig"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, lo = [], [], []
            for i, (raw, first) in enumerate(zip(batch.column("units").to_pylist(), batch.column("lo").to_pylist())):
                units = scheme.parts(raw)
                n = len(units) - scheme.window + 1
                key += [xxhash.xxh3_128_digest(scheme.join(units[k:k + scheme.window])) for k in range(n)]
                row += [i] * n
                lo += range(first, first + n)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), *[batch.column(c).take(at) for c in same], pa.array(lo, pa.int32())], ["key", *same, "lo"])

    return cores.mapInArrow(cut, f"key binary, {', '.join(f'{c} {kinds[c]}' for c in same)}, lo int")


def in_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[list[dict]]]:
    """Rows that come sorted by ``grp``: lists of whole groups with at least ``limit`` bytes of units together (the last may have less)."""
    held: list[list[dict]] = []
    size, last = 0, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["grp"] != last:
                if size >= limit:
                    yield held
                    held, size = [], 0
                held.append([])
                last = row["grp"]
            held[-1].append(row)
            size += len(row["units"])
    if held:
        yield held


def cut(docs: DataFrame, spans: DataFrame, keep: list[str] | None, doc_id: str, text: str) -> DataFrame:
    """Every row as ``row`` with ``value`` and ``spans`` (ranges to remove, may overlap; null for none)."""
    rows = packed(docs, keep, doc=F.col(doc_id), sig=F.xxhash64(text), value=F.col(text))
    gone = settle(spans.select(F.col("doc").alias("d"), F.col("sig").alias("s"), "spans"), "spans")
    told = maybe_in(rows, F.col("sig"), gone, F.col("s"))
    hit = told.where("maybe").join(gone, F.col("doc").eqNullSafe(gone["d"]) & (F.col("sig") == gone["s"]), "left").select("row", "value", "spans")
    return hit.unionByName(told.where("not maybe").select("row", "value", F.lit(None).cast(gone.schema["spans"].dataType).alias("spans")))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted ranges joined where they touch."""
    out: list[list[int]] = []
    for s in spans or []:
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return [(a, b) for a, b in out]
