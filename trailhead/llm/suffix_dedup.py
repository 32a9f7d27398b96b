"""Substring dedup over bytes by longest-previous-factor arrays.

For every position the longest-previous-factor array tells how long a string that begins there also begins earlier. In suffix order the best
earlier partner is the nearest neighbour with a smaller position on either side; the mirrored array (larger positions) gives later partners. A byte goes if a string of ``length`` bytes that covers it also
begins earlier (``keep="first"``: copies go, the first stays) or anywhere else (``keep="none"``).

Positions whose string can have a partner are found by anchors (``passages``): suffix arrays are built over the distinct passages of a
bounded number of anchors at a time, in as many tasks as there are partitions, never over a whole corpus. Equal passages are one text with several places. An anchor
with over ``group_bytes`` of different passages is decided by counting hashed windows (128 bits), so no task holds a group of unbounded size.

Places are ordered by (document id, null last; hash of the text; position). Defined cases: null is the empty text. Equal rows are different
documents that copy each other (with ``keep="first"`` they share a place and are treated alike). Matches never cross documents. Strings are judged on the input. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .passages import Scheme, collapsed, cut, fetched, in_groups, merged, occurrences, place

BATCH = 1 << 19         # bytes of passages that one suffix array covers, unless one group has more


def _byte_hashes():
    table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return lambda text: table[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def scheme(length: int) -> Scheme:
    return Scheme(lambda s: (s or "").encode("utf-8", "replace"), _byte_hashes, bytes, bytes, gram=max(2, length // 6), window=length)


def _ranks(raw: np.ndarray, limit: int) -> dict[int, np.ndarray]:
    """Rank of the string of 8, 24, 72, … bytes (8, 16, 32, … of a long text) at each position; beyond the end counts as lowest."""
    n = len(raw)
    padded = np.concatenate([raw.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):      # seven bytes with nine bits each hold the end mark as well
        key = key << np.uint64(9) | padded[k:k + n]
    first = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = first * 257 + padded[7:7 + n].astype(np.int64)
    out = {8: np.unique(key, return_inverse=True)[1].astype(np.int32)}
    size, fold = 8, 3 if n < (1 << 21) - 1 else 2       # three ranks fit a 64-bit key of a short text
    while size < limit:
        rank = out[size].astype(np.int64)
        key = rank
        for k in range(1, fold):
            behind = np.zeros(n, np.int64)
            if n > k * size:
                behind[:n - k * size] = rank[k * size:] + 1
            key = key * (n + 2) + behind
        size *= fold
        out[size] = np.unique(key, return_inverse=True)[1].astype(np.int32)
    return out


def nearest_smaller(a: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element that is smaller, or -1; pointers jump over those known to be larger."""
    p = np.arange(len(a)) - 1
    open_ = np.flatnonzero((p >= 0) & (a[p] > a))
    while len(open_):
        p[open_] = p[p[open_]]
        q = p[open_]
        open_ = open_[(q >= 0) & (a[q] > a[open_])]
    return p


def _common(ranks: dict[int, np.ndarray], raw: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at i and j, up to about ``most``."""
    n, got = len(raw), np.zeros(len(i), np.int64)
    for size in sorted([*ranks, *ranks], reverse=True):      # each at most twice
        a, b = i + got, j + got
        inside = (np.maximum(a, b) + size <= n) & (got < most)
        same = np.zeros(len(i), bool)
        same[inside] = ranks[size][a[inside]] == ranks[size][b[inside]]
        got[same] += size
    for _ in range(8):
        a, b = i + got, j + got
        inside = np.maximum(a, b) < n
        same = np.zeros(len(i), bool)
        same[inside] = raw[a[inside]] == raw[b[inside]]
        done = ~same
        if done.all():
            break
        got[same] += 1
        i, j = np.where(done, n, i), np.where(done, n, j)
    return got


def factors(raw: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For positions ``starts`` (ascending): longest match with an earlier and with a later of them, exact below ``most``."""
    ranks = _ranks(raw, most)
    order = starts[np.argsort(ranks[max(ranks)][starts], kind="stable")]      # the suffix array of the starts
    out = []
    for sign in (1, -1):
        key = order * sign
        before = nearest_smaller(key)
        behind = len(order) - 1 - nearest_smaller(key[::-1])[::-1]
        best = np.zeros(len(order), np.int64)
        for p in (before, behind):
            has = np.flatnonzero((p >= 0) & (p < len(order)))
            best[has] = np.maximum(best[has], _common(ranks, raw, order[has], order[p[has]], most))
        back = np.empty(len(order), np.int64)
        back[np.searchsorted(starts, order)] = best
        out.append(back)
    return out[0], out[1]


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _judged_windows(windows: DataFrame, span: str) -> DataFrame:
    """(anchor, body, earlier, other) of passages from their single ``windows(key, anchor, body, doc, sig, start, lo)``."""
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "sig", (F.col("start") + F.col("lo")).alias("at"))
    equal = windows.groupBy("key").agg(F.min(at).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    met = windows.join(equal, "key").select("anchor", "body", "lo", (F.col("least") < at).alias("before"))

    @F.pandas_udf(span)
    def ranges(lists: pd.Series) -> pd.Series:
        def runs(at: np.ndarray) -> list[dict]:
            at = np.sort(np.asarray(at, np.int64))
            cut = np.flatnonzero(np.diff(at) != 1) + 1
            return [{"lo": int(p[0]), "hi": int(p[-1]) + 1} for p in np.split(at, cut) if len(p)]

        return lists.map(runs)

    lists = met.groupBy("anchor", "body").agg(      # a passage's own windows
        F.collect_list(F.when(F.col("before"), F.col("lo"))).alias("earlier"), F.collect_list("lo").alias("other"))
    return lists.select("anchor", "body", ranges("earlier").alias("earlier"), ranges("other").alias("other"))


def repeated(docs: DataFrame, length: int = 200, keep: str = "first", group_bytes: int = 4 << 20) -> DataFrame:
    """(doc, sig, spans): byte ranges (from, to) of ``docs(doc, sig, value)`` to remove, for documents that lose any."""
    plan = scheme(length)
    found = occurrences(docs, plan)
    distinct, groups = collapsed(found)
    bodies, windows = fetched(docs, distinct, groups, plan, group_bytes, step=8)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in in_groups(batches, BATCH):
            rows = [r for g in held for r in sorted(g, key=lambda r: (r["doc"] is None, r["doc"], r["sig"], r["start"] + r["lo"]))]
            sizes = np.array([len(r["units"]) for r in rows])
            ends = np.cumsum(sizes)
            raw = np.frombuffer(b"".join(r["units"] for r in rows), np.uint8)
            valid = np.zeros(len(raw), bool)
            for e, s in zip(ends.tolist(), sizes.tolist()):
                valid[e - s:e - length + 1] = True
            starts = np.flatnonzero(valid)
            earlier, later = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
            a, b = factors(raw, starts, length)
            earlier[starts], later[starts] = a >= length, b >= length
            anchor, body, before, other = [], [], [], []
            for r, e, s in zip(rows, ends.tolist(), sizes.tolist()):
                x, y = earlier[e - s:e - length + 1], earlier[e - s:e - length + 1] | later[e - s:e - length + 1]
                anchor.append(r["anchor"])
                body.append(r["body"])
                before.append([{"lo": p + r["lo"], "hi": q + r["lo"]} for p, q in _stretches(x)])
                other.append([{"lo": p + r["lo"], "hi": q + r["lo"]} for p, q in _stretches(y)])
            span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.record_batch({"anchor": pa.array(anchor, pa.int64()), "body": pa.array(body, pa.int64()), "earlier": pa.array(before, span), "other": pa.array(other, span)})

    span = "array<struct<lo:int,hi:int>>"
    judged = bodies.repartition("grp").sortWithinPartitions("grp").mapInArrow(task, f"anchor long, body long, earlier {span}, other {span}")
    if windows is not None:
        judged = judged.unionByName(_judged_windows(windows, span))
    judged = judged.where("size(earlier) + size(other) > 0").groupBy("anchor", "body").agg(
        F.flatten(F.collect_list("earlier")).alias("earlier"), F.flatten(F.collect_list("other")).alias("other"))     # parts of one passage
    verdict = distinct.join(settle(judged, "judged"), ["anchor", "body"], "left").where("copies > 1 or earlier is not null")
    none = F.array().cast(span)
    all_ = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    if keep == "first":
        windows = F.when(place() == F.col("first"), F.coalesce("earlier", none)).otherwise(all_)
    else:
        windows = F.when(F.col("copies") > 1, all_).otherwise(F.coalesce("other", none))
    spans = found.join(verdict, ["anchor", "body"]).select("doc", "sig", F.explode(F.transform(windows, lambda w: F.struct(
        (F.col("start") + w["lo"]).alias("lo"), (F.col("start") + w["hi"] + (length - 1)).alias("hi")))).alias("w"))
    return spans.groupBy("doc", "sig").agg(F.array_sort(F.collect_set("w")).alias("spans"))       # a document's own spans


def dedup(docs: DataFrame, length: int = 200, keep: str = "first", doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (of its ``columns``, or all) as ``row`` with ``n_bytes``, ``removed`` (maximal byte ranges) and ``kept`` (remaining bytes)."""
    named = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("sig"), F.col(text).alias("value"))
    both = cut(docs, repeated(named, length, keep), columns, doc_id, text)
    split = scheme(length).split

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            size, removed, kept = [], [], []
            for v, s in zip(batch.column("value"), batch.column("spans")):
                raw, gone = split(v.as_py()), merged(s.as_py())
                edges = [0, *[x for r in gone for x in r], len(raw)]
                size.append(len(raw))
                removed.append([{"lo": a, "hi": b} for a, b in gone])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["row", "n_bytes", "removed", "kept"])

    return both.mapInArrow(task, f"row {both.schema['row'].dataType.simpleString()}, n_bytes long, removed array<struct<lo:int,hi:int>>, kept binary")
