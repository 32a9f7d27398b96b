"""Substring dedup over words by suffix automata of reference shards.

A shard is a bounded set of reference passages compiled into a suffix automaton whose states know the smallest document that holds
their strings. Documents are streamed through it for matching statistics: wherever the longest match is ``window`` words or more,
the window that ends there occurs in the reference, and the state tells in which smallest document. Windows whose document is smaller
than the reader's go; together they make the maximal spans removed.

The reference is the corpus itself, so its automata have no size bound and are not sent everywhere: passages that can match have the same anchor (``passages``),
anchors deal reference and documents to shards, and each shard's automaton is built in the task that streams the documents for it. Equal passages are streamed once for all
their places. A shard holds about ``SHARD`` bytes of passages; an anchor with more than ``group_words`` words of
distinct passages is decided by an aggregation of hashed windows (128 bits) instead, so no task holds a group of unbounded size.

A document's id decides what is earlier, null last; windows that are repeated only inside one document, or under one id, stay. Defined cases: null and empty texts
have no words. Windows are judged on the input. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from .automaton import SuffixAutomaton
from .passages import Scheme, collapsed, cut, fetched, in_groups, merged, occurrences
from .weighted_minhash import Shingler

SHARD = 1 << 18


def _word_hashes():
    words = Shingler().words
    return lambda text: words(text or "", exact=xxhash.xxh3_64_intdigest)


def scheme(window: int) -> Scheme:
    return Scheme(lambda s: (s or "").encode("utf-8", "replace").split(), _word_hashes, b" ".join, lambda raw: raw.split(b" "), gram=max(1, (window - 1) // 2 - 1), window=window)


def repeated(docs: DataFrame, window: int = 13, group_words: int = 100_000) -> DataFrame:
    """(doc, sig, spans): word ranges of ``docs(doc, sig, value)`` whose windows occur in a document with a smaller id."""
    plan = scheme(window)
    found = occurrences(docs, plan)
    distinct, groups = collapsed(found)
    bodies, singles = fetched(docs, distinct, groups, plan, group_words, step=3)
    kind = dict(docs.dtypes)["doc"]
    part = f"array<struct<lo:int,hi:int,last:boolean,id:{kind}>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in in_groups(batches, SHARD):
            shard, rows = SuffixAutomaton(), [(r, r["units"].split(b" ")) for g in held for r in g]
            for r, words in rows:
                shard.add(words, (r["doc"] is None, r["doc"]))
            shard.finish()
            out = []
            for r, words in rows:
                ranges: list[dict] = []
                for at, (length, state) in enumerate(shard.statistics(words), 1 - window):
                    if length < window:
                        continue
                    last, doc = shard.least_of(state, window)
                    lo = at + r["lo"]
                    if ranges and ranges[-1]["hi"] == lo and ranges[-1]["id"] == doc and ranges[-1]["last"] == last:
                        ranges[-1]["hi"] = lo + 1
                    else:
                        ranges.append({"lo": lo, "hi": lo + 1, "last": last, "id": doc})
                out.append({"anchor": r["anchor"], "body": r["body"], "windows": ranges})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    ids = to_arrow_type(docs.schema["doc"].dataType)
    windows = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("last", pa.bool_()), ("id", ids)]))
    schema = pa.schema([("anchor", pa.int64()), ("body", pa.int64()), ("windows", windows)])
    judged = bodies.repartition("grp").sortWithinPartitions("grp").mapInArrow(task, f"anchor long, body long, windows {part}")
    if singles is not None:     # windows that a smaller document than the passage's first holds
        own = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("id"))
        least = singles.groupBy("key").agg(F.min(own).alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
        found_in = F.array(F.struct("lo", (F.col("lo") + 1).alias("hi"), "least.last", "least.id"))
        judged = judged.unionByName(singles.join(least, "key").where(F.col("least") < own).select("anchor", "body", found_in.cast(part).alias("windows")))
    judged = settle(judged.groupBy("anchor", "body").agg(F.flatten(F.collect_list("windows")).alias("windows")), "judged")     # parts of one passage
    verdict = distinct.join(groups.select("anchor", "mixed"), "anchor").join(judged, ["anchor", "body"], "left").where("copies > 1 or mixed").select(
        "anchor", "body", "first", "windows")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"), F.col("first.last").alias("last"), F.col("first.doc").alias("id")))
    # Single windows are only told where they stand in a smaller document than the passage does.
    told = F.coalesce("windows", whole) if singles is None else F.concat(F.coalesce("windows", F.array().cast(part)), whole)
    own = F.struct(F.col("doc").isNull().alias("last"), F.col("doc").alias("id"))
    hit = found.join(verdict, ["anchor", "body"]).select("doc", "sig", "start", F.explode(told).alias("w")).where(
        F.struct(F.col("w.last").alias("last"), F.col("w.id").alias("id")) < own)
    span = F.struct((F.col("start") + F.col("w.lo")).alias("lo"), (F.col("start") + F.col("w.hi") + (window - 1)).alias("hi"))
    return hit.groupBy("doc", "sig").agg(F.array_sort(F.collect_set(span)).alias("spans"))       # a document's own spans


def dedup(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (of its ``columns``, or all) as ``row`` with ``n_words``, ``removed`` (maximal word ranges) and ``kept``.

    ``kept`` is the text of the remaining words, joined by single spaces.
    """
    named = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("sig"), F.col(text).alias("value"))
    both = cut(docs, repeated(named, window), columns, doc_id, text)
    split = scheme(window).split

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            size, removed, kept = [], [], []
            for v, s in zip(batch.column("value"), batch.column("spans")):
                words, gone = split(v.as_py()), merged(s.as_py())
                edges = [0, *[x for r in gone for x in r], len(words)]
                size.append(len(words))
                removed.append([{"lo": a, "hi": b} for a, b in gone])
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(size, pa.int64()), pa.array(removed, span), pa.array(kept, pa.string())], ["row", "n_words", "removed", "kept"])

    return both.mapInArrow(task, f"row {both.schema['row'].dataType.simpleString()}, n_words long, removed array<struct<lo:int,hi:int>>, kept string")
