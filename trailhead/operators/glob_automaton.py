"""All globs of a key as one automaton that paths are streamed through.

A glob is a row of positions: a plain character, any character, or a star that stays where it is. The positions of all globs of a key lie in one
bitset, and reading a character moves all of them at once. Sets that were met before, and where each character led from them, are
remembered, so nearly all steps are one look-up: the work on a path depends on its length and its matches, not on the number of globs.
What is remembered is bounded and starts anew when it is full.

Bracket expressions count as any character here; matches of globs that have one are checked again (see :func:`matches`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import globs
from ..session import settle
from .skew import fits, salted_join

MAX_STATES = 20_000             # remembered sets of positions, an automaton
MAX_POSITIONS = 100_000         # of one automaton; a key with more is cut into shards
MAX_BROADCAST_GLOBS = 20_000    # globs that may be sent to all tasks
MAX_BROADCAST_CHARS = 2 << 20   # and their characters
PIECE_PATHS = 200_000           # paths of one key in one piece

_BRACKET = re.compile(r"\[[!^]?\]?[^\]]*\]", re.S)


class GlobSet:
    """An automaton over ``patterns``; :meth:`find` gives the numbers of those that match a path as a whole."""

    def __init__(self, patterns: list[str]):
        self.any = self.stars = self.ends = start = 0
        self.plain: dict[str, int] = {}
        self.owner: dict[int, int] = {}
        at = 0
        for number, glob in enumerate(patterns):
            start |= 1 << at
            i, last = 0, ""
            while i < len(glob):
                c = glob[i]
                closed = _BRACKET.match(glob, i) if c == "[" else None
                i = closed.end() if closed else i + 1
                if c == "*" and not closed:
                    if last == "*":
                        continue
                    self.stars |= 1 << at
                elif c == "?" or closed:
                    self.any |= 1 << at
                else:
                    self.plain[c] = self.plain.get(c, 0) | 1 << at
                last = "" if closed else c
                at += 1
            self.ends |= 1 << at
            self.owner[at] = number
            at += 1
        self.start = self._closed(start)
        self._forget()

    def _closed(self, places: int) -> int:
        # A star may stand for nothing; two stars never follow each other.
        return places | (places & self.stars) << 1

    def _forget(self) -> None:
        self.number: dict[int, int] = {self.start: 0}
        self.places, self.steps, self.found = [self.start], [{}], [None]

    def _step(self, state: int, c: str) -> int:
        places = self.places[state]
        moved = self._closed((places & (self.plain.get(c, 0) | self.any)) << 1 | places & self.stars)
        follower = self.number.get(moved)
        if follower is None:
            if len(self.places) >= MAX_STATES:
                self._forget()
                self.number[moved] = follower = 1 if moved != self.start else 0
                if follower:
                    self.places.append(moved), self.steps.append({}), self.found.append(None)
                return follower
            self.number[moved] = follower = len(self.places)
            self.places.append(moved), self.steps.append({}), self.found.append(None)
        self.steps[state][c] = follower
        return follower

    def find(self, path: str) -> list[int]:
        state = 0
        for c in path:
            follower = self.steps[state].get(c)
            state = self._step(state, c) if follower is None else follower
        known = self.found[state]
        if known is None:
            left, known = self.places[state] & self.ends, []
            while left:
                low = left & -left
                known.append(self.owner[low.bit_length() - 1])
                left ^= low
            self.found[state] = known
        return known


def _key(by: list[str]) -> Column:
    return F.to_json(F.struct(*by))


def _streamed(targets: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, path, glob) of (key, path) and (key, glob): the globs of a key come first in its task, then its paths, one by one."""
    size = F.ceil(F.sum(F.length("glob") + 1) / MAX_POSITIONS).cast("int")
    shards = patterns.groupBy("key").agg(size.alias("shards"))
    pieces = targets.groupBy("key").agg(F.ceil(F.count("*") / PIECE_PATHS).cast("int").alias("pieces"))
    plan = shards.join(pieces, "key")

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def hashed(column: str, n: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(n)).cast("int")

    rules = patterns.join(plan, "key").select("key", hashed("glob", "shards").alias("shard"), upto("pieces").alias("piece"), F.lit(0).alias("is_path"), F.col("glob").alias("text"))
    paths = targets.join(plan, "key").select("key", upto("shards").alias("shard"), hashed("path", "pieces").alias("piece"), F.lit(1).alias("is_path"), F.col("path").alias("text"))
    place = ["key", "shard", "piece"]
    rows = rules.unionByName(paths).repartition(*place).sortWithinPartitions(*place, "is_path")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, patterns, automaton = None, [], None
        for batch in batches:
            out: list[tuple[str, str, str]] = []
            for key, shard, piece, is_path, text in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if (key, shard, piece) != current:
                    current, patterns, automaton = (key, shard, piece), [], None
                if not is_path:
                    patterns.append(text)
                    continue
                automaton = automaton or GlobSet(patterns)
                out += [(key, text, patterns[i]) for i in automaton.find(text)]
            columns = [pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays(columns, ["key", "path", "glob"])

    return rows.mapInArrow(task, "key string, path string, glob string")


def _looked_up(key: Column, path: Column, patterns: dict[str, list[str]]) -> Column:
    """array<string>: the globs of ``patterns[key]`` that match, found without moving the paths."""
    made: dict[str, GlobSet] = {}

    @F.pandas_udf("array<string>")
    def find(keys: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for k, p in zip(keys, paths):
            mine = patterns.get(k)
            if not mine or p is None:
                out.append(None)
                continue
            if k not in made:
                if len(made) > 1000:
                    made.clear()
                made[k] = GlobSet(mine)
            out.append([mine[i] for i in made[k].find(p)])
        return pd.Series(out, dtype=object)

    return find(key, path)


def matches(targets: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of ``targets`` (by…, path) and wildcard ``rules`` (by…, glob, …) whose glob matches the path.

    A few globs are sent to the paths; beyond ``MAX_BROADCAST_GLOBS`` both meet by key, cut into shards and pieces of bounded size.
    """
    rules = settle(rules.dropna(subset=[*by, "glob"]).withColumn("key", _key(by)), "rules")
    patterns = settle(rules.select("key", "glob").distinct(), "globs")
    keyed = targets.withColumn("key", _key(by))
    if fits(patterns, MAX_BROADCAST_GLOBS) and (patterns.agg(F.sum(F.length("glob"))).first()[0] or 0) <= MAX_BROADCAST_CHARS:
        held: dict[str, list[str]] = {}
        for r in patterns.collect():
            held.setdefault(r.key, []).append(r.glob)
        found = keyed.withColumn("glob", F.explode(_looked_up(F.col("key"), F.col("path"), held)))
    else:
        hits = _streamed(keyed.where("path is not null").select("key", "path").distinct(), patterns)
        found = keyed.join(hits, ["key", "path"])
    # Brackets were read as any character.
    found = found.where(~F.contains("glob", F.lit("[")) | globs.glob_match("path", "glob"))
    carried = rules.drop(*by)
    pairs = found.join(F.broadcast(carried), ["key", "glob"]) if fits(carried, MAX_BROADCAST_GLOBS) else salted_join(found, carried, ["key", "glob"], ["path"])
    return pairs.drop("key")
