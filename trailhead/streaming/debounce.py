"""Debounced update queue: collect a repo's changed paths and release them together."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "repo string, path string, queued_at timestamp, trigger string"


class _Pending(StatefulProcessor):
    """State of one repo: pending path -> latest and first queue time. Never holds more than ``n`` paths.

    A path is released with its latest time, but waits since its first: queueing it again doesn't put it off.
    """

    def __init__(self, n: int, max_age: int):
        self.n, self.max_age_ms = n, max_age * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "queued_us long, first_us long")

    def _due_ms(self, pending: dict[str, tuple[int, int]]) -> int:
        return min(first for _, first in pending.values()) // 1000 + self.max_age_ms

    def _release(self, repo: str, pending: dict[str, tuple[int, int]], trigger: str) -> pd.DataFrame:
        rows = sorted(pending.items(), key=lambda kv: (kv[1][0], kv[0]))
        return pd.DataFrame([(repo, p, pd.Timestamp(us, unit="us"), trigger) for p, (us, _) in rows],
                            columns=["repo", "path", "queued_at", "trigger"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pending = {k[0]: tuple(v) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        for r in pd.concat(list(rows)).sort_values("queued_at").itertuples(index=False):
            at = r.queued_at.value // 1000
            latest, first = pending.get(r.path, (at, at))
            pending[r.path] = max(at, latest), min(at, first)
            if len(pending) >= self.n:
                yield self._release(key[0], pending, "count")
                pending = {}
        now = timerValues.getCurrentProcessingTimeInMs()
        if pending and now >= self._due_ms(pending):
            yield self._release(key[0], pending, "age")
            pending = {}
        self.pending.clear()
        for path, times in pending.items():
            self.pending.updateValue((path,), times)
        if pending:
            self.handle.registerTimer(self._due_ms(pending))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending = {k[0]: tuple(v) for k, v in self.pending.iterator()} if self.pending.exists() else {}
        if pending and timerValues.getCurrentProcessingTimeInMs() >= self._due_ms(pending):
            self.pending.clear()
            yield self._release(key[0], pending, "age")

    def close(self) -> None:
        pass


def debounce_stream(updates: DataFrame, n: int = 10, max_age: int = 300) -> DataFrame:
    """Release a repo's pending paths once ``n`` distinct ones wait or the oldest is ``max_age`` seconds old.

    ``updates`` is (repo, path, queued_at). Items that a consumer fails on are fed back as new updates.
    """
    return updates.select("repo", "path", "queued_at").groupBy("repo").transformWithStateInPandas(
        statefulProcessor=_Pending(n, max_age), outputStructType=_OUT, outputMode="Append", timeMode="ProcessingTime")


def drop_vanished(released: DataFrame, files: DataFrame) -> DataFrame:
    """Released paths that still exist."""
    return released.join(files.select("repo", "path"), ["repo", "path"], "left_semi")


def keep_latest(df: DataFrame, keys: list[str] = ("path",)) -> DataFrame:
    """One row per key: the latest ``queued_at``, of equal ones the later ``seq``."""
    rest = [c for c in df.columns if c not in keys]
    latest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("queued_at", "seq")).alias("_r"))
    return latest.select(*keys, "_r.*")


def pending_status(df: DataFrame, now, shown: int = 10) -> DataFrame:
    """Per repo: how many paths wait, the age of the oldest in seconds, and the first paths."""
    latest = keep_latest(df, ["repo", "path"])
    age = (F.unix_micros(now) - F.unix_micros("oldest")) / F.lit(1e6)
    totals = latest.groupBy("repo").agg(F.count("*").alias("count"), F.min("queued_at").alias("oldest"))
    order = W.partitionBy("repo").orderBy("queued_at", "seq")
    first = latest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shown).groupBy("repo").agg(
        F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("_p"))
    return totals.join(first, "repo").select(
        "repo", "count", F.greatest(F.lit(0.0), age).alias("oldest_age_seconds"),
        F.transform("_p", lambda p: p["path"]).alias("paths"))
