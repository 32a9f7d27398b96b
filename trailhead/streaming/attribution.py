"""Streaming attribution of tool uses to the newest bundle that held their path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "repo string, path string, seq long, event_us long, action string, bundle_id string"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_HELD = ["path", "seq", "event_us", "role", "value"]      # value: a use's action, or the bundle's id
_HELD_SCHEMA = "path string, seq long, event_us long, role string, value string"


class _Bundles(StatefulProcessor):
    """State of one (repo, block): bundles and unanswered uses of all its paths, at most ``2 * max_events`` log rows apart and so as many.

    A use is held until the watermark has passed its time. Then every bundle before it has come, in whatever order and micro-batch,
    and it takes the newest of its path. The same timers drop bundles that are too old for any use. Rows are kept as one list, added to and
    read in a call each, and only the next time that something is due has a timer: calls to the state follow blocks and not rows.
    """

    def __init__(self, window_seconds: int, max_events: int):
        self.window, self.max_events = window_seconds, max_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD_SCHEMA)

    def _due_ms(self, role: str, event_us: int) -> int:
        return event_us // 1000 + 1 + (self.window * 1000 + 999 if role == "bundle" else 0)

    def _wake(self, rows: list[tuple]) -> None:
        if rows:
            self.handle.registerTimer(min(self._due_ms(role, event_us) for _, _, event_us, role, _ in rows))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for pdf in rows:
            pdf = pdf[pdf["role"] != "tick"]
            value = pdf["bundle_id"].where(pdf["role"] == "bundle", pdf["action"])
            fresh += [(path, int(seq), int(us), role, None if pd.isna(v) else v) for path, seq, us, role, v in zip(
                pdf["path"], pdf["seq"], pdf["event_us"], pdf["role"], value)]
        if fresh:
            self.held.appendList(fresh)
            self._wake(fresh)
        return iter(())

    def _answer(self, seq: int, event_us: int, bundles: list[tuple[int, int, str]]) -> str | None:
        """``bundles`` are (seq, event_us, bundle_id) of the use's path, newest first."""
        cutoff = event_us // 1_000_000 - self.window
        return next((b for s, us, b in bundles if 0 < seq - s <= self.max_events and us // 1_000_000 >= cutoff), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs()
        # One bundle or use a path and place in the log; of repeated ones the last counts.
        rows = list({(r[0], r[1], r[3]): tuple(r) for r in self.held.get()}.values())
        bundles: dict[str, list[tuple[int, int, str]]] = {}
        for path, seq, event_us, _, value in sorted((r for r in rows if r[3] == "bundle"), key=lambda r: -r[1]):
            bundles.setdefault(path, []).append((seq, event_us, value))
        due = [r for r in rows if self._due_ms(r[3], r[2]) <= limit]
        left = [r for r in rows if self._due_ms(r[3], r[2]) > limit]
        ripe = sorted((r for r in due if r[3] == "use"), key=lambda r: r[1])
        found = [(key[0], path, seq, event_us, value, self._answer(seq, event_us, bundles.get(path, []))) for path, seq, event_us, _, value in ripe]
        if left and due:
            self.held.put(left)
        elif due:
            self.held.clear()
        if due:
            self._wake(left)
        if found:
            yield pd.DataFrame(found, columns=_COLUMNS)

    def close(self) -> None:
        pass


def attribute_stream(
    uses: DataFrame, ranked: DataFrame, window_seconds: int = 1800, max_events: int = 200, late_seconds: int | None = None
) -> DataFrame:
    """Streaming form of :func:`trailhead.operators.feedback.attribute`, with the same rows in whatever order the log arrives.

    ``uses`` is (repo, path, seq, event_time, action), ``ranked`` (repo, path, seq, event_time, bundle_id). The same
    blocks of log rows as in the batch form split the state, whichever paths they name. A row may come up to ``late_seconds`` (the window, unless
    given) behind the newest one; a use is answered that long after its time. Uses without a path only move the time on: such a tick
    behind the last row lets the last uses out.
    """
    block = F.floor(F.col("seq") / F.lit(max_events)).cast("long")
    shared = ["repo", "path", "seq", "event_time"]
    none = F.lit(None).cast("string")
    role = F.when(F.col("path").isNull(), "tick").otherwise("use")
    used = uses.select(*shared, "action", none.alias("bundle_id"), role.alias("role"), block.alias("block"))
    offered = ranked.select(*shared, none.alias("action"), "bundle_id", F.lit("bundle").alias("role"),
                            F.explode(F.array(block, block + 1)).alias("block"))
    log = used.unionByName(offered).withColumn("event_us", F.unix_micros("event_time"))
    log = log.withWatermark("event_time", f"{window_seconds if late_seconds is None else late_seconds} seconds")
    found = log.groupBy("repo", "block").transformWithStateInPandas(
        statefulProcessor=_Bundles(window_seconds, max_events), outputStructType=_OUT, outputMode="Append",
        timeMode="EventTime")
    return found.select("repo", "path", "seq", F.timestamp_micros("event_us").alias("event_time"), "action", "bundle_id")
