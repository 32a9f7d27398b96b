"""Streaming ingest: uploads are gathered in state until they are whole, then checked by the batch rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import constants as K
from ..functions.text import strip
from ..operators.reporting import checked_lines, gate_error, ingest_outputs, validate_events

_OUT = "batch_id string, seq long, raw string, bytes long, events long"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


class _Upload(StatefulProcessor):
    """State of one upload: bytes and events so far, and its lines while it is within the limits.

    An upload over a limit is only counted from then on, so the state is bounded by the limits. It closes when the watermark has passed
    its last row by ``idle_seconds``; then one row with the totals is released, and its lines if it passed.
    """

    def __init__(self, idle_seconds: int, max_bytes: int, max_events: int):
        self.idle, self.max_bytes, self.max_events = idle_seconds, max_bytes, max_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "bytes long, events long, last_us long")
        self.lines = handle.getListState("lines", "seq long, raw string")

    def _closes_ms(self, last_us: int) -> int:
        return last_us // 1000 + self.idle * 1000 + 1

    def _over(self, size: int, events: int) -> bool:
        return size > self.max_bytes or events > self.max_events

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:      # a tick
            return iter(())
        size, events, last_us = self.totals.get() if self.totals.exists() else (-1, 0, 0)
        for pdf in rows:
            size, events, last_us = size + int(pdf["size"].sum()), events + int(pdf["filled"].sum()), max(last_us, int(pdf["received_us"].max()))
            if self._over(size, events):
                self.lines.clear()
                continue
            kept = pdf[pdf["filled"]]
            if len(kept):
                self.lines.appendList([(int(s), r) for s, r in zip(kept["seq"], kept["raw"])])
        self.totals.update((size, events, last_us))
        self.handle.registerTimer(self._closes_ms(last_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            size, events, last_us = self.totals.get()
            if self._closes_ms(last_us) <= timerValues.getCurrentWatermarkInMs():       # else later rows have moved the closing on
                out = [(key[0], None, None, size, events)]
                if not self._over(size, events):
                    out += [(key[0], seq, raw, None, None) for seq, raw in self.lines.get()]
                self.lines.clear()
                self.totals.clear()
                yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "Int64", "bytes": "Int64", "events": "Int64"})

    def close(self) -> None:
        pass


def whole_uploads(
    source: DataFrame, idle_seconds: int = 60, late_seconds: int = 60, max_bytes: int = K.MAX_BATCH_BYTES, max_events: int = K.MAX_BATCH_EVENTS
) -> DataFrame:
    """Closed uploads of a stream (batch_id, seq, raw, received_at): a row of totals (bytes, events) each, and the filled lines of
    those within the limits. Rows without a batch_id only move the time on."""
    raw = F.coalesce("raw", F.lit(""))
    rows = source.select(
        F.col("batch_id").cast("string").alias("batch_id"), F.col("seq").cast("long").alias("seq"), raw.alias("raw"), "received_at",
        F.unix_micros("received_at").alias("received_us"), (F.octet_length(raw) + 1).cast("long").alias("size"), (strip(raw) != "").alias("filled"))
    return rows.withWatermark("received_at", f"{late_seconds} seconds").groupBy("batch_id").transformWithStateInPandas(
        statefulProcessor=_Upload(idle_seconds, max_bytes, max_events), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")


def _tables(batch: DataFrame, kind: str, limits: dict) -> tuple[DataFrame, DataFrame]:
    """(limits per upload, checked lines) of closed uploads."""
    sums = batch.where("seq is null").select(F.col("batch_id").cast(kind).alias("batch_id"), "bytes", "events")
    lines = batch.where("seq is not null").select(F.col("batch_id").cast(kind).alias("batch_id"), "seq", "raw")
    return sums.withColumn("error", gate_error(**limits)), validate_events(lines)


def ingest_stream(
    source: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, idle_seconds: int = 60, late_seconds: int = 60, **limits
) -> StreamingQuery:
    """Split a stream of (batch_id, seq, raw, received_at) lines into accepted and quarantined tables below ``out``.

    An upload may be spread over files and micro-batches: it is held until no row of it has come for ``idle_seconds`` of the stream's
    time, and its limits apply to all of it. Rows may come ``late_seconds`` behind the newest one. Of a source without ``received_at`` each
    micro-batch must hold whole uploads.
    """
    timed = "received_at" in source.columns
    kind = source.schema["batch_id"].dataType.simpleString()
    rows = whole_uploads(source, idle_seconds, late_seconds, **limits) if timed else source

    def save(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        gates, checked = _tables(held, kind, limits) if timed else checked_lines(held, **limits)
        checked = checked.persist()
        for name, table in ingest_outputs(gates, checked).items():
            table.write.mode("overwrite").parquet(f"{out}/{name}/micro_batch={batch_id}")
        checked.unpersist()
        held.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
