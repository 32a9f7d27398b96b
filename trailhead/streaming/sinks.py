"""Sinks that a repeated micro-batch overwrites instead of duplicating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_batches(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch to ``out/micro_batch=<id>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/micro_batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
