"""Incremental lifting: a stream of records becomes quads, each micro-batch written once.

The identifiers are functions of the data, so a replayed batch writes the same quads; the sink's folder is named by the batch, so a replay
replaces its own output. first_seen keeps one record for each key within the watermark, as the batch lift's first occurrence does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.quads import QUAD


def first_seen(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def lift_stream(stream: DataFrame, lift: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query; lift maps a batch of records to quads."""

    def write(batch: DataFrame, n: int) -> None:
        lift(batch).select(*QUAD).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
