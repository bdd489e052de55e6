"""Arrays that grow while they are acquired: a stream of cells appended to a table, once each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_stream(cells: DataFrame, path: str, checkpoint: str, axes: Sequence[str] = ("t", "c")):
    """Write a stream of (axes, value) to ``path``.

    The query's checkpoint keeps each micro-batch's number; a batch is written to a folder of
    that number, replacing what an interrupted try left there, so no cell is doubled or lost.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        placed = batch.withColumn("__n", F.monotonically_increasing_id())
        last = placed.groupBy(*axes).agg(F.max_by("value", "__n").alias("value"))
        last.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(appended: DataFrame, axes: Sequence[str] = ("t", "c")) -> DataFrame:
    """The array as of the last batch: later batches replace cells of earlier ones."""
    return appended.groupBy(*axes).agg(F.max_by("value", "batch").alias("value"))


def windowed(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Event sums by time window and type, with late events taken up to ``delay``."""
    seen = events.withWatermark("ts", delay)
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
