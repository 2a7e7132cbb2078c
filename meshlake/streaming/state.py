"""Structured Streaming counterparts of the snapshot operators (STR-01..STR-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """STR-01/11: counts in windows of event time; rows later than the watermark no longer count."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def once(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """STR-04: each content id once within the watermark, so replays change nothing."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, time: str, key: str, idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """STR-09: sessions that end after an idle time."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, idle).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


class LastKnown:
    """STR-03/05: a table of each key's last-known row, upserted from micro-batches.

    Older facts never replace newer ones: a batch and the table so far meet in one ordered aggregation. Every batch
    writes a new generation under the batch's number, so a batch that is run again overwrites only its own.
    """

    def __init__(self, folder: str, key: str, order: list[str], columns: list[str]):
        self.folder, self.key, self.order, self.columns = folder, key, order, columns

    def path(self, batch: int) -> str:
        return f"{self.folder}/generation={batch}"

    def upsert(self, rows: DataFrame, batch: int) -> None:
        wanted = rows.select(self.key, *self.columns)
        if batch > 0:
            wanted = wanted.union(rows.sparkSession.read.schema(wanted.schema).parquet(self.path(batch - 1)))
        best = wanted.groupBy(self.key).agg(F.max_by(F.struct(*self.columns), F.struct(*self.order)).alias("x"))
        best.select(self.key, "x.*").write.mode("overwrite").parquet(self.path(batch))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
