"""Tickets as a stream: sheets that change, one row of each id within a watermark, and activity in sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.sources.shared import cut_lineage
from tidemark.sources.sheets import REMOVED, SHEET, Tickets, registered, sheet_key


def stored(batch: DataFrame, number: int, table: Tickets, stream: str, make: Callable[[DataFrame], DataFrame] = ingest.tickets) -> bool:
    """Put the sheets of one batch of grid rows into the table; False if that batch was stored before a crash.

    Table, catalogue, reasons of rejected sheets and the batch's number change in one step, so that a batch counts once however
    often it is replayed. A sheet that is gone, or no longer readable, loses its rows.
    """
    # Held apart, so that headers and rows are of one reading of a sheet that may change meanwhile.
    grid = cut_lineage(batch)
    changed = [tuple(r) for r in grid.select(*SHEET).distinct().collect()]
    there = grid.filter(f"error is null or error <> '{REMOVED}'")
    reasons = {sheet_key(r["_table_name"], r["_sheet_name"]): r["reason"] for r in ingest.rejected_sheets(there).collect()}
    return table.refresh(make(there), changed, reasons, (stream, number))


def refresh(spark: SparkSession, folder: str, table: Tickets, checkpoint: str, make: Callable[[DataFrame], DataFrame] = ingest.tickets) -> None:
    """Bring the table up to date with the sheets of ``folder``: only those that changed since the last call are read.

    ``checkpoint`` keeps what was seen; a new one sees all sheets as new.
    """

    def sink(batch: DataFrame, number: int) -> None:
        # The stream's own id lies in its checkpoint: a new checkpoint counts its batches anew under another name.
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        stored(batch, number, table, stream, make)

    source = registered(spark).readStream.format("sheets").load(folder)
    source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are read in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def first_of_each(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """State for a key is kept until the watermark passes it, so it is bounded by the lateness, not by the stream."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of each key in sessions that a gap ends."""
    return timed(stream, ts, late).groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(key, "s.start", "s.end", "n")


def daily_counts(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    return timed(stream, ts, late).groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "n")
