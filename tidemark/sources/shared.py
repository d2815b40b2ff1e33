"""The folder that the driver and all executors share, checkpoints in it, and runs that can be cancelled."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it; only a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lost executors don't lose it, and later plans start from its files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder in one job and read again, for rows that are used more than once and observed on their way."""
    place = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it has fewer: a small file is one, however much work its rows make."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


INTERRUPT = "spark.job.interruptOnCancel"


class Cancelled(Exception):
    """A run was stopped from outside; what it had stored by then stays."""


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs begun inside carry ``tag``, by which ``cancel`` finds them and interrupts their tasks, a provider's call included.

    Streams started inside carry it on; other threads do if they are ``pyspark.InheritableThread``.
    """
    held = spark.sparkContext.getLocalProperty(INTERRUPT)
    spark.sparkContext.addJobTag(tag)
    spark.sparkContext.setLocalProperty(INTERRUPT, "true")
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty(INTERRUPT, held)
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def checked(stop: Callable[[], bool] | None) -> None:
    """Raise where the caller asks to stop: between sheets, between slices of keys."""
    if stop and stop():
        raise Cancelled
