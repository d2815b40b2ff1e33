"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import cut_lineage, shared_dir  # noqa: F401  operators take them from here

#: Cut points are searched in levels of this many; three levels hold up to FAN ** 3 blocks.
FAN = 64
MAX_BLOCKS = FAN**3
#: The setting of a session that bounds Arrow batches, and the bound that operators over whole texts ask for.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Give memory that a task has freed back to the system: its Python process goes on to idle, or to other tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; before the next one comes, what the one before left behind is given back."""
    for b in batches:
        yield b
        give_back()


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after a bound on the bytes of an Arrow batch where its session sets none.

    Spark's own bound is 64 MB. A batch of whole texts lies twice in the executor's memory outside the heap while it grows, and again, as texts, in
    the Python worker of each task; results don't depend on it. A row larger than the bound is a batch by itself.
    """
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it: for columns that live only inside an operator."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` worked out once for a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def distinct_by(rows: DataFrame, key: str, broadcast_keys: int) -> DataFrame:
    """One row of each value of ``key``. Only rows whose key repeats are shuffled, folded before that in each task.

    Keys that repeat are broadcast up to ``broadcast_keys`` and joined by a shuffle beyond.
    """
    repeated = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(key))
    n = repeated.count()
    if not n:
        return rows
    known = F.broadcast(repeated) if n <= broadcast_keys else repeated
    return rows.join(known, key, "left_anti").unionByName(rows.join(known, key, "left_semi").dropDuplicates([key]))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_points(df: DataFrame, key: str, blocks: int) -> tuple[list[int], int | None, bool]:
    """Values of ``key`` at which near-equal blocks start, its least value, and whether it has nulls.

    One pass over that column; the driver gets ``blocks`` numbers at most, never rows.
    """
    blocks = max(2, min(blocks, MAX_BLOCKS))
    shares = F.transform(F.sequence(F.lit(1), F.lit(blocks - 1)), lambda i: i / F.lit(float(blocks)))
    got = df.agg(
        F.expr(f"percentile_approx({key}, {'array(' + ','.join(str(i / blocks) + 'D' for i in range(1, blocks)) + ')'}, {max(10_000, 4 * blocks)})").alias("q")
        if blocks <= 20_000
        else F.percentile_approx(key, shares, 4 * blocks).alias("q"),
        F.min(key).alias("lo"),
        F.count(F.when(F.col(key).isNull(), 1)).alias("nulls"),
    ).first()
    return sorted({c for c in got["q"] or [] if c > got["lo"]}), got["lo"], got["nulls"] > 0


def block_of(key: Column, cuts: list[int]) -> Column:
    """How many cut points are at or below ``key`` (0 for null), by a search of a few levels over literals."""
    if not cuts:
        return F.lit(0)
    levels = [cuts]
    while len(levels[0]) > FAN:
        levels.insert(0, levels[0][FAN - 1 :: FAN])
    found = F.lit(0)
    for values in levels:
        # Written as one string, so that the plan holds one literal and not an expression for each number.
        held = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
        part = held if values is levels[0] else F.slice(held, found * FAN + 1, F.lit(FAN))
        found = found * FAN * int(values is not levels[0]) + F.size(F.filter(part, lambda c: c <= key))
    return found
