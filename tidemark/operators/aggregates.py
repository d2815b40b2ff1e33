"""Aggregates whose ties go to what came first, and the shapes that the query tools share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schema import DASH
from tidemark.sources.shared import cut_lineage


def mode_by(df: DataFrame, keys: list[str], value: str, seq: str = "ingest_seq", out: str = "mode", n: Column | None = None) -> DataFrame:
    """The most frequent value of each key, the first seen of equals. ``n`` counts the rows of a group, where a row stands for more than one.

    Two small aggregates: the first is combined on the map side, so a hot key reaches the second as its distinct values.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if n is None else n).alias("n_"), F.min(seq).alias("s_"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n_", -F.col("s_"))).alias(out))


def counts(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("tickets"))


def top(df: DataFrame, key: str, n: int = 20, min_tickets: int = 2) -> DataFrame:
    """The n largest counts, or with n = 0 all above ``min_tickets``."""
    return df.orderBy(F.desc("tickets"), F.asc(key)).limit(n) if n > 0 else df.filter(F.col("tickets") > min_tickets)


def first_distinct(df: DataFrame, key: str, value: str, k: int, seq: str = "ingest_seq", out: str = "items", overflow: bool = True, sep: str = ", ") -> DataFrame:
    """The first k distinct non-blank values of each key in order of appearance, joined; ``+n`` for the rest.

    Values are numbered, not collected: a key of very many values keeps k of them.
    """
    seen = df.filter((F.trim(value) != "") & F.col(key).isNotNull()).groupBy(key, F.trim(value).alias("v_")).agg(F.min(seq).alias("s_"))
    order = Window.partitionBy(key).orderBy("s_", "v_")
    first = seen.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= k)
    joined = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_", "v_"))), lambda x: x["v_"]), sep).alias(out))
    if not overflow:
        return joined
    total = seen.groupBy(key).agg(F.count("*").alias("n_"))
    more = F.when(F.col("n_") > k, F.concat(F.lit(" +"), (F.col("n_") - k).cast("string"))).otherwise("")
    return joined.join(total, key).select(key, F.concat(out, more).alias(out))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """With a 1-based ordinal in front. For bounded tables (a report), as the order is global."""
    return df.select(F.row_number().over(Window.orderBy(*order)).alias("no"), "*")


def numbered_by_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """As ``numbered`` for tables of any size: rows are sorted in ranges of the order, and each range counts from its offset."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    rows = cut_lineage(sorted_).withColumn("range_", F.shiftright("at_", 33))
    sizes = rows.groupBy("range_").agg(F.count("*").alias("n_"))
    # As many rows as ranges.
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("range_", before.alias("before_"))
    no = (F.col("before_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")
    return rows.join(F.broadcast(offsets), "range_").select(no.alias("no"), *df.columns)


def with_items(df: DataFrame, items: DataFrame, key: str, out: str) -> DataFrame:
    return df.join(items, key, "left").withColumn(out, F.coalesce(out, F.lit(DASH)))


def preview(df: DataFrame, columns: dict[str, str], date_col: str = "date", limit: int | None = None) -> DataFrame:
    """Up to eight of the named columns that exist, renamed, newest first, blanks as a dash (dates as they are)."""
    kept = [c for c in columns if c in df.columns][:8]
    blank = lambda c: F.col(c) if c == date_col else F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(DASH)).otherwise(F.col(c).cast("string"))
    ordered = df.orderBy(F.col(date_col).desc_nulls_last(), *[F.col(c) for c in ("ticket_id",) if c in df.columns]) if date_col in df.columns else df
    out = ordered.select(*[blank(c).alias(columns[c]) for c in kept])
    return out.limit(limit) if limit else out


def frequent_values(df: DataFrame, value: str, cap: int = 3000, seq: str = "ingest_seq") -> DataFrame:
    """Distinct values in order of appearance if they are at most ``cap``, else the most frequent ``cap``: a top-k report."""
    held = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(seq).alias("first_seq"))
    few = held.limit(cap + 1).count() <= cap
    return held.orderBy("first_seq") if few else held.orderBy(F.desc("n"), "first_seq").limit(cap)


def keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each non-blank key, the first in order; rows with a blank or null key all stay."""
    blank = F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""
    named = df.filter(~blank).withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("r_ = 1").drop("r_")
    return named.unionByName(df.filter(blank))
