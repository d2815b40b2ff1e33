"""Contiguous shards of near-equal bytes, cut from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import block_of, cut_lineage, cut_points, shuffle_partitions


def shard_by_bytes(docs: DataFrame, shards: int = 40, row_overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; shards are contiguous in id order.

    Rows fall into many small blocks of the id order; block totals (some numbers for each block) give each block its
    global offset, and a running sum inside the block gives each row its own. A row goes to the shard in whose equal
    share of all bytes its middle lies, so a shard is off the equal size by one row's size at most. Null texts have no
    bytes and the CRC of an empty text; null ids come first; rows of equal id are ordered by CRC and size, and repeated
    rows are interchangeable. Ids are numbers; rows that share one id, missing ones among them, lie in one block,
    which one task orders (by id, CRC and size alone, without the texts). Very long texts count by their size; other columns,
    whatever their names, are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    # A few blocks for each task, so that tasks stay even however the blocks hash.
    cuts, _, _ = cut_points(docs, id_col, 8 * shuffle_partitions(spark))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + row_overhead).alias("size"),
        F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"),
        block_of(F.col(id_col), cuts).alias("block"),
    )
    rows = cut_lineage(rows)
    totals = rows.groupBy("block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # As many rows as blocks, MAX_BLOCKS at most: one task and a broadcast hold them.
    bases = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select("*", F.sum("size").over(inside).alias("upto"), F.row_number().over(inside).alias("nth")).join(F.broadcast(bases), "block")
    middle = 2 * (F.col("base_bytes") + F.col("upto")) - F.col("size")
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("all_bytes"))).cast("int")).alias("shard"), (F.col("base_rows") + F.col("nth") - 1).alias("place")
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
