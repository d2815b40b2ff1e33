"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import cut_lineage

#: Edges of a part while components are found.
PART_ROWS = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that edges (a, b) reach, for nodes with a smaller one in reach. Nodes may be of any type that has an order.

    Alternating large-star and small-star steps; each keeps the components, needs one minimum for each node, and adds no
    edge. They end when the edges are stars. Every round is checkpointed, in as many parts as its rows need.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(parts))

    parts = most
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (sums["n"], sums["h"]) == mark or not sums["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (sums["n"], sums["h"])
        parts = min(most, 1 + sums["n"] // PART_ROWS)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima come from files, so that a join can split the rows of a node with very many neighbours.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        edges = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = cut(edges)
