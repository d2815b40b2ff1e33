"""Tickets over the star-schema tables, clean and with gaps and spelling variants put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import point_key

#: The same views for the SQL engine that results are compared with.
TICKETS_SQL = """tickets AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderkey AS ingest_seq, o_orderdate AS event_ts, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date,
    o_orderstatus AS status, c_name AS client_normalized, c_mktsegment AS point_name, n_name AS address_city,
    n_name || ', ул. ' || c_mktsegment || ', д. ' || (c_custkey % 40) AS address_normalized, o_orderpriority AS problem_normalized,
    CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS _table_name, o_orderstatus AS _sheet_name,
    c_name || ' | ' || n_name || ', ул. ' || c_mktsegment || ', д. ' || (c_custkey % 40) AS point_key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
MESSY_SQL = """messy AS (
  SELECT o_orderkey AS ingest_seq,
    CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS client_normalized,
    CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS point_name,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE n_name END AS address_city,
    CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE n_name || ', ' END || 'ул. ' || c_mktsegment || ', д. ' || (c_custkey % 400) AS address_normalized
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
TAGS_SQL = """tagged AS (
  SELECT l_orderkey AS ticket_id, list_slice(list_sort(list_distinct(list(p_type))), 1, 3) AS problem_tags, min(p_name) AS problem_normalized, l_orderkey AS ingest_seq
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with customer and nation; Spark broadcasts the small sides while they are small."""
    orders, customer, nation = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat("n_name", F.lit(", ул. "), "c_mktsegment", F.lit(", д. "), (F.col("c_custkey") % 40).cast("string"))
    return joined(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("ticket_id"),
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_orderdate").alias("event_ts"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_name").alias("client_normalized"),
        F.col("c_mktsegment").alias("point_name"),
        F.col("n_name").alias("address_city"),
        address.alias("address_normalized"),
        F.col("o_orderpriority").alias("problem_normalized"),
        F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd").alias("_table_name"),
        F.col("o_orderstatus").alias("_sheet_name"),
        point_key(F.col("c_name"), address).alias("point_key"),
    )


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets with blanks and other spellings by order number."""
    k = F.col("o_orderkey")
    blank_city = k % 6 == 0
    return joined(spark, sf_dir).select(
        k.alias("ingest_seq"),
        F.when(k % 11 == 0, "").when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("client_normalized"),
        F.when(k % 7 == 0, "").when(k % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("point_name"),
        F.when(blank_city, "").otherwise(F.col("n_name")).alias("address_city"),
        F.concat(F.when(blank_city, "").otherwise(F.concat("n_name", F.lit(", "))), F.lit("ул. "), "c_mktsegment", F.lit(", д. "), (F.col("c_custkey") % 400).cast("string")).alias("address_normalized"),
    )


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    types = F.slice(F.array_sort(F.collect_set("p_type")), 1, 3)
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).groupBy(F.col("l_orderkey").alias("ticket_id")).agg(types.alias("problem_tags"), F.min("p_name").alias("problem_normalized")).withColumn("ingest_seq", F.col("ticket_id"))
