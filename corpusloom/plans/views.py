"""Record-shaped views of the tables, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places and parts are dimensions; beyond this many rows they are shuffled (some 60 bytes each).
BROADCAST_ROWS = 500_000
#: Rows with which much is done that one task gets, so that more rows give more tasks, not larger ones.
DEALT_ROWS = 1 << 14


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of texts; dealt anew where its files give so few partitions that threads would stand idle."""
    rows, threads = table(spark, d, name), spark.sparkContext.defaultParallelism
    return rows.repartition(threads) if 2 * rows.rdd.getNumPartitions() <= threads else rows


def dealt(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key into parts by its number of rows, however few its files and row groups are.

    What is then cut, windowed or grouped by the key stays where it is.
    """
    rows = table(spark, d, name)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS)), key)


def places(spark: SparkSession, d: str) -> DataFrame:
    """(n_nationkey, citta, regione); a row per nation."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("citta"), F.col("r_name").alias("regione"))


def records(spark: SparkSession, d: str, read=table) -> DataFrame:
    """Orders as records: place, kind, material, and an interval of signed numbers with missing bounds.

    ``read`` is ``spread`` where much is done with each record.
    """
    o, c = read(spark, d, "orders"), table(spark, d, "customer")
    start = F.datediff(F.to_date("o_orderdate"), F.lit("1998-04-01").cast("date")).cast("long")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(places(spark, d), c.c_nationkey == F.col("n_nationkey"))
    return rows.select(
        F.col("o_orderkey").alias("id"),
        "regione",
        "citta",
        F.col("o_orderpriority").alias("tipo"),
        F.col("c_mktsegment").alias("materiale"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0).cast("long")).otherwise(start).alias("data_inizio"),
        F.when(F.col("o_orderstatus") != "P", start + F.col("o_custkey") % 200).alias("data_fine"),
        F.col("o_totalprice").alias("prezzo"),
    )


RECORDS = """records AS (
  SELECT o_orderkey AS id, r_name AS regione, n_name AS citta, o_orderpriority AS tipo, c_mktsegment AS materiale,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE date_diff('day', DATE '1998-04-01', CAST(o_orderdate AS DATE)) END AS data_inizio,
    CASE WHEN o_orderstatus <> 'P' THEN date_diff('day', DATE '1998-04-01', CAST(o_orderdate AS DATE)) + o_custkey % 200 END AS data_fine,
    o_totalprice AS prezzo
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    """(record, marca, tipo, nome, citta, regione): a row per line item, with its part and its supplier's place."""
    li, p, s = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "supplier")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(places(spark, d), s.s_nationkey == F.col("n_nationkey"))
    return rows.select(F.col("l_orderkey").alias("record"), F.col("p_brand").alias("marca"), F.col("p_type").alias("tipo"), F.col("p_name").alias("nome"), "citta", "regione")


ITEMS = """items AS (
  SELECT l_orderkey AS record, p_brand AS marca, p_type AS tipo, p_name AS nome, n_name AS citta, r_name AS regione
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(existing, incoming) rows of a merge, from parts; keys repeat on both sides."""
    p = table(spark, d, "part")
    key = F.concat_ws("/", "p_brand", "p_name", "p_type").alias("chiave")
    old = p.where("p_size <= 30").select(key, F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("misura"), F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("file"))
    new = p.where("p_size > 20").select(key, F.col("p_partkey").alias("ord"), (F.col("p_size") + 100).cast("long").alias("misura"), F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("file"))
    return old, new


VERSIONS = """existing AS (SELECT p_brand || '/' || p_name || '/' || p_type AS chiave, p_partkey AS ord, CAST(p_size AS BIGINT) AS misura, 'old-' || p_partkey AS file FROM part WHERE p_size <= 30),
incoming AS (SELECT p_brand || '/' || p_name || '/' || p_type AS chiave, p_partkey AS ord, CAST(p_size + 100 AS BIGINT) AS misura, 'new-' || p_partkey AS file FROM part WHERE p_size > 20)"""
