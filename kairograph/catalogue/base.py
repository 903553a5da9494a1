"""Registration of queries, and the SQL that the views over the driver's tables share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edges import DST_BASE, bidirectional, micros, order_items, read_edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Months of 30 days, in microseconds: the snapshots of the edge stream.
MONTH = 30 * 86_400_000_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


EDGES = f"""edges AS (
  SELECT row_number() OVER (ORDER BY ts, src, dst, w, price, disc, tax) - 1 AS pos, * FROM (
    SELECT o_custkey AS src, {DST_BASE} + l_partkey AS dst, epoch_us(o_orderdate) AS ts, l_quantity AS w,
           l_extendedprice AS price, l_discount AS disc, l_tax AS tax
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey))"""
ADJ = """adj AS (
  SELECT src AS node, dst AS other, 0 AS dir, pos, ts, w FROM edges
  UNION ALL SELECT dst, src, 1, pos, ts, w FROM edges)"""
SNAP = f"""t0 AS (SELECT min(ts) AS t0 FROM edges),
snaps AS (SELECT (ts - t0) // {MONTH} AS snapshot, edges.* FROM edges, t0)"""
CUST = "SELECT c_custkey AS node, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM customer UNION ALL SELECT 10000000 + p_partkey, p_retailprice, p_size::DOUBLE FROM part"
OWNERS = "owners AS (SELECT node, (node % 4)::INT AS part FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges))"
HOT = "hot AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node ORDER BY degree DESC, node LIMIT 50)"


def with_(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join(ctes) + "\n" + last


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return read_edges(spark, sf)


def adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return bidirectional(edges(spark, sf).select("src", "dst", "pos", "ts", "w"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return in_months(edges(spark, sf))


def in_months(e: DataFrame) -> DataFrame:
    """Edges with ``snapshot``: their month, from the first edge on."""
    first = e.agg(F.min("ts").alias("t0"))
    return e.crossJoin(F.broadcast(first)).withColumn("snapshot", F.floor((F.col("ts") - F.col("t0")) / MONTH).cast("long")).drop("t0")  # one row


def features(spark: SparkSession, sf: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("x0"), F.col("c_nationkey").cast("double").alias("x1"))
    parts = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_partkey") + DST_BASE).alias("node"), F.col("p_retailprice").alias("x0"), F.col("p_size").cast("double").alias("x1"))
    return customers.unionByName(parts)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def owners(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.partition import round_robin

    return round_robin(nodes(spark, sf), 4)


def hot(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.partition import hot_nodes

    return hot_nodes(edges(spark, sf), count=50)


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Rounded, as sums of floats differ in their last bits between engines."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


__all__ = [n for n in dir() if not n.startswith("_")]
