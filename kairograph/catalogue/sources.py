"""Sources: canonical edges, both directions, dense ids, labels, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import edges as E
from ..sources import tables
from .base import ADJ, EDGES, adjacency, edges, query, with_


@query(with_(EDGES, "SELECT pos, src, dst, ts, w FROM edges"))
def edges_canonical(spark, sf):
    return edges(spark, sf).select("pos", "src", "dst", "ts", "w")


@query(with_(EDGES, ADJ, "SELECT node, other, dir::INT AS dir, pos, ts, w FROM adj"))
def edges_bidirectional(spark, sf):
    return adjacency(spark, sf).select("node", "other", "dir", "pos", "ts", "w")


@query(with_(EDGES, "SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges)"))
def node_remap(spark, sf):
    return E.remapped(edges(spark, sf))


@query("SELECT epoch_us(date_trunc('month', o_orderdate)) AS ts, o_custkey AS node, count(*) AS label FROM orders GROUP BY 1, 2")
def node_label_flatten(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", E.micros(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("ts"))
    by = o.groupBy("ts", "o_custkey").agg(F.count("*").alias("n")).groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("o_custkey", "n"))).alias("m"))
    return E.flatten_labels(by.select(F.create_map("ts", "m").alias("labels")))


@query("SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)), 1, 8) AS BIGINT)) AS VARCHAR) AS digest FROM nation")
def table_fingerprint(spark, sf):
    return tables.fingerprint(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT c_custkey AS node, 0 AS ts, least(greatest(c_nationkey - 5, 0), 2) AS split, c_acctbal AS label FROM customer")
def labels_resolved(spark, sf):
    raw = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("nid"), F.lit(0).alias("time"), (F.col("c_nationkey") - 5).alias("ext_roll"), F.col("c_acctbal").alias("y"))
    return E.label_rows(raw).select("node", F.col("ts").cast("int").alias("ts"), "split", "label")


@query(with_(EDGES, "ids AS (SELECT DISTINCT (hash_of * 7919) % n AS pos FROM (SELECT event_id AS hash_of FROM events), (SELECT count(*) AS n FROM edges))", "SELECT e.pos, src, dst, ts FROM edges e JOIN ids ON ids.pos = e.pos"))
def edges_by_id(spark, sf):
    """The edges of a list of ids that grows with the events."""
    e = edges(spark, sf)
    ids = spark.read.parquet(f"{sf}/events.parquet").select(((F.col("event_id") * 7919) % F.lit(e.count())).alias("pos")).distinct()
    return e.join(ids, "pos", "left_semi").select("pos", "src", "dst", "ts")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def events_json(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
