"""Negative samples and target tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash31_sql, uniform01_sql
from ..operators import partition as P
from ..operators import targets as T
from .base import EDGES, HOT, OWNERS, edges, hot, owners, query, with_

_EP = "ep AS (SELECT edges.*, part FROM edges JOIN owners ON node = dst)"
_LOCAL = "lp AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT dst AS node FROM ep WHERE part = 1 UNION SELECT node FROM hot WHERE node IN (SELECT dst FROM edges)))"
_ALL = "gp AS (SELECT dst AS node, row_number() OVER (ORDER BY dst) - 1 AS idx FROM (SELECT DISTINCT dst FROM edges))"
_NEG = f"""d AS (SELECT pos, k::INT AS neg_idx, CASE WHEN {uniform01_sql("pos", "k", 3)} < 0.1 THEN 1 ELSE 0 END AS branch FROM edges, generate_series(0, 1) g(k)),
neg AS (SELECT d.*, lp.node FROM d JOIN lp ON branch = 0 AND lp.idx = {hash31_sql("pos", "neg_idx", 4)} % (SELECT count(*) FROM lp) UNION ALL SELECT d.*, gp.node FROM d JOIN gp ON branch = 1 AND gp.idx = {hash31_sql("pos", "neg_idx", 4)} % (SELECT count(*) FROM gp))"""


def _parts(spark, sf):
    return P.edge_owner(edges(spark, sf), owners(spark, sf))


def _negatives(spark, sf):
    ep = _parts(spark, sf)
    return T.mixed_negatives(edges(spark, sf), T.pool(T.local_pool(ep, 1, hot(spark, sf))), T.pool(ep.select(F.col("dst").alias("node"))), T.NegativePolicy(2, 0.1))


@query(with_(EDGES, OWNERS, HOT, _EP, _LOCAL, _ALL, _NEG, "SELECT pos, neg_idx, branch, node, round(CASE WHEN branch = 1 THEN 5.0 ELSE 0.5 / 0.9 END, 6)::DOUBLE AS weight FROM neg"))
def negatives_mixed(spark, sf):
    return _negatives(spark, sf).withColumn("weight", F.round("weight", 6))


@query(with_(EDGES, OWNERS, _EP, "SELECT DISTINCT dst AS node FROM ep WHERE part <> 1"))
def remote_pool(spark, sf):
    return T.remote_pool(_parts(spark, sf), 1)


@query(with_(EDGES, OWNERS, HOT, _EP, _LOCAL, "SELECT node, idx FROM lp"))
def hot_merged_pool(spark, sf):
    return T.pool(T.local_pool(_parts(spark, sf), 1, hot(spark, sf)))


@query(with_(EDGES, OWNERS, HOT, f"SELECT pos FROM edges JOIN owners a ON a.node = src JOIN owners b ON b.node = dst LEFT JOIN hot h ON h.node = src LEFT JOIN hot g ON g.node = dst WHERE NOT (a.part <> b.part AND h.node IS NULL AND g.node IS NULL) OR {uniform01_sql('pos', '0', 5)} < 0.4"))
def positive_downsample(spark, sf):
    return T.downsample_positives(edges(spark, sf), owners(spark, sf), hot(spark, sf), 0.4).select("pos")


@query(with_(EDGES, OWNERS, HOT, _EP, _LOCAL, _ALL, _NEG, "SELECT pos, 'src' AS role, src AS node, ts AS cutoff, NULL::INT AS neg_idx FROM edges UNION ALL SELECT pos, 'dst', dst, ts, NULL FROM edges UNION ALL SELECT neg.pos, 'neg', node, ts, neg_idx FROM neg JOIN edges ON edges.pos = neg.pos"))
def target_rows(spark, sf):
    return T.target_rows(edges(spark, sf), _negatives(spark, sf))


@query(with_(EDGES, "SELECT DISTINCT src AS node, ts AS cutoff FROM edges UNION SELECT dst, ts FROM edges"))
def sampling_roots(spark, sf):
    e = edges(spark, sf)
    return T.roots_of(e.select(F.col("src").alias("node"), F.col("ts").alias("cutoff")), e)
