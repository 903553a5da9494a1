"""Neighbour sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform01_sql
from ..operators import neighbors as N
from ..operators import partition as P
from .base import ADJ, EDGES, HOT, OWNERS, SNAP, adjacency, hot, owners, query, snapshots, with_

K = 20
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts, pos, dir) AS rn, rank() OVER (PARTITION BY node ORDER BY ts) - 1 AS before FROM adj)"
_ROOTS = "roots AS (SELECT DISTINCT node, ts AS cutoff, before AS degree FROM ranked)"
_NEAR = "SELECT r.node, r.cutoff, r.degree, a.other, a.ts, a.pos, a.dir, r.degree - a.rn + 1 AS back FROM roots r JOIN ranked a ON a.node = r.node AND a.rn <= r.degree AND a.rn > r.degree - {k}"


@query(with_(EDGES, ADJ, _RANKED, _ROOTS, "SELECT node, cutoff, other, ts, pos, dir::INT AS dir, back, cutoff - ts AS delta FROM (" + _NEAR.format(k=5) + ")"))
def recent_k_neighbors(spark, sf):
    return N.recent(adjacency(spark, sf), None, 5).select("node", "cutoff", "other", "ts", "pos", "dir", F.col("back").cast("long").alias("back"), "delta")


@query(with_(EDGES, ADJ, _RANKED, _ROOTS, "SELECT node, cutoff, count(*) AS n_neighbors, min(cutoff - ts) AS min_delta, max(cutoff - ts) AS max_delta, sum(pos)::BIGINT AS sum_pos FROM (" + _NEAR.format(k=K) + ") GROUP BY node, cutoff"))
def recent_k_stats(spark, sf):
    return N.recent_stats(adjacency(spark, sf), K)


@query(with_(EDGES, ADJ, "q AS (SELECT DISTINCT node, 5 + min(ts) OVER (PARTITION BY node) + (max(ts) OVER (PARTITION BY node) - min(ts) OVER (PARTITION BY node)) // 2 AS cutoff FROM adj)", "SELECT node, cutoff, pos, dir::INT AS dir, back FROM (SELECT q.node, q.cutoff, a.pos, a.dir, row_number() OVER (PARTITION BY q.node ORDER BY a.ts DESC, a.pos DESC, a.dir DESC) AS back FROM q JOIN adj a ON a.node = q.node AND a.ts < q.cutoff) WHERE back <= 5"))
def recent_k_any_cutoff(spark, sf):
    a = adjacency(spark, sf)
    q = a.groupBy("node").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("node", (5 + F.col("a") + F.expr("(b - a) div 2")).alias("cutoff"))
    return N.recent(a, q, 5, hub_safe=True).select("node", "cutoff", "pos", "dir", F.col("back").cast("long").alias("back"))


@query(
    with_(
        EDGES, ADJ, _RANKED, "roots AS (SELECT node, max(ts) + 1 AS cutoff, count(*) AS degree FROM ranked GROUP BY node)",
        "hop0 AS (" + _NEAR.format(k=3) + ")",
        "f AS (SELECT DISTINCT other AS node, ts AS cutoff FROM hop0)",
        "hop1 AS (SELECT f.node, f.cutoff, a.other, a.ts, a.pos, a.dir, row_number() OVER (PARTITION BY f.node, f.cutoff ORDER BY a.rn DESC) AS back FROM f JOIN ranked a ON a.node = f.node AND a.ts < f.cutoff)",
        "SELECT 0 AS layer, node, cutoff, other, ts, pos FROM hop0 UNION ALL SELECT 1, node, cutoff, other, ts, pos FROM hop1 WHERE back <= 2",
    )
)
def two_hop_recent(spark, sf):
    a = adjacency(spark, sf)
    roots = a.groupBy("node").agg((F.max("ts") + 1).alias("cutoff"))
    return N.expand(a, roots, [3, 2]).select("layer", "node", "cutoff", "other", "ts", "pos")


@query(with_(EDGES, ADJ, _RANKED, _ROOTS, f"SELECT r.node, r.cutoff, d.draw::INT AS draw, a.other, a.ts, a.pos, a.dir::INT AS dir FROM roots r, generate_series(0, 4) d(draw) JOIN ranked a ON a.node = r.node AND a.rn = CASE WHEN r.degree <= 5 THEN d.draw + 1 ELSE floor({uniform01_sql('r.node + d.draw * 1000003', 'r.cutoff', 17)} * r.degree)::BIGINT + 1 END WHERE d.draw < least(r.degree, 5)"))
def uniform_k(spark, sf):
    return N.uniform(adjacency(spark, sf), None, 5).select("node", "cutoff", F.col("draw").cast("int").alias("draw"), "other", "ts", "pos", "dir")


@query(
    with_(
        EDGES, ADJ, _RANKED, "run AS (SELECT *, sum(w) OVER (PARTITION BY node ORDER BY rn) AS s FROM ranked)", "roots AS (SELECT node, max(ts) + 1 AS cutoff, count(*) AS degree, sum(w) AS total FROM ranked GROUP BY node)",
        f"draws AS (SELECT node, cutoff, degree, draw, {uniform01_sql('node + draw * 1000003', 'cutoff', 19)} * total AS x FROM roots, generate_series(0, 2) d(draw))",
        "SELECT d.node, d.cutoff, d.draw::INT AS draw, (SELECT min(rn) FROM run WHERE run.node = d.node AND run.s >= d.x) AS rn FROM draws d",
    )
)
def weighted_k(spark, sf):
    a = adjacency(spark, sf)
    roots = a.groupBy("node").agg((F.max("ts") + 1).alias("cutoff"))
    got = N.weighted(a, roots, 3)
    ranks = N.ranked(a).select("node", "pos", "dir", F.col("rn").cast("long").alias("rn"))
    return got.join(ranks, ["node", "pos", "dir"]).select("node", "cutoff", "draw", "rn")


_BOUND = "bound AS (SELECT adj.*, (o.part <> f.part AND h.node IS NULL) AS boundary FROM adj JOIN owners o ON o.node = adj.node JOIN owners f ON f.node = adj.other LEFT JOIN hot h ON h.node = adj.other)"
_BRANKED = _RANKED.replace("FROM adj", "FROM bound")
_BNEAR = _NEAR.replace("a.dir, r.degree", "a.dir, a.boundary, r.degree")


def _bound(spark, sf):
    return P.boundary(adjacency(spark, sf), owners(spark, sf), hot(spark, sf))


@query(with_(EDGES, ADJ, OWNERS, HOT, _BOUND, "SELECT node, other, pos, dir::INT AS dir, boundary FROM bound"))
def boundary_flags(spark, sf):
    return _bound(spark, sf).select("node", "other", "pos", "dir", "boundary")


@query(with_(EDGES, ADJ, OWNERS, HOT, _BOUND, _BRANKED, _ROOTS, "near AS (" + _BNEAR.format(k=10) + ")", f"SELECT node, cutoff, pos, dir::INT AS dir, back, place FROM (SELECT *, row_number() OVER (PARTITION BY node, cutoff ORDER BY back) AS place FROM near WHERE NOT boundary OR {uniform01_sql('node + pos * 31', 'cutoff', 23)} < 0.3) WHERE place <= 5"))
def boundary_uniform_k(spark, sf):
    got = N.boundary_recent(_bound(spark, sf), None, 5, 0.3)
    return got.select("node", "cutoff", "pos", "dir", F.col("back").cast("long").alias("back"), F.col("place").cast("long").alias("place"))


@query(
    with_(
        EDGES, ADJ, OWNERS, HOT, _BOUND, _BRANKED, _ROOTS, "near0 AS (" + _BNEAR.format(k=10) + ")",
        "near1 AS (SELECT *, CASE WHEN boundary AND back <= 5 THEN exp((ts - cutoff)::DOUBLE / ((cutoff - max(ts) OVER (PARTITION BY node, cutoff)) * 5)::DOUBLE) END AS e FROM near0)",
        "near AS (SELECT *, sum(e) OVER (PARTITION BY node, cutoff) AS total, count(e) OVER (PARTITION BY node, cutoff) AS n FROM near1)",
        f"SELECT node, cutoff, pos, dir::INT AS dir, back, place FROM (SELECT *, row_number() OVER (PARTITION BY node, cutoff ORDER BY back) AS place FROM near WHERE NOT boundary OR (back <= 5 AND {uniform01_sql('node + pos * 31', 'cutoff', 29)} < CASE WHEN total < 1e-6 THEN 1.0 ELSE 0.3 * n * e / total END)) WHERE place <= 5",
    )
)
def boundary_decay_k(spark, sf):
    got = N.boundary_decay(_bound(spark, sf), None, 5, 0.3)
    return got.select("node", "cutoff", "pos", "dir", F.col("back").cast("long").alias("back"), F.col("place").cast("long").alias("place"))


_SADJ = "sadj AS (SELECT snapshot, src AS node, dst AS other, 0 AS dir, pos FROM snaps UNION ALL SELECT snapshot, dst, src, 1, pos FROM snaps)"


def _snapshot_adjacency(spark, sf):
    from ..sources.edges import bidirectional

    return bidirectional(snapshots(spark, sf).select("src", "dst", "pos", "snapshot"))


@query(
    with_(
        EDGES, SNAP, _SADJ, "sr AS (SELECT *, row_number() OVER (PARTITION BY node, snapshot ORDER BY pos, dir) AS rn, count(*) OVER (PARTITION BY node, snapshot) AS degree FROM sadj)",
        f"SELECT r.node, r.snapshot, d.draw, a.other, a.pos, a.dir::INT AS dir FROM (SELECT DISTINCT node, snapshot, degree FROM sr) r, generate_series(0, 3) d(draw) JOIN sr a ON a.node = r.node AND a.snapshot = r.snapshot AND a.rn = CASE WHEN r.degree <= 4 THEN d.draw + 1 ELSE floor({uniform01_sql('r.node + d.draw * 1000003', 'r.snapshot', 31)} * r.degree)::BIGINT + 1 END WHERE d.draw < least(r.degree, 4)",
    )
)
def snapshot_neighbors(spark, sf):
    return N.snapshot_uniform(_snapshot_adjacency(spark, sf), 4)


@query(with_(EDGES, ADJ, f"SELECT node, other, place FROM (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY {uniform01_sql('node', 'other', 37)}, other) AS place FROM (SELECT DISTINCT node, other FROM adj)) WHERE place <= 4"))
def static_k(spark, sf):
    return N.static_sample(adjacency(spark, sf), 4).select("node", "other", F.col("place").cast("long").alias("place"))
