"""Degrees, norms, propagation, reductions per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import with_position
from .base import ADJ, CUST, EDGES, SNAP, adjacency, edges, features, query, r6, snapshots, with_

_FEAT = f"feat AS ({CUST})"
_DEG = "deg AS (SELECT snapshot, node, sum(o)::BIGINT AS out_deg, sum(i)::BIGINT AS in_deg FROM (SELECT snapshot, src AS node, trunc(w)::BIGINT AS o, 0 AS i FROM snaps UNION ALL SELECT snapshot, dst, 0, trunc(w)::BIGINT FROM snaps) GROUP BY snapshot, node)"
_NORM = """od AS (SELECT src AS node, sum(w) AS o FROM edges GROUP BY src), idg AS (SELECT dst AS node, sum(w) AS i FROM edges GROUP BY dst),
nd AS (SELECT coalesce(od.node, idg.node) AS node, coalesce(o, 0) + 1 AS o, coalesce(i, 0) + 1 AS i FROM od FULL JOIN idg ON od.node = idg.node),
normed AS (SELECT e.src, e.dst, e.w, e.w / sqrt(a.o * b.i) AS norm, false AS is_self FROM edges e JOIN nd a ON a.node = e.src JOIN nd b ON b.node = e.dst UNION ALL SELECT node, node, 1.0, 1 / sqrt(o * i), true FROM nd)"""


@query(with_(EDGES, SNAP, _DEG, "SELECT * FROM deg"))
def degree_weighted(spark, sf):
    return G.weighted_degrees(snapshots(spark, sf), "snapshot")


@query(with_(EDGES, SNAP, _DEG, "SELECT d.snapshot, d.node, round(ln(1 + d.in_deg), 6) AS x, CASE WHEN d.snapshot < (SELECT max(snapshot) FROM deg) THEN round(coalesce(ln(1 + n.in_deg), 0), 6) END AS label FROM deg d LEFT JOIN deg n ON n.node = d.node AND n.snapshot = d.snapshot + 1"))
def log_degree_next(spark, sf):
    return r6(G.next_log_degree(G.weighted_degrees(snapshots(spark, sf), "snapshot"), "snapshot"), "x", "label")


@query(with_(EDGES, _NORM, "SELECT src, dst, w, round(norm, 6) AS norm, is_self FROM normed"))
def gcn_norm(spark, sf):
    return r6(G.gcn_norm(edges(spark, sf)), "norm")


@query(with_(EDGES, "SELECT src, dst, w, round(w / sqrt(sum(w) OVER (PARTITION BY src) * sum(w) OVER (PARTITION BY dst)), 6) AS norm FROM edges"))
def gcn_norm_without_loops(spark, sf):
    return r6(G.gcn_norm(edges(spark, sf), self_loops=False), "norm").drop("is_self")


@query(with_(EDGES, "SELECT src, dst, w, round(w / sum(w) OVER (PARTITION BY src), 12) AS forward, round(w / sum(w) OVER (PARTITION BY dst), 12) AS backward FROM edges"))
def diffusion_norm(spark, sf):
    return G.diffusion_norm(edges(spark, sf)).withColumns({c: F.round(c, 12) for c in ("forward", "backward")})


@query(with_(EDGES, "SELECT src, round(1.0::DOUBLE / count(*), 12) AS norm FROM edges GROUP BY src"))
def reverse_norm(spark, sf):
    return G.reverse_norm(edges(spark, sf)).withColumn("norm", F.round("norm", 12))


@query(with_(EDGES, _FEAT, "SELECT dst AS node, round(avg(x0), 9) AS x0, round(avg(x1), 9) AS x1 FROM (SELECT dst, x0, x1 FROM edges JOIN feat ON feat.node = src UNION ALL SELECT node, x0, x1 FROM feat WHERE node IN (SELECT dst FROM edges)) GROUP BY dst"))
def neighbor_mean(spark, sf):
    out = G.neighbor_mean(edges(spark, sf), features(spark, sf), ["x0", "x1"], own=True)
    return out.withColumns({"x0": F.round("x0", 9), "x1": F.round("x1", 9)})


@query(with_(EDGES, _NORM, _FEAT, "SELECT dst AS node, round(sum(norm * x0), 7) AS x0, round(sum(norm * x1), 7) AS x1 FROM normed JOIN feat ON feat.node = src GROUP BY dst"))
def gcn_propagate_1(spark, sf):
    out = G.propagate(G.gcn_norm(edges(spark, sf)), features(spark, sf), ["x0", "x1"])
    return out.withColumns({c: F.round(c, 7) for c in ("x0", "x1")})


@query(with_(EDGES, _NORM, _FEAT, "one AS (SELECT dst AS node, sum(norm * x0) AS x0, sum(norm * x1) AS x1 FROM normed JOIN feat ON feat.node = src GROUP BY dst)", "SELECT dst AS node, round(sum(norm * x0), 7) AS x0, round(sum(norm * x1), 7) AS x1 FROM normed JOIN one ON one.node = src GROUP BY dst"))
def gcn_propagate_2(spark, sf):
    normed = G.gcn_norm(edges(spark, sf))
    one = G.propagate(normed, features(spark, sf), ["x0", "x1"])
    return G.propagate(normed, one, ["x0", "x1"]).withColumns({c: F.round(c, 7) for c in ("x0", "x1")})


@query(with_(EDGES, "SELECT pos, round(exp(w - max(w) OVER (PARTITION BY dst)) / (sum(exp(w - 50)) OVER (PARTITION BY dst) * exp(50 - max(w) OVER (PARTITION BY dst))), 6) AS share FROM edges"))
def grouped_softmax(spark, sf):
    return r6(G.grouped_softmax(edges(spark, sf), ["dst"], "w"), "share").select("pos", "share")


@query(with_(EDGES, SNAP, "SELECT snapshot, round(avg(price), 8) AS mean_price, round(avg(disc), 11) AS mean_disc, max(price) AS max_price, max(disc) AS max_disc FROM snaps GROUP BY snapshot"))
def snapshot_context(spark, sf):
    out = G.snapshot_context(snapshots(spark, sf), "snapshot", ["price", "disc"])
    return out.withColumns({"mean_price": F.round("mean_price", 8), "mean_disc": F.round("mean_disc", 11)})


@query(with_(EDGES, ADJ, "SELECT node, ts, w, pos FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, pos DESC) AS r FROM adj) WHERE r = 1"))
def latest_by_node(spark, sf):
    return G.latest(adjacency(spark, sf), ["node"], ["w", "pos"])


@query(with_(EDGES, ADJ, "SELECT node, arg_min(ts, pos) AS first_ts FROM adj GROUP BY node"))
def first_ts_by_node(spark, sf):
    return G.first_ts(adjacency(spark, sf), ["node"])


@query(
    with_(
        EDGES, "e AS (SELECT pos, pos // 500 AS win, src AS node, 1 AS bit FROM edges UNION ALL SELECT pos, pos // 500, dst, 2 FROM edges)",
        "SELECT pos, sum(CASE WHEN last = pos THEN bit ELSE 0 END)::INT AS mask FROM (SELECT pos, bit, max(pos) OVER (PARTITION BY win, node) AS last FROM e) GROUP BY pos",
    )
)
def state_write_mask(spark, sf):
    return G.write_mask(edges(spark, sf).withColumn("window", F.floor(F.col("pos") / 500))).select("pos", "mask")


@query(with_(EDGES, ADJ, "SELECT node, ts, row_number() OVER (ORDER BY node, ts) - 1 AS id FROM (SELECT DISTINCT node, ts FROM adj)"))
def dedupe_node_time(spark, sf):
    return with_position(adjacency(spark, sf).select("node", "ts").distinct(), ["node", "ts"], "id")


@query(with_(EDGES, "SELECT dst, src, min(pos) AS pos FROM edges GROUP BY dst, src"))
def dedupe_dst_edge(spark, sf):
    return G.dedupe(edges(spark, sf), ["dst", "src"]).select("dst", "src", "pos")


@query(with_(EDGES, "SELECT dst, min(pos) AS first_pos, row_number() OVER (ORDER BY min(pos)) - 1 AS id FROM edges GROUP BY dst"))
def stable_unique(spark, sf):
    return G.stable_unique(edges(spark, sf), "dst")


@query(with_(EDGES, "SELECT src AS node, count(*) AS n_gaps, round(avg(g) / 1e6, 4) AS mean_gap, round(var_pop(g / 1e6) / 1e6, 2) AS var_gap FROM (SELECT src, ts - lag(ts) OVER (PARTITION BY src ORDER BY pos) AS g FROM edges) WHERE g IS NOT NULL GROUP BY src"))
def inter_event_stats(spark, sf):
    out = G.inter_event_stats(edges(spark, sf).withColumn("ts", F.col("ts") / 1e6), "src")
    return out.select("node", "n_gaps", F.round("mean_gap", 4).alias("mean_gap"), F.round(F.col("var_gap") / 1e6, 2).alias("var_gap"))


@query(with_(EDGES, "SELECT c_custkey AS src, coalesce(max(pos), -1) AS found FROM customer LEFT JOIN edges ON src = c_custkey GROUP BY c_custkey"))
def last_match_lookup(spark, sf):
    q = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("src"))
    return G.lookup_last(edges(spark, sf), q, ["src"], "pos", "pos")


@query(with_(EDGES, "SELECT o_custkey AS src, epoch_us(o_orderdate) AS ts, coalesce(found, -1) AS found FROM orders LEFT JOIN (SELECT src, ts, max(pos) AS found FROM edges GROUP BY src, ts) ON src = o_custkey AND ts = epoch_us(o_orderdate)"))
def temporal_lookup(spark, sf):
    from ..sources.edges import micros

    q = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("src"), micros(F.col("o_orderdate")).alias("ts"))
    return G.lookup_last(edges(spark, sf), q, ["src", "ts"], "pos", "pos")


@query(with_(EDGES, 'SELECT dst AS node, (sum(count(*)) OVER (ORDER BY dst) - count(*))::BIGINT AS "begin", (sum(count(*)) OVER (ORDER BY dst))::BIGINT AS "end" FROM edges GROUP BY dst'))
def csr_offsets(spark, sf):
    return G.csr(edges(spark, sf))


@query(with_(EDGES, SNAP, "SELECT snapshot, node, (row_number() OVER (PARTITION BY snapshot ORDER BY node) - 1)::INT AS id FROM (SELECT snapshot, src AS node FROM snaps UNION SELECT snapshot, dst FROM snaps)"))
def local_node_ids(spark, sf):
    return G.local_ids(snapshots(spark, sf), "snapshot")


@query(with_(EDGES, _FEAT, "SELECT pos, a.x0 AS src_x0, b.x0 AS dst_x0 FROM edges JOIN feat a ON a.node = src JOIN feat b ON b.node = dst"))
def feature_fetch(spark, sf):
    f = features(spark, sf).select("node", "x0")
    out = G.fetch(edges(spark, sf), f.toDF("src", "src_x0"), "src")
    return G.fetch(out, f.toDF("dst", "dst_x0"), "dst").select("pos", "src_x0", "dst_x0")


@query(with_(EDGES, "SELECT c_custkey AS src, c_custkey IN (SELECT src FROM edges) AS active FROM customer"))
def membership_mask(spark, sf):
    q = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("src"))
    return G.is_member(q, edges(spark, sf), "src", "active")


@query(with_(EDGES, "b AS (SELECT pos, pos // 500 AS b, w FROM edges)", "SELECT pos FROM b JOIN (SELECT b, quantile_cont(w, 0.8) AS l FROM b GROUP BY b) q USING (b) WHERE w <= l"))
def staleness_drop(spark, sf):
    rows = edges(spark, sf).select("pos", F.floor(F.col("pos") / 500).alias("b"), "w")
    return G.staleness_drop(rows, "b", "w", 0.2).select("pos")
