"""Prepared views, refreshes and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform01_sql
from ..operators import neighbors as N
from ..operators import partition as P
from ..operators import temporal as T
from ..operators import views as V
from ..sources.edges import random_features as features_of
from .base import ADJ, EDGES, HOT, OWNERS, SNAP, adjacency, edges, hot, nodes, owners, query, snapshots, with_
from .neighbors import _NEAR, _RANKED, _SADJ, _snapshot_adjacency
from .partition import _CHUNKS, _LOCAL, _RANKH, _chunks
from .state import _HIST, _history
from .temporal import _CUTS, _RANGES, _WINDOWS, _windows

_WIN = 'we AS (SELECT *, pos // 500 AS "window" FROM edges)'
_DELTA = 'delta AS (SELECT "window", node, max(pos) AS pos, arg_max(ts, pos) AS ts FROM (SELECT "window", src AS node, ts, pos FROM we UNION ALL SELECT "window", dst, ts, pos FROM we) GROUP BY ALL)'


def _batches(spark, sf):
    return edges(spark, sf).withColumn("window", F.floor(F.col("pos") / 500))


@query(
    with_(
        EDGES, _CUTS, _RANGES, _WINDOWS, OWNERS,
        """f AS (SELECT part, split, "window", count(*) AS n_edges, min(pos) AS first_pos, max(pos) AS last_pos, count(DISTINCT dst) AS n_dst FROM edges JOIN owners ON node = dst JOIN wins ON pos >= "begin" AND pos < "end" GROUP BY ALL)""",
        """SELECT p.part, w.split, w."window", coalesce(n_edges, 0) AS n_edges, first_pos, last_pos, coalesce(n_dst, 0) AS n_dst FROM (SELECT DISTINCT part FROM owners) p CROSS JOIN wins w LEFT JOIN f ON f.part = p.part AND f.split = w.split AND f."window" = w."window" """,
    )
)
def event_view(spark, sf):
    return V.event_view(edges(spark, sf), owners(spark, sf), _windows(spark, sf))


@query(with_(EDGES, ADJ, "SELECT node, other, pos, dir::INT AS dir, row_number() OVER (ORDER BY node, ts, pos, dir) - 1 AS \"row\" FROM adj"))
def temporal_csr(spark, sf):
    return V.temporal_csr(adjacency(spark, sf)).select("node", "other", "pos", "dir", "row")


@query(with_(EDGES, SNAP, OWNERS, "SELECT snapshot, a.part, dst, count(*) AS n_edges, count(*) FILTER (b.part <> a.part) AS n_remote FROM snaps JOIN owners a ON a.node = dst JOIN owners b ON b.node = src GROUP BY ALL"))
def snapshot_csc(spark, sf):
    return V.snapshot_csc(snapshots(spark, sf), owners(spark, sf))


@query(
    with_(
        EDGES, SNAP, OWNERS, _CHUNKS, 'm AS (SELECT w AS "window", w - a AS member, a::INT AS age, CASE WHEN a >= 1 THEN [8, 4][a::INT] END AS lim FROM (SELECT unnest(range(max(snapshot) + 1)) AS w FROM snaps) x, generate_series(0, 2) y(a) WHERE w >= a)',
        'SELECT "window", age, sum(CASE WHEN lim IS NULL OR chunk < lim THEN 1 ELSE 0 END)::BIGINT AS n_kept, sum(CASE WHEN lim IS NULL OR chunk < lim THEN 0 ELSE 1 END)::BIGINT AS n_dropped FROM m JOIN snaps ON snapshot = member JOIN chunks ON node = dst GROUP BY "window", age',
    )
)
def window_summary(spark, sf):
    s = snapshots(spark, sf)
    w = s.agg(F.max("snapshot").alias("m")).select(F.lit(0).alias("split"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("window"))
    return V.window_summary(T.decayed_window(w, 1, 2, [8, 4]), s, _chunks(spark, sf))


@query(with_(EDGES, OWNERS, HOT, _RANKH, _LOCAL, "q AS (SELECT DISTINCT pos // 5000 AS batch, dst AS node FROM edges)", "SELECT batch, q.node, part, loc, (row_number() OVER (PARTITION BY batch ORDER BY part, loc) - 1)::INT AS slot FROM q JOIN loc ON loc.node = q.node"))
def read_layout(spark, sf):
    placed = P.local_rows(owners(spark, sf), hot(spark, sf)).select("node", "part", "loc")
    return V.read_layout(edges(spark, sf).select(F.floor(F.col("pos") / 5000).alias("batch"), F.col("dst").alias("node")), placed)


@query(with_(EDGES, "SELECT DISTINCT dst AS node, true AS is_head FROM edges UNION ALL SELECT DISTINCT src, false FROM edges"))
def heads_first(spark, sf):
    e = edges(spark, sf)
    return V.heads_first(e.select(F.col("dst").alias("node")), e.select(F.col("src").alias("node")).union(e.select("dst")))


@query(with_(EDGES, _WIN, _DELTA, 'SELECT "window", node, ts, pos FROM delta'))
def state_delta(spark, sf):
    return V.state_delta(_batches(spark, sf))


@query(with_(EDGES, HOT, _WIN, _DELTA, 'SELECT "window" // 4 AS flush, node, max(ts) AS ts, max(struct_pack(t := ts, p := pos)).p AS pos FROM delta WHERE node IN (SELECT node FROM hot) GROUP BY 1, 2'))
def hot_refresh(spark, sf):
    return V.hot_refresh(V.state_delta(_batches(spark, sf)), hot(spark, sf), 4)


@query(with_(EDGES, SNAP, OWNERS, _HIST, "r AS (SELECT DISTINCT b.part AS to_part, src AS node FROM snaps JOIN owners a ON a.node = src JOIN owners b ON b.node = dst WHERE a.part <> b.part)", "SELECT to_part, r.node, version, value FROM r JOIN hist ON hist.node = r.node"))
def boundary_push(spark, sf):
    routes = P.exchange_route(snapshots(spark, sf), owners(spark, sf), "snapshot")
    return V.boundary_push(_history(spark, sf), routes)


@query(with_(EDGES, SNAP, "a AS (SELECT snapshot, src AS node, sum(w) AS s0 FROM snaps GROUP BY ALL)", "SELECT b.snapshot, b.node, coalesce(a.s0, 0) AS s0 FROM a b LEFT JOIN a ON a.node = b.node AND a.snapshot = b.snapshot - 1"))
def carry_alignment(spark, sf):
    state = snapshots(spark, sf).groupBy("snapshot", F.col("src").alias("node")).agg(F.sum("w").alias("s0"))
    return V.carry(state.select("snapshot", "node"), state, ["s0"], "snapshot")


@query(with_(EDGES, "n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)", "SELECT node, " + ", ".join(f"round(sqrt(-2 * ln(1 - {uniform01_sql('node', str(2 * i), 7)})) * cos(6.283185307179586::DOUBLE * {uniform01_sql('node', str(2 * i + 1), 7)}), 8) AS x{i}" for i in (0, 1)) + " FROM n"))
def random_features(spark, sf):
    out = features_of(nodes(spark, sf), 2, 7)
    return out.select("node", *[F.round(F.col("feat")[i], 8).alias(f"x{i}") for i in (0, 1)])


@query(
    with_(
        EDGES, ADJ, _RANKED, "roots AS (SELECT node, max(ts) + 1 AS cutoff, count(*) AS degree FROM ranked GROUP BY node)", "hop AS (" + _NEAR.format(k=3) + ")",
        "SELECT node, ts, row_number() OVER (ORDER BY node, ts) - 1 AS id FROM (SELECT node, cutoff AS ts FROM hop UNION SELECT other, ts FROM hop)",
    )
)
def sampled_instances(spark, sf):
    a = adjacency(spark, sf)
    roots = a.groupBy("node").agg((F.max("ts") + 1).alias("cutoff"))
    return N.instances(N.expand(a, roots, [3]))


@query(
    with_(
        EDGES, SNAP, _SADJ, "sr AS (SELECT *, row_number() OVER (PARTITION BY node, snapshot ORDER BY pos, dir) AS rn, count(*) OVER (PARTITION BY node, snapshot) AS degree FROM sadj)",
        f"h AS (SELECT r.node, r.snapshot, d.draw, a.other, a.pos, a.dir FROM (SELECT DISTINCT node, snapshot, degree FROM sr) r, generate_series(0, 1) d(draw) JOIN sr a ON a.node = r.node AND a.snapshot = r.snapshot AND a.rn = CASE WHEN r.degree <= 2 THEN d.draw + 1 ELSE floor({uniform01_sql('r.node + d.draw * 1000003', 'r.snapshot', 31)} * r.degree)::BIGINT + 1 END WHERE d.draw < least(r.degree, 2))",
        "SELECT node, snapshot, draw, other, pos, dir::INT AS dir, snapshot + k AS at FROM h, generate_series(0, 2) g(k) WHERE snapshot + k <= (SELECT max(snapshot) FROM snaps)",
    )
)
def snapshot_history_k(spark, sf):
    return N.snapshot_history(_snapshot_adjacency(spark, sf), 2, 2)


_KEPT = "CASE WHEN {o} IN (SELECT node FROM hot) THEN 100.0::DOUBLE ELSE w END AS w"


@query(with_(EDGES, HOT, f"SELECT dst AS node, src AS other, pos, {_KEPT.format(o='src')} FROM edges"))
def neighbor_store(spark, sf):
    """Half of the rows, the other half appended with some given again, and hot neighbours reweighted."""
    rows = edges(spark, sf).select(F.col("dst").alias("node"), F.col("src").alias("other"), "pos", "w")
    half = rows.count() // 2
    store = V.store_append(rows.where(F.col("pos") < half + 500), rows.where(F.col("pos") >= half))
    return V.store_reweight(store, hot(spark, sf).select(F.col("node").alias("other"), F.lit(100.0).alias("w")), "other").select("node", "other", "pos", "w")
