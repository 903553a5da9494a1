"""Owners, chunks, replicas, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from ..operators import partition as P
from .base import ADJ, EDGES, HOT, OWNERS, SNAP, adjacency, edges, hot, nodes, owners, query, r6, snapshots, with_

_CHUNKS = "chunks AS (SELECT node, (node % 16)::INT AS chunk FROM owners)"
_EPART = "ep AS (SELECT edges.*, part FROM edges JOIN owners ON node = dst)"
_RANKH = "hr AS (SELECT node, row_number() OVER (ORDER BY degree DESC, node) - 1 AS place FROM hot)"
_LOCAL = "loc AS (SELECT o.node, part, coalesce(place, 50 + row_number() OVER (PARTITION BY part, place IS NULL ORDER BY o.node) - 1) AS loc, place IS NOT NULL AS is_hot FROM owners o LEFT JOIN hr ON hr.node = o.node)"


def _chunks(spark, sf):
    return nodes(spark, sf).select("node", (F.col("node") % 16).cast("int").alias("chunk"))


@query(with_(EDGES, HOT, "SELECT node, degree, (row_number() OVER (ORDER BY degree DESC, node))::INT AS place FROM hot"))
def hot_nodes(spark, sf):
    return hot(spark, sf)


@query(with_(EDGES, OWNERS, "SELECT pos, part FROM edges JOIN owners ON node = dst"))
def owner_roundrobin(spark, sf):
    return P.edge_owner(edges(spark, sf), owners(spark, sf)).select("pos", "part")


@query(with_(EDGES, OWNERS, HOT, _RANKH, _LOCAL, "SELECT node, part, loc, is_hot FROM loc"))
def local_rows(spark, sf):
    return P.local_rows(owners(spark, sf), hot(spark, sf))


@query(with_(EDGES, OWNERS, HOT, _RANKH, _LOCAL, "SELECT node, part::BIGINT * 281474976710656 + loc AS dist_index FROM loc"))
def packed_index(spark, sf):
    return P.packed(P.local_rows(owners(spark, sf), hot(spark, sf))).select("node", "dist_index")


@query(with_(EDGES, OWNERS, _EPART, "SELECT node, count(*) AS n_parts, string_agg(part::VARCHAR, ',' ORDER BY part) AS parts, count(*) > 1 AS replicated FROM (SELECT part, src AS node FROM ep UNION SELECT part, dst FROM ep) GROUP BY node"))
def replica_sets(spark, sf):
    return P.replica_sets(P.edge_owner(edges(spark, sf), owners(spark, sf)))


@query(with_(EDGES, SNAP, OWNERS, "SELECT DISTINCT snapshot, a.part AS from_part, b.part AS to_part, src AS node FROM snaps JOIN owners a ON a.node = src JOIN owners b ON b.node = dst WHERE a.part <> b.part"))
def exchange_route(spark, sf):
    return P.exchange_route(snapshots(spark, sf), owners(spark, sf), "snapshot")


@query(with_(EDGES, SNAP, OWNERS, "SELECT snapshot, sum(n)::BIGINT AS total, round(avg(n), 6) AS mean_load, round(var_pop(n), 6) AS sq_dev, round(max(n) / min(n), 6) AS max_min FROM (SELECT snapshot, part, count(*) AS n FROM snaps JOIN owners ON node = dst GROUP BY ALL) GROUP BY snapshot"))
def load_balance(spark, sf):
    out = P.load_balance(P.edge_owner(snapshots(spark, sf), owners(spark, sf)), "snapshot")
    return r6(out, "mean_load", "sq_dev", "max_min")


@query(with_(EDGES, OWNERS, _CHUNKS, "SELECT least(a.chunk, b.chunk) AS a, greatest(a.chunk, b.chunk) AS b, count(*) AS n FROM edges JOIN chunks a ON a.node = src JOIN chunks b ON b.node = dst GROUP BY 1, 2"))
def chunk_affinity(spark, sf):
    return P.chunk_affinity(edges(spark, sf), _chunks(spark, sf))


@query(with_(EDGES, SNAP, OWNERS, _CHUNKS, "SELECT snapshot, chunk, count(*) AS n FROM snaps JOIN chunks ON node = dst GROUP BY ALL"))
def chunk_load(spark, sf):
    return P.chunk_load(snapshots(spark, sf), _chunks(spark, sf), "snapshot")


@query(with_(EDGES, ADJ, OWNERS, "r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, pos DESC, dir DESC) AS b FROM adj)", "SELECT o.part, count(*) FILTER (o.part = f.part) AS n_local, count(*) FILTER (o.part <> f.part) AS n_remote FROM r JOIN owners o ON o.node = r.node JOIN owners f ON f.node = r.other WHERE b <= 5 GROUP BY o.part"))
def sampling_locality(spark, sf):
    a = adjacency(spark, sf)
    roots = a.groupBy("node").agg((F.max("ts") + 1).alias("cutoff"))
    return P.locality(N.recent(a, roots, 5), owners(spark, sf))


@query(with_(EDGES, "SELECT pos, CASE WHEN dst < 10000500 THEN 0 WHEN dst < 10001000 THEN 1 ELSE 2 END AS part FROM edges"))
def range_partition_lookup(spark, sf):
    bounds = spark.createDataFrame([(0, 0, 10000500), (1, 10000500, 10001000), (2, 10001000, 1 << 60)], "part int, low long, high long")
    return P.range_part(edges(spark, sf), bounds, "dst").select("pos", "part")


@query(with_(EDGES, OWNERS, _CHUNKS, "SELECT pos FROM edges JOIN chunks ON node = dst WHERE chunk < 6"))
def chunk_filter_dst(spark, sf):
    return P.chunk_filter_dst(edges(spark, sf), _chunks(spark, sf), 6).select("pos")


@query(with_(EDGES, OWNERS, _CHUNKS, "SELECT pos FROM edges JOIN chunks a ON a.node = dst JOIN chunks b ON b.node = src WHERE a.chunk < 6 AND b.chunk < 6"))
def chunk_induced_subgraph(spark, sf):
    return P.chunk_induced(edges(spark, sf), _chunks(spark, sf), 6).select("pos")


@query(with_(EDGES, OWNERS, HOT, "SELECT part, node FROM owners UNION SELECT p::INT, node FROM hot, generate_series(0, 3) g(p) UNION SELECT part, src FROM edges JOIN owners ON node = dst"))
def feature_shards(spark, sf):
    return P.feature_rows(owners(spark, sf), hot(spark, sf), edges(spark, sf), parts=4)


@query()
def speed_partition(spark, sf):
    return P.streaming_edge_parts(edges(spark, sf), hot(spark, sf), 4)


@query()
def chunk_assignment(spark, sf):
    loads = P.chunk_load(snapshots(spark, sf), _chunks(spark, sf), "snapshot")
    tied = P.chunk_affinity(edges(spark, sf), _chunks(spark, sf))
    return spark.createDataFrame(sorted(P.assign_chunks(loads, 4, tied, 0.001).items()), "chunk int, part int")


@query()
def label_propagation_chunks(spark, sf):
    return P.label_propagation_chunks(edges(spark, sf), nodes(spark, sf), 16, 2)
