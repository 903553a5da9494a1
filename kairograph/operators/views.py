"""Prepared views of a partitioned graph: what a part reads per window, in which order, and from whom."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_position
from .temporal import in_range


def event_view(edges: DataFrame, owners: DataFrame, windows: DataFrame) -> DataFrame:
    """``part, split, window, n_edges, first_pos, last_pos, n_dst``: a part's share of each window, empty ones with 0.

    ``windows`` has ``split, window, begin, end``.
    """
    own = edges.select("pos", "dst").join(owners.select(F.col("node").alias("dst"), "part"), "dst")
    held = in_range(own, windows)
    found = held.groupBy("part", "split", "window").agg(F.count("*").alias("n_edges"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count_distinct("dst").alias("n_dst"))
    every = windows.select("split", "window").crossJoin(F.broadcast(owners.select("part").distinct()))  # the result has parts x windows
    return every.select("part", "split", "window").join(found, ["part", "split", "window"], "left").fillna(0, ["n_edges", "n_dst"])


def temporal_csr(adjacency: DataFrame) -> DataFrame:
    """Adjacency with ``row``: its place when nodes are laid out one after another, each in time."""
    return with_position(adjacency, ["node", "ts", "pos", "dir"], "row")


def snapshot_csc(snapshots: DataFrame, owners: DataFrame) -> DataFrame:
    """``snapshot, part, dst, n_edges, n_remote``: columns of each part and slice, with edges from other parts' nodes."""
    own = owners.select(F.col("node").alias("dst"), "part")
    far = owners.select(F.col("node").alias("src"), F.col("part").alias("__far"))
    rows = snapshots.select("snapshot", "src", "dst").join(own, "dst").join(far, "src")
    return rows.groupBy("snapshot", "part", "dst").agg(F.count("*").alias("n_edges"), F.count_if(F.col("__far") != F.col("part")).alias("n_remote"))


def window_summary(members: DataFrame, snapshots: DataFrame, chunks: DataFrame) -> DataFrame:
    """``window, age, n_kept, n_dropped``: edges of a decayed window by age, under its chunk limits.

    ``members`` (bounded) has ``window, member, age, limit``; chunks are ranked by number.
    """
    by = snapshots.select("snapshot", "dst").join(chunks.select(F.col("node").alias("dst"), "chunk"), "dst").groupBy("snapshot", "chunk").agg(F.count("*").alias("n"))
    rows = by.join(F.broadcast(members), F.col("snapshot") == F.col("member"))
    keep = F.col("limit").isNull() | (F.col("chunk") < F.col("limit"))
    return rows.groupBy("window", "age").agg(F.sum(F.when(keep, F.col("n")).otherwise(0)).alias("n_kept"), F.sum(F.when(keep, 0).otherwise(F.col("n"))).alias("n_dropped"))


def read_layout(requests: DataFrame, placed: DataFrame) -> DataFrame:
    """``batch, node, part, loc, slot``: a batch's reads ordered by owner and row, so that each owner is asked once.

    ``requests`` has ``batch, node``; ``placed`` has ``node, part, loc``.
    """
    rows = requests.distinct().join(placed, "node")
    return rows.select("batch", "node", "part", "loc", (F.row_number().over(Window.partitionBy("batch").orderBy("part", "loc")) - 1).alias("slot"))


def heads_first(heads: DataFrame, others: DataFrame) -> DataFrame:
    """``node, is_head``: the heads, then what the others add, each once."""
    h = heads.select("node").distinct()
    return h.withColumn("is_head", F.lit(True)).union(others.select("node").distinct().join(h, "node", "left_anti").withColumn("is_head", F.lit(False)))


def state_delta(edges: DataFrame, window: str = "window") -> DataFrame:
    """``window, node, ts, pos``: each node's last event of a window, which alone writes its state."""
    ends = edges.select(window, "ts", "pos", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy(window, "node").agg(F.max_by("ts", "pos").alias("ts"), F.max("pos").alias("pos"))


def hot_refresh(delta: DataFrame, hot: DataFrame, every: int, window: str = "window") -> DataFrame:
    """``flush, node, ts, pos``: the newest delta of hot nodes in each interval of ``every`` windows."""
    rows = delta.join(F.broadcast(hot.select("node")), "node", "left_semi")
    return rows.groupBy(F.floor(F.col(window) / every).alias("flush"), "node").agg(F.max_by("ts", F.struct("ts", "pos")).alias("ts"), F.max_by("pos", F.struct("ts", "pos")).alias("pos"))


def boundary_push(history: DataFrame, routes: DataFrame) -> DataFrame:
    """``to_part, node, version, value``: what owners send to the parts whose edges need a node's state."""
    return routes.select("to_part", "node").distinct().join(history, "node").select("to_part", "node", "version", "value")


def carry(now: DataFrame, before: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Each window's nodes (``by, node``) with their state of the window before; new nodes begin with zeros."""
    last = before.select((F.col(by) + 1).alias(by), "node", *columns)
    return now.select(by, "node").join(last, [by, "node"], "left").fillna(0.0, columns)


def store_append(adjacency: DataFrame, more: DataFrame) -> DataFrame:
    """A neighbour store (``node, other, pos, w``) with further rows; positions that it has are replaced."""
    return adjacency.join(more.select("pos", "node"), ["pos", "node"], "left_anti").unionByName(more)


def store_reweight(adjacency: DataFrame, weights: DataFrame, by: str) -> DataFrame:
    """A neighbour store with new weights by edge (``pos``) or neighbour (``other``); others keep theirs."""
    new = weights.select(by, F.col("w").alias("__w"))
    return adjacency.join(new, by, "left").withColumn("w", F.coalesce("__w", "w")).drop("__w")
