"""Time-causal neighbours: recent, uniform, weighted and boundary-aware sampling, one or more hops.

``adjacency`` has ``node, other, ts, pos, dir`` and more columns; roots have
``node, cutoff``.  Only rows with ``ts < cutoff`` are neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform01
from ..sources.tables import with_position, written

#: Names under which a policy may be asked for.
POLICIES = {"recent": "recent", "recency": "recent", "uniform": "uniform", "random": "uniform", "weighted": "weighted", "boundary_recent_uniform": "boundary_recent", "boundary_uniform": "boundary_recent", "boundary_recent_decay": "boundary_decay", "snapshot_uniform": "snapshot"}


def ranked(adjacency: DataFrame, hub_safe: bool = False) -> DataFrame:
    """Adjacency with ``rn`` (1.. in time at its node) and ``before`` (rows of the node with an earlier time).

    With ``hub_safe`` positions come from one sort of the whole table by range,
    so even a node with a large share of all rows is in no single task.
    """
    if not hub_safe:
        own = Window.partitionBy("node").orderBy("ts", "pos", "dir")
        return adjacency.withColumns({"rn": F.row_number().over(own), "before": F.rank().over(Window.partitionBy("node").orderBy("ts")) - 1})
    placed = with_position(adjacency, ["node", "ts", "pos", "dir"], "__at")
    first = placed.groupBy("node").agg(F.min("__at").alias("__first"))
    times = placed.groupBy("node", "ts").agg(F.min("__at").alias("__time"))
    out = placed.join(first, "node").join(times, ["node", "ts"])
    return out.withColumns({"rn": (F.col("__at") - F.col("__first") + 1).cast("int"), "before": (F.col("__time") - F.col("__first")).cast("int")}).drop("__at", "__first", "__time")


def counted_roots(roots: DataFrame, ranks: DataFrame) -> DataFrame:
    """Roots with ``degree``, the number of neighbours before their cutoff."""
    ends = ranks.groupBy("node", "ts").agg(F.max("rn").alias("upto"))
    tagged = roots.select("node", "cutoff").distinct().select("node", F.col("cutoff").alias("ts"), F.lit(None).cast("int").alias("upto"), F.lit(0).alias("kind"))
    both = tagged.unionByName(ends.select("node", "ts", "upto", F.lit(1).alias("kind")))
    sofar = F.max("upto").over(Window.partitionBy("node").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("degree", F.coalesce(sofar, F.lit(0))).where("kind = 0").select("node", F.col("ts").alias("cutoff"), "degree")


def _ranked_between(roots: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """Neighbours with rank in (degree - k, degree], by an equi-join on blocks of ``k`` ranks."""
    blocks = roots.where("degree > 0").withColumn("__block", F.explode(F.sequence(F.floor((F.greatest(F.col("degree") - k + 1, F.lit(1)) - 1) / k), F.floor((F.col("degree") - 1) / k))))
    held = ranks.withColumn("__block", F.floor((F.col("rn") - 1) / k))
    near = (F.col("rn") <= F.col("degree")) & (F.col("rn") > F.col("degree") - k)
    return blocks.join(held, ["node", "__block"]).where(near).drop("__block")


def event_roots(ranks: DataFrame) -> DataFrame:
    """Every node at each of its own times, with ``degree``."""
    return ranks.select("node", F.col("ts").alias("cutoff"), F.col("before").alias("degree")).distinct()


def _newest_events(adjacency: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Event roots with their newest ``k`` neighbours, from one window of k rows and no join.

    The first row of a run of equal times has all earlier rows of its node, and
    only those, in front of it.
    """
    own = Window.partitionBy("node").orderBy("ts", "pos", "dir")
    newest = F.collect_list(F.struct(*columns)).over(own.rowsBetween(-k, -1))
    rows = adjacency.select("node", F.col("ts").alias("cutoff"), newest.alias("__near"), (F.row_number().over(own) - 1).alias("degree"), F.lag("ts").over(own).alias("__before"))
    rows = rows.where("degree > 0 and __before < cutoff")
    out = rows.select("node", "cutoff", "degree", F.size("__near").alias("__n"), F.posexplode("__near").alias("__i", "__e"))
    return out.select("node", "cutoff", "degree", "__e.*", (F.col("__n") - F.col("__i")).alias("back"))


def recent(adjacency: DataFrame, roots: DataFrame | None, k: int, hub_safe: bool = False) -> DataFrame:
    """The newest ``k`` neighbours of each root: root columns, ``other, ts, pos, dir, back`` (1: newest), ``delta``.

    Without ``roots``: all nodes at all of their own times.
    """
    if roots is None and not hub_safe:
        near = _newest_events(adjacency, k, ["other", "ts", "pos", "dir"])
    else:
        ranks = ranked(adjacency, hub_safe)
        roots = event_roots(ranks) if roots is None else counted_roots(roots, ranks)
        near = _ranked_between(roots, ranks, k).withColumn("back", F.col("degree") - F.col("rn") + 1)
    return near.select("node", "cutoff", "degree", "other", "ts", "pos", "dir", "back", (F.col("cutoff") - F.col("ts")).alias("delta"))


def recent_stats(adjacency: DataFrame, k: int) -> DataFrame:
    """``node, cutoff, n_neighbors, min_delta, max_delta, sum_pos`` of the newest ``k``, for all event roots.

    Aggregates over the window of ``_newest_events``: no neighbour lists are made.
    """
    own = Window.partitionBy("node").orderBy("ts", "pos", "dir")
    near, at = own.rowsBetween(-k, -1), F.col("ts")
    rows = adjacency.select("node", at.alias("cutoff"), F.count("*").over(near).alias("n_neighbors"), (at - F.max("ts").over(near)).alias("min_delta"), (at - F.min("ts").over(near)).alias("max_delta"), F.sum("pos").over(near).alias("sum_pos"), F.lag("ts").over(own).alias("__before"))
    return rows.where("__before < cutoff").drop("__before")


def uniform(adjacency: DataFrame, roots: DataFrame | None, k: int, salt: int = 17) -> DataFrame:
    """``k`` draws with replacement of each root's neighbours; all of them, once, if there are at most ``k``.

    Columns as of ``recent``, with ``draw`` in place of ``back``.
    """
    ranks = ranked(adjacency)
    roots = event_roots(ranks) if roots is None else counted_roots(roots, ranks)
    few = F.col("degree") <= k
    draws = roots.where("degree > 0").withColumn("draw", F.explode(F.sequence(F.lit(0), F.least(F.col("degree"), F.lit(k)) - 1)))
    at = F.when(few, F.col("draw") + 1).otherwise(F.floor(uniform01(F.col("node") + F.col("draw") * 1000003, F.col("cutoff"), salt) * F.col("degree")) + 1)
    return draws.withColumn("rn", at.cast("int")).join(ranks.drop("before"), ["node", "rn"]).select("node", "cutoff", "degree", "draw", "other", "ts", "pos", "dir", (F.col("cutoff") - F.col("ts")).alias("delta"))


def weighted(adjacency: DataFrame, roots: DataFrame | None, k: int, salt: int = 19) -> DataFrame:
    """``k`` draws with replacement, with probabilities as the weights ``w``, of neighbours before the cutoff only.

    A draw falls on the neighbour whose share of the node's running weight covers
    it, found by an ordered pass per node.
    """
    ranks = ranked(adjacency).withColumn("sum", F.sum("w").over(Window.partitionBy("node").orderBy("rn")))
    roots = event_roots(ranks) if roots is None else counted_roots(roots, ranks)
    total = ranks.select("node", F.col("rn").alias("degree"), F.col("sum").alias("total"))
    draws = roots.where("degree > 0").join(total, ["node", "degree"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = draws.withColumn("sum", uniform01(F.col("node") + F.col("draw") * 1000003, F.col("cutoff"), salt) * F.col("total"))
    root, hit = F.struct("cutoff", "degree", "draw"), F.struct("other", "ts", "pos", "dir")
    both = draws.select("node", "sum", root.alias("root"), F.lit(None).cast(ranks.select(hit).schema[0].dataType).alias("hit"))
    both = both.unionByName(ranks.select("node", "sum", F.lit(None).cast(both.schema["root"].dataType).alias("root"), hit.alias("hit")))
    # The first neighbour whose running weight is over the draw.
    next_hit = F.first("hit", ignorenulls=True).over(Window.partitionBy("node").orderBy("sum", F.col("hit").isNotNull().desc(), F.col("hit.pos"), F.col("hit.dir")).rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("hit", next_hit).where("root is not null").select("node", "root.*", "hit.*")


def _twice(adjacency: DataFrame, roots: DataFrame | None, k: int) -> DataFrame:
    """The newest ``2 k`` neighbours with their ``boundary``."""
    if roots is None:
        return _newest_events(adjacency, 2 * k, ["other", "ts", "pos", "dir", "boundary"])
    ranks = ranked(adjacency)
    return _ranked_between(counted_roots(roots, ranks), ranks, 2 * k).withColumn("back", F.col("degree") - F.col("rn") + 1)


def boundary_recent(adjacency: DataFrame, roots: DataFrame | None, k: int, keep: float, salt: int = 23) -> DataFrame:
    """The newest ``k`` of the ``2 k`` newest neighbours, of which boundary rows stay with probability ``keep`` only.

    ``adjacency`` has a boolean ``boundary``.
    """
    near = _twice(adjacency, roots, k)
    stay = ~F.col("boundary") | (uniform01(F.col("node") + F.col("pos") * 31, F.col("cutoff"), salt) < keep)
    order = Window.partitionBy("node", "cutoff").orderBy("back")
    return near.where(stay).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("node", "cutoff", "other", "ts", "pos", "dir", "boundary", "back", "place")


def boundary_decay(adjacency: DataFrame, roots: DataFrame | None, k: int, keep: float, salt: int = 29) -> DataFrame:
    """As ``boundary_recent``, but boundary rows among the newest ``k`` stay by their age, later ones never.

    A boundary row of age a gets e = exp(-a / s), with s the newest row's age
    times ``k``, and stays with probability keep * n * e / sum of e.
    """
    near = _twice(adjacency, roots, k)
    of = Window.partitionBy("node", "cutoff")
    scale = (F.col("cutoff") - F.max("ts").over(of)) * F.lit(k)
    e = F.exp((F.col("ts") - F.col("cutoff")) / scale.cast("double"))
    edge = F.col("boundary") & (F.col("back") <= k)
    near = near.withColumn("e", F.when(edge, e)).withColumns({"total": F.sum("e").over(of), "n": F.count("e").over(of)})
    chance = F.when(F.col("total") < 1e-6, F.lit(1.0)).otherwise(keep * F.col("n") * F.col("e") / F.col("total"))
    stay = ~F.col("boundary") | ((F.col("back") <= k) & (uniform01(F.col("node") + F.col("pos") * 31, F.col("cutoff"), salt) < chance))
    order = of.orderBy("back")
    return near.where(stay).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("node", "cutoff", "other", "ts", "pos", "dir", "boundary", "back", "place")


def snapshot_uniform(adjacency: DataFrame, k: int, salt: int = 31) -> DataFrame:
    """``k`` draws with replacement in each (node, snapshot); all rows, once, if there are at most ``k``."""
    of = Window.partitionBy("node", "snapshot")
    rows = adjacency.withColumns({"rn": F.row_number().over(of.orderBy("pos", "dir")), "degree": F.count("*").over(of)})
    roots = rows.select("node", "snapshot", "degree").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("degree"), F.lit(k)) - 1)))
    at = F.when(F.col("degree") <= k, F.col("draw") + 1).otherwise(F.floor(uniform01(F.col("node") + F.col("draw") * 1000003, F.col("snapshot"), salt) * F.col("degree")) + 1)
    return roots.withColumn("rn", at.cast("int")).join(rows.select("node", "snapshot", "rn", "other", "pos", "dir"), ["node", "snapshot", "rn"]).select("node", "snapshot", "draw", "other", "pos", "dir")


def snapshot_history(adjacency: DataFrame, k: int, history: int) -> DataFrame:
    """``snapshot_uniform`` of each snapshot and the ``history`` ones before it, as ``at``."""
    found = snapshot_uniform(adjacency, k)
    last = adjacency.agg(F.max("snapshot")).first()[0] or 0
    ahead = F.sequence(F.col("snapshot"), F.least(F.col("snapshot") + history, F.lit(last)))
    return found.withColumn("at", F.explode(ahead))


def static_sample(adjacency: DataFrame, k: int, salt: int = 37) -> DataFrame:
    """``k`` distinct neighbours of each node without regard to time, those with the least hashes."""
    pairs = adjacency.select("node", "other").distinct().withColumn("h", uniform01(F.col("node"), F.col("other"), salt))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("h", "other"))).where(F.col("place") <= k).select("node", "other", "place")


def expand(adjacency: DataFrame, roots: DataFrame, fanouts: list[int]) -> DataFrame:
    """Hops: ``layer, node, cutoff, other, ts, pos``.  The next layer's roots are the neighbours at their edges' times.

    The adjacency's ranks and each layer are written once, so that no layer
    works out those before it again.
    """
    ranks = written(ranked(adjacency), "ranks")
    out, frontier = None, roots
    for layer, k in enumerate(fanouts):
        near = _ranked_between(counted_roots(frontier, ranks), ranks, k)
        hop = written(near.select(F.lit(layer).alias("layer"), "node", "cutoff", "other", "ts", "pos", "dir"), "hop")
        out = hop if out is None else out.unionByName(hop)
        frontier = hop.select(F.col("other").alias("node"), F.col("ts").alias("cutoff")).distinct()
    return out


def instances(hops: DataFrame) -> DataFrame:
    """``node, ts, id``: distinct (node, time) pairs that take part in a layer set, numbered from 0."""
    pairs = hops.select("node", F.col("cutoff").alias("ts")).union(hops.select("other", "ts")).distinct()
    return with_position(pairs, ["node", "ts"], "id")
