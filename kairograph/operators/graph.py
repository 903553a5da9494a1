"""Degrees, normalisations, propagation and per-key reductions over edges (``src, dst, w``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_degrees(edges: DataFrame, by: str) -> DataFrame:
    """``by, node, out_deg, in_deg``: sums of the weights' whole parts."""
    w = F.col("w").cast("bigint")
    ends = edges.select(by, F.inline(F.array(F.struct(F.col("src").alias("node"), w.alias("o"), F.lit(0).cast("bigint").alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).cast("bigint").alias("o"), w.alias("i")))))
    return ends.groupBy(by, "node").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))


def next_log_degree(degrees: DataFrame, by: str) -> DataFrame:
    """``by, node, x, label``: ln(1 + in-degree) of a snapshot, and of the next one as label.

    Nodes without edges in the next snapshot have label 0; in the last snapshot
    it is null.
    """
    last = degrees.agg(F.max(by).alias("__last"))
    ahead = degrees.select((F.col(by) - 1).alias(by), "node", F.log1p(F.col("in_deg")).alias("y"))
    out = degrees.join(ahead, [by, "node"], "left").crossJoin(F.broadcast(last))  # one row
    return out.select(by, "node", F.log1p(F.col("in_deg")).alias("x"), F.when(F.col(by) < F.col("__last"), F.coalesce("y", F.lit(0.0))).alias("label"))


def gcn_norm(edges: DataFrame, self_loops: bool = True) -> DataFrame:
    """Edges with ``norm`` = w / sqrt(out-degree of src * in-degree of dst).

    With ``self_loops`` degrees begin at 1, and every node gets an edge to itself
    of weight 1 with ``is_self``.
    """
    one = 1.0 if self_loops else 0.0
    out = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("o"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("i"))
    norm = lambda w, o, i: F.coalesce(w / F.sqrt(F.greatest(o * i, F.lit(1e-12))), F.lit(0.0))
    outs = out.select(F.col("node").alias("src"), (F.col("o") + one).alias("__o"))
    ins = into.select(F.col("node").alias("dst"), (F.col("i") + one).alias("__i"))
    real = edges.join(outs, "src").join(ins, "dst").select("src", "dst", "w", norm(F.col("w"), F.col("__o"), F.col("__i")).alias("norm"), F.lit(False).alias("is_self"))
    if not self_loops:
        return real
    nodes = out.join(into, "node", "full").select("node", (F.coalesce("o", F.lit(0.0)) + 1).alias("o"), (F.coalesce("i", F.lit(0.0)) + 1).alias("i"))
    own = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"), norm(F.lit(1.0), F.col("o"), F.col("i")).alias("norm"), F.lit(True).alias("is_self"))
    return real.union(own)


def weighted_sums(edges: DataFrame, by: str) -> DataFrame:
    """``by, node, o, i``: sums of the weights that leave and enter a node."""
    ends = edges.select(by, F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("w").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("o"), F.col("w").alias("i")))))
    return ends.groupBy(by, "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))


def gcn_norm_by(edges: DataFrame, sums: DataFrame, by: str) -> DataFrame:
    """``gcn_norm`` with self-loops of every snapshot at once; ``sums`` as of ``weighted_sums``."""
    norm = lambda w: w / F.sqrt((F.col("o") + 1) * (F.col("i") + 1))
    real = edges.join(sums.select(by, F.col("node").alias("src"), "o"), [by, "src"]).join(sums.select(by, F.col("node").alias("dst"), "i"), [by, "dst"])
    own = sums.select(by, F.col("node").alias("src"), F.col("node").alias("dst"), norm(F.lit(1.0)).alias("norm"))
    return real.select(by, "src", "dst", norm(F.col("w")).alias("norm")).unionByName(own)


def diffusion_norm(edges: DataFrame) -> DataFrame:
    """Edges with ``forward`` = w / out-weight of src and ``backward`` = w / in-weight of dst; self-loops weigh 0."""
    rows = edges.withColumn("w", F.when(F.col("src") != F.col("dst"), F.col("w")).otherwise(0.0))
    out = rows.groupBy("src").agg(F.sum("w").alias("__o"))
    into = rows.groupBy("dst").agg(F.sum("w").alias("__i"))
    share = lambda x: F.when(F.col(x) > 0, F.col("w") / F.col(x)).otherwise(0.0)
    return rows.join(out, "src").join(into, "dst").select("src", "dst", "w", share("__o").alias("forward"), share("__i").alias("backward"))


def reverse_norm(edges: DataFrame) -> DataFrame:
    """``src, norm``: one over the number of edges that leave a node."""
    return edges.groupBy("src").agg((1.0 / F.count("*")).alias("norm"))


def neighbor_mean(edges: DataFrame, features: DataFrame, columns: list[str], own: bool = False) -> DataFrame:
    """``node`` and means of the features of the sources of its edges; with ``own`` its own row counts as one more."""
    rows = edges.select("src", "dst").join(features, edges["src"] == features["node"]).select(F.col("dst").alias("node"), *columns)
    if own:
        rows = rows.unionByName(features.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").select("node", *columns))
    return rows.groupBy("node").agg(*[F.avg(x).alias(x) for x in columns])


def propagate(normed: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """``node`` and sums of the sources' features times ``norm``."""
    rows = normed.select("src", "dst", "norm").join(features.withColumnRenamed("node", "src"), "src")
    return rows.groupBy(F.col("dst").alias("node")).agg(*[F.sum(F.col("norm") * F.col(x)).alias(x) for x in columns])


def grouped_softmax(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Rows with ``share``, the softmax of the scores in their group."""
    of = Window.partitionBy(*group)
    e = F.exp(F.col(score) - F.max(score).over(of))
    return rows.withColumn("__e", e).withColumn("share", F.col("__e") / F.greatest(F.sum("__e").over(of), F.lit(1e-12))).drop("__e")


def snapshot_context(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Mean and maximum of the features of each snapshot."""
    return rows.groupBy(by).agg(*[F.avg(x).alias(f"mean_{x}") for x in columns], *[F.max(x).alias(f"max_{x}") for x in columns])


def latest(rows: DataFrame, key: list[str], value: list[str], ts: str = "ts", pos: str = "pos") -> DataFrame:
    """The values of the newest row of each key; of equal times the last position."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(ts, *value), F.struct(ts, pos)).alias("__v")).select(*key, "__v.*")


def first_ts(rows: DataFrame, key: list[str], ts: str = "ts", pos: str = "pos") -> DataFrame:
    """The time of the row with the smallest position of each key."""
    return rows.groupBy(*key).agg(F.min_by(ts, pos).alias("first_ts"))


def write_mask(edges: DataFrame, window: str = "window") -> DataFrame:
    """Edges with ``mask``: bit 0 (1) is set where the row is its source's (destination's) last in the window."""
    ends = edges.select(window, "pos", F.explode(F.array("src", "dst")).alias("node"))
    last = ends.groupBy(window, "node").agg(F.max("pos").alias("__last"))
    hits = lambda end: last.select(window, F.col("node").alias(end), F.col("__last").alias(f"__{end}"))
    bit = lambda end, b: F.when(F.col(f"__{end}") == F.col("pos"), b).otherwise(0)
    return edges.join(hits("src"), [window, "src"]).join(hits("dst"), [window, "dst"]).withColumn("mask", bit("src", 1) + bit("dst", 2)).drop("__src", "__dst")


def dedupe(rows: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")


def stable_unique(rows: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """``value, first_pos, id``: distinct values numbered by first occurrence."""
    from ..sources.tables import with_position

    return with_position(rows.groupBy(value).agg(F.min(pos).alias("first_pos")), ["first_pos"], "id")


def inter_event_stats(edges: DataFrame, end: str) -> DataFrame:
    """``node, n_gaps, mean_gap, var_gap``: times between a node's consecutive edges."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(end).orderBy("pos"))
    return edges.select(F.col(end).alias("node"), gap.alias("gap")).where("gap is not null").groupBy("node").agg(F.count("*").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.var_pop("gap").alias("var_gap"))


def lookup_last(source: DataFrame, query: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """Each query row with the value of the last source row of its key, -1 if there is none."""
    last = source.groupBy(*key).agg(F.max_by(value, pos).alias("found"))
    return query.join(last, key, "left").withColumn("found", F.coalesce("found", F.lit(-1)))


def fetch(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for all ids, repeated ids included; a missing one raises."""
    need = ids.select(key).distinct()
    if not need.join(table.select(key), key, "left_anti").isEmpty():
        raise ValueError(f"{key} not in the table")
    return ids.join(table, key)


def csr(edges: DataFrame, node: str = "dst") -> DataFrame:
    """``node, begin, end``: where each node's rows lie when edges are ordered by it."""
    from ..sources.tables import with_position

    counts = with_position(edges.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n")), ["node"], "__i")
    sums = F.sum("n").over(Window.partitionBy("__b").orderBy("__i"))
    blocked = counts.withColumn("__b", F.floor(F.col("__i") / 65536)).withColumn("__upto", sums)
    begins = blocked.groupBy("__b").agg(F.sum("n").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = blocked.join(F.broadcast(begins.select("__b", "__before")), "__b")
    return out.select("node", (F.col("__before") + F.col("__upto") - F.col("n")).cast("long").alias("begin"), (F.col("__before") + F.col("__upto")).cast("long").alias("end"))


def local_ids(edges: DataFrame, window: str, extra: DataFrame | None = None) -> DataFrame:
    """``window, node, id``: the nodes of each window (and extra ones), numbered from 0 there."""
    nodes = edges.select(window, F.explode(F.array("src", "dst")).alias("node"))
    nodes = (nodes.unionByName(extra) if extra is not None else nodes).distinct()
    return nodes.withColumn("id", F.row_number().over(Window.partitionBy(window).orderBy("node")) - 1)


def semi(rows: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Rows whose value is among the members."""
    return rows.join(members.select(column).distinct(), column, "left_semi")


def is_member(rows: DataFrame, members: DataFrame, column: str, to: str) -> DataFrame:
    """Rows with a boolean: whether the value is among the members."""
    mark = members.select(column).distinct().withColumn(to, F.lit(True))
    return rows.join(mark, column, "left").withColumn(to, F.coalesce(to, F.lit(False)))


def staleness_drop(rows: DataFrame, by: str, staleness: str, share: float) -> DataFrame:
    """Rows without the ``share`` of each window that is the most stale (above its exact percentile)."""
    limit = rows.groupBy(by).agg(F.percentile(staleness, F.lit(1 - share)).alias("__limit"))
    return rows.join(limit, by).where(F.col(staleness) <= F.col("__limit")).drop("__limit")


