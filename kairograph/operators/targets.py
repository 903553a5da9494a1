"""Prediction targets with negative samples, drawn by hash so that any engine repeats them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash31, uniform01
from ..sources.tables import with_position


@dataclass(frozen=True)
class NegativePolicy:
    """Negatives for each positive, and the share that comes of all destinations rather than local ones."""

    per_positive: int = 1
    global_share: float = 0.1

    @staticmethod
    def of(phase: str) -> NegativePolicy:
        """Training draws a tenth from all destinations; evaluation draws all from there."""
        return NegativePolicy(1, 0.1) if phase == "train" else NegativePolicy(1, 1.0)


def pool(nodes: DataFrame) -> DataFrame:
    """``node, idx``: distinct nodes, numbered from 0 in order."""
    return with_position(nodes.select("node").distinct(), ["node"], "idx")


def local_pool(edges: DataFrame, part: int, hot: DataFrame | None = None) -> DataFrame:
    """Destinations that a part owns, and hot nodes that are destinations anywhere."""
    every = edges.select(F.col("dst").alias("node")).distinct()
    own = edges.where(F.col("part") == part).select(F.col("dst").alias("node")).distinct()
    return own if hot is None else own.union(every.join(hot.select("node"), "node", "left_semi")).distinct()


def remote_pool(edges: DataFrame, part: int) -> DataFrame:
    """Destinations that the part doesn't own."""
    every = edges.select(F.col("dst").alias("node")).distinct()
    return every.join(local_pool(edges, part), "node", "left_anti")


def mixed_negatives(positives: DataFrame, local: DataFrame, everywhere: DataFrame, policy: NegativePolicy, salt: int = 3) -> DataFrame:
    """``pos, neg_idx, branch, node, weight``: negatives of each positive.

    A coin picks the branch (1: all destinations), another hash the pool's
    member.  Weights undo the branches' different chances: they are the inverse
    of the share of the draw's branch, scaled to a mean of 1 over both.
    """
    sizes = local.agg(F.count("*").alias("n")).withColumn("branch", F.lit(0)).union(everywhere.agg(F.count("*").alias("n")).withColumn("branch", F.lit(1)))
    draws = positives.select("pos", F.explode(F.sequence(F.lit(0), F.lit(policy.per_positive - 1))).alias("neg_idx"))
    draws = draws.withColumn("branch", F.when(uniform01(F.col("pos"), F.col("neg_idx"), salt) < policy.global_share, 1).otherwise(0))
    draws = draws.join(F.broadcast(sizes), "branch").withColumn("idx", F.pmod(hash31(F.col("pos"), F.col("neg_idx"), salt + 1), F.col("n")))
    members = local.select("node", "idx", F.lit(0).alias("branch")).union(everywhere.select("node", "idx", F.lit(1).alias("branch")))
    share = F.when(F.col("branch") == 1, policy.global_share).otherwise(1 - policy.global_share)
    return draws.join(members, ["branch", "idx"]).select("pos", "neg_idx", "branch", "node", (0.5 / share).alias("weight"))


def pool_weights(weights: dict[str, float]) -> dict[str, float]:
    """Weights of branches as shares of their sum."""
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    return {k: v / total for k, v in weights.items()}


def downsample_positives(edges: DataFrame, owners: DataFrame, hot: DataFrame, keep: float, salt: int = 5) -> DataFrame:
    """Edges between parts stay with probability ``keep`` unless an end is hot; others all stay."""
    own = lambda end: owners.select(F.col("node").alias(end), F.col("part").alias(f"__{end}"))
    warm = lambda end: hot.select(F.col("node").alias(end), F.lit(True).alias(f"__hot_{end}"))
    rows = edges.join(own("src"), "src").join(own("dst"), "dst").join(F.broadcast(warm("src")), "src", "left").join(F.broadcast(warm("dst")), "dst", "left")
    remote = (F.col("__src") != F.col("__dst")) & F.col("__hot_src").isNull() & F.col("__hot_dst").isNull()
    return rows.where(~remote | (uniform01(F.col("pos"), 0, salt) < keep)).drop("__src", "__dst", "__hot_src", "__hot_dst")


def target_rows(edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """``pos, role, node, cutoff, neg_idx``: end points of positives and their negatives, at the positive's time."""
    ends = edges.select("pos", F.inline(F.array(F.struct(F.lit("src").alias("role"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("role"), F.col("dst").alias("node")))), F.col("ts").alias("cutoff"), F.lit(None).cast("int").alias("neg_idx"))
    neg = negatives.join(edges.select("pos", F.col("ts").alias("cutoff")), "pos").select("pos", F.lit("neg").alias("role"), "node", "cutoff", "neg_idx")
    return ends.unionByName(neg)


def roots_of(targets: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """``node, cutoff``: distinct sampling roots of targets, and of a window's events for node tasks."""
    out = targets.select("node", "cutoff")
    if events is not None:
        out = out.union(events.select(F.explode(F.array("src", "dst")).alias("node"), F.col("ts").alias("cutoff")))
    return out.distinct()


def collect_endpoints(targets: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """Targets (``src, dst``) with both ends' values; a missing end raises."""
    ends = targets.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if not ends.join(values.select("node"), "node", "left_anti").isEmpty():
        raise ValueError("an end point has no value")
    at = lambda end: values.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    return targets.join(at("src"), "src").join(at("dst"), "dst")
