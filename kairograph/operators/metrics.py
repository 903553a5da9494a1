"""Ranking, classification and regression metrics over (score or prediction, label) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import softplus

#: Score groups whose sums are carried in one window.
BLOCK = 10_000


def score_groups(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Distinct scores with ``n, pos`` and ``n_above, pos_above``: rows of higher scores.

    Running sums go over a few value blocks first and then inside each, so no
    task holds all scores.
    """
    groups = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    block = F.floor(F.col("score") * BLOCK).cast("long")
    groups = groups.withColumn("block", block)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = groups.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp")).select("block", F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("bp"))
    inside = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return groups.join(blocks, "block").select("score", "n", "pos", (F.col("bn") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("n_above"), (F.col("bp") + F.coalesce(F.sum("pos").over(inside), F.lit(0))).alias("pos_above"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row, ``auc``: chance that a positive scores above a negative, ties half; null without both labels."""
    g = score_groups(rows, score, label)
    neg = F.col("n") - F.col("pos")
    wins = F.sum(neg * (F.col("pos_above") + F.col("pos") / 2))
    return g.agg(wins.alias("w"), F.sum("pos").alias("p"), F.sum(neg).alias("q")).select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).alias("auc"))


def average_precision(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row, ``ap``: sum over distinct scores, from the highest, of gained recall times precision; null without both labels."""
    g = score_groups(rows, score, label)
    precision = (F.col("pos_above") + F.col("pos")) / (F.col("n_above") + F.col("n"))
    out = g.agg(F.sum(F.col("pos") * precision).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    return out.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("t")), F.col("s") / F.col("p")).alias("ap"))


def confusion(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def f1_scores(matrix: DataFrame) -> DataFrame:
    """One row, ``accuracy, micro_f1, macro_f1``; macro over classes with a row or a prediction."""
    by = matrix.select(F.inline(F.array(F.struct(F.col("truth").alias("k"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")), F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))))
    classes = by.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return classes.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), (2 * F.sum("tp") / (F.sum("support") + F.sum("predicted"))).alias("micro_f1"), F.avg(f1).alias("macro_f1"))


def squared_error(rows: DataFrame, pred: str, label: str) -> DataFrame:
    return rows.agg(F.avg((F.col(pred) - F.col(label)) * (F.col(pred) - F.col(label))).alias("mse"))


def bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy of a logit, stable for large ones."""
    return softplus(logit) - logit * label


def mean_bce(rows: DataFrame, logit: str, label: str, weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.agg((F.sum(w * bce(F.col(logit), F.col(label))) / F.sum(w)).alias("bce"))


def ranking_loss(rows: DataFrame, target: str, logit: str, positive: str) -> DataFrame:
    """One row: mean over targets of -log softmax of the positive among its negatives, and of the best margin."""
    of = Window.partitionBy(target)
    top = F.max(logit).over(of)
    lse = top + F.log(F.sum(F.exp(F.col(logit) - F.col("__top"))).over(of))
    per = rows.withColumn("__top", top).withColumn("__lse", lse).withColumn("__neg", F.max(F.when(~F.col(positive), F.col(logit))).over(of)).where(F.col(positive))
    return per.agg(F.avg(F.col("__lse") - F.col(logit)).alias("softmax_loss"), F.avg(F.col(logit) - F.col("__neg")).alias("margin"))


def merged(rows: DataFrame, n: str, metrics: list[str]) -> DataFrame:
    """One row: batch metrics weighted by their numbers of examples."""
    return rows.agg(F.sum(n).alias("n"), *[(F.sum(F.col(m) * F.col(n)) / F.sum(F.when(F.col(m).isNotNull(), F.col(n)))).alias(m) for m in metrics])


def lag_histogram(reads: DataFrame) -> DataFrame:
    """``lag, n``: how stale the versions are that reads get (``asked - got``); negative ones read the future."""
    return reads.groupBy((F.col("asked") - F.col("got")).alias("lag")).agg(F.count("*").alias("n"))


def worker_counters(rows: DataFrame, sums: list[str], time: str) -> DataFrame:
    """One row: counters summed, and the slowest worker's time."""
    return rows.agg(*[F.sum(x).alias(x) for x in sums], F.max(time).alias(time))


def loss_scale(rows: DataFrame, part: str) -> DataFrame:
    """``part, scale``: a part's share of all rows."""
    n = rows.groupBy(part).agg(F.count("*").alias("__n"))
    return n.select(part, (F.col("__n") / F.sum("__n").over(Window.partitionBy())).alias("scale"))
