"""Metrics over hashed scores with ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import hash31, hash31_sql
from ..operators import metrics as M
from .base import EDGES, edges, query, r6, with_

_S = f"s AS (SELECT pos, ({hash31_sql('pos', '1', 7)} % 1000) / 1000.0::DOUBLE AS score, CASE WHEN {hash31_sql('pos', '2', 7)} % 1000 < {hash31_sql('pos', '1', 7)} % 1000 THEN 1 ELSE 0 END AS label, (pos % 3)::INT AS truth, ({hash31_sql('pos', '3', 7)} % 4)::INT AS pred FROM edges)"


def _scores(spark, sf):
    h = lambda k, n: F.pmod(hash31(F.col("pos"), k, 7), F.lit(n))
    return edges(spark, sf).select("pos", (h(1, 1000) / F.lit(1000.0)).alias("score"), F.when(h(2, 1000) < h(1, 1000), 1).otherwise(0).alias("label"), (F.col("pos") % 3).cast("int").alias("truth"), h(3, 4).cast("int").alias("pred"))


@query(with_(EDGES, _S, "g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score)", "r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) - p AS above FROM g)", "SELECT round((sum((n - p) * (above + p / 2.0)) / (sum(p) * sum(n - p)))::DOUBLE, 9) AS auc FROM r"))
def auc(spark, sf):
    return M.roc_auc(_scores(spark, sf)).select(F.round("auc", 9).alias("auc"))


@query(with_(EDGES, _S, "g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY score)", "r AS (SELECT p, (sum(p) OVER (ORDER BY score DESC))::DOUBLE / (sum(n) OVER (ORDER BY score DESC))::DOUBLE AS prec FROM g)", "SELECT round((sum(p * prec) / sum(p))::DOUBLE, 9) AS ap FROM r"))
def average_precision(spark, sf):
    return M.average_precision(_scores(spark, sf)).select(F.round("ap", 9).alias("ap"))


@query(with_(EDGES, _S, "m AS (SELECT truth, pred, count(*) AS n FROM s GROUP BY ALL)", "c AS (SELECT k, sum(tp) AS tp, sum(su) AS su, sum(pr) AS pr FROM (SELECT truth AS k, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS su, 0 AS pr FROM m UNION ALL SELECT pred, 0, 0, n FROM m) GROUP BY k)", "SELECT round((sum(tp) / sum(su))::DOUBLE, 9) AS accuracy, round((2 * sum(tp) / (sum(su) + sum(pr)))::DOUBLE, 9) AS micro_f1, round(avg((2 * tp / (su + pr))::DOUBLE), 9) AS macro_f1 FROM c"))
def confusion_f1(spark, sf):
    out = M.f1_scores(M.confusion(_scores(spark, sf)))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(with_(EDGES, _S, "SELECT round(avg((score - label) * (score - label)), 9) AS mse FROM s"))
def mse(spark, sf):
    return M.squared_error(_scores(spark, sf), "score", "label").select(F.round("mse", 9).alias("mse"))


@query(with_(EDGES, _S, "SELECT round(sum((score + 1) * (greatest(x, 0) + ln(1 + exp(-abs(x))) - x * label)) / sum(score + 1), 8) AS bce FROM (SELECT *, score * 4 - 2 AS x FROM s)"))
def bce(spark, sf):
    rows = _scores(spark, sf).withColumns({"x": F.col("score") * 4 - 2, "wt": F.col("score") + 1})
    return M.mean_bce(rows, "x", "label", "wt").select(F.round("bce", 8).alias("bce"))


@query(with_(EDGES, _S, "t AS (SELECT pos // 5 AS t, score, pos % 5 = 0 AS positive FROM s)", "u AS (SELECT t, positive, score, ln(sum(exp(score)) OVER (PARTITION BY t)) AS lse, max(CASE WHEN NOT positive THEN score END) OVER (PARTITION BY t) AS neg FROM t)", "SELECT round(avg(lse - score), 8) AS softmax_loss, round(avg(score - neg), 8) AS margin FROM u WHERE positive"))
def ranking_loss(spark, sf):
    rows = _scores(spark, sf).select(F.floor(F.col("pos") / 5).alias("t"), "score", (F.col("pos") % 5 == 0).alias("positive"))
    return r8(M.ranking_loss(rows, "t", "score", "positive"))


def r8(df):
    return df.select(*[F.round(c, 8).alias(c) for c in df.columns])


@query(with_(EDGES, _S, "b AS (SELECT pos // 500 AS b, count(*) AS n, avg(score) AS m FROM s GROUP BY 1)", "SELECT sum(n)::BIGINT AS n, round(sum(m * n) / sum(n), 8) AS m FROM b"))
def epoch_merge(spark, sf):
    batches = _scores(spark, sf).groupBy(F.floor(F.col("pos") / 500).alias("b")).agg(F.count("*").alias("n"), F.avg("score").alias("m"))
    return M.merged(batches, "n", ["m"]).select("n", F.round("m", 8).alias("m"))


@query(with_(EDGES, _S, "SELECT pred AS part, round(count(*) / sum(count(*)) OVER (), 9) AS scale FROM s GROUP BY pred"))
def loss_scale(spark, sf):
    out = M.loss_scale(_scores(spark, sf).withColumnRenamed("pred", "part"), "part")
    return out.select("part", F.round("scale", 9).alias("scale"))


@query(with_(EDGES, _S, "SELECT (truth - pred)::INT AS lag, count(*) AS n FROM s GROUP BY 1"))
def state_read_audit(spark, sf):
    return M.lag_histogram(_scores(spark, sf).select(F.col("truth").alias("asked"), F.col("pred").alias("got")))
