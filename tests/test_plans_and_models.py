import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.operators import graph as G
from kairograph.operators import models as M
from kairograph.operators import state as S
from kairograph.plans import plan as P


@pytest.mark.parametrize("model", sorted(P.MODELS))
def test_every_model_has_a_plan(model):
    p = P.compiled(P.Declared(model))
    assert p.kind == P.MODELS[model][0] and p.steps and model in p.explain() and json.dumps(p.as_dict())
    assert ("commit" in {s.what for s in p.steps}) == (P.MODELS[model][1] != "none")


@pytest.mark.parametrize("bad", [{"model": "x"}, {"model": "tgn", "ratios": (0.5, 0.1, 0.1)}, {"model": "tgn", "batch": 0}, {"model": "tgn", "sampling": P.Sampling("x")}, {"model": "tgcn", "sampling": P.Sampling("uniform", (2, 2))}, {"model": "tgn", "freshness": P.Freshness("soon")}])
def test_bad_declarations(bad):
    with pytest.raises(ValueError):
        P.compiled(P.Declared(**bad))


def test_json_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("MODEL_NAME", "tgat")
    d = P.from_json('{"model": "$MODEL_NAME", "batch": 7, "sampling": {"fanouts": [3, 2]}, "freshness": {"mode": "max_age", "k": 2}}')
    assert d.model == "tgat" and d.batch == 7 and d.sampling.fanouts == (3, 2) and d.freshness.k == 2
    (tmp_path / "c.json").write_text('{"model": "tgn"}')
    assert P.from_json(str(tmp_path / "c.json")).model == "tgn"
    with pytest.raises(ValueError):
        P.from_json('{"model": "tgn", "old_section": 1}')


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


GATES = {k: [[0.1 * i - 0.2, 0.3 - 0.05 * i], [0.2, -0.1 * i]] for i, k in enumerate(("wz", "uz", "wr", "ur", "wn", "un"))}


def test_gru_matches_numpy(spark):
    x, h = np.array([0.5, -1.0]), np.array([0.2, 0.7])
    g = {k: np.array(v) for k, v in GATES.items()}
    z, r = sigmoid(g["wz"] @ x + g["uz"] @ h), sigmoid(g["wr"] @ x + g["ur"] @ h)
    n = np.tanh(g["wn"] @ x + r * (g["un"] @ h))
    lit = lambda a: [F.lit(float(v)) for v in a]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(M.gru(lit(x), lit(h), GATES))]).first()
    assert list(got) == pytest.approx(((1 - z) * n + z * h).tolist())
    w = {k: [[0.1, 0.2], [0.3, -0.4]] for k in ("wi", "ui", "wf", "uf", "wg", "ug", "wo", "uo")}
    m = np.array(w["wi"])
    s = m @ x + m @ h
    c = sigmoid(s) * np.array([1.0, -1.0]) + sigmoid(s) * np.tanh(s)
    hh, cc = M.lstm(lit(x), lit(h), lit([1.0, -1.0]), w)
    row = spark.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate([*hh, *cc])]).first()
    assert list(row) == pytest.approx([*(sigmoid(s) * np.tanh(c)), *c])


def test_diffusion_matches_a_dense_random_walk(spark):
    rng = np.random.default_rng(1)
    a = rng.uniform(size=(5, 5)) * (rng.uniform(size=(5, 5)) > 0.4)
    np.fill_diagonal(a, 0)
    e = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "src long, dst long, w double")
    x = rng.standard_normal((5, 1))
    f = spark.createDataFrame([(i, float(x[i, 0])) for i in range(5)], "node long, x0 double")
    got = {r["node"]: r["x0"] for r in M.diffusion_conv(G.diffusion_norm(e), f, ["x0"], 2, [(0.5, 0.25), (0.125, 2.0)]).collect()}
    fw = a / np.where(a.sum(1, keepdims=True) > 0, a.sum(1, keepdims=True), 1)
    bw = a / np.where(a.sum(0, keepdims=True) > 0, a.sum(0, keepdims=True), 1)
    y = x + 0.5 * fw.T @ x + 0.25 * bw @ x + 0.125 * fw.T @ fw.T @ x + 2 * bw @ bw @ x
    assert [got[i] for i in range(5)] == pytest.approx(y[:, 0].tolist())


def test_attention_and_scores(spark):
    s = spark.createDataFrame([(1, 9, 2, 0), (1, 9, 3, 1)], "node long, cutoff long, other long, pos long")
    v = {1: [1.0, 0.0], 2: [2.0, 1.0], 3: [-1.0, 4.0]}
    q = spark.createDataFrame([(k, x) for k, x in v.items()], "node long, value array<double>")
    out = M.attention(s, q, q.withColumnRenamed("node", "other")).first()["out"]
    logits = np.array([2.0, -1.0]) / math.sqrt(2)
    logits = np.where(logits > 0, logits, 0.2 * logits)
    p = np.exp(logits) / np.exp(logits).sum()
    assert out == pytest.approx((p[0] * np.array(v[2]) + p[1] * np.array(v[3])).tolist())
    t = spark.createDataFrame([(2, 3)], "src long, dst long")
    assert M.edge_scores(t, q).first()["score"] == 2.0


def test_evolving_weights(spark):
    ctx = spark.createDataFrame([(0, 0.5, 1.0), (1, -0.5, 0.2)], "snapshot long, a double, b double")
    out = M.evolved_weights(ctx, "snapshot", ["a", "b"], [[1.0, 0.0], [0.0, 1.0]], GATES)
    assert set(out) == {0, 1} and out[0] != out[1] and np.array(out[1]).shape == (2, 2)


def test_coupled_scan_matches_a_loop(spark):
    snaps = [spark.createDataFrame([(0, 1, 0.5), (1, 0, 1.0)], "src long, dst long, norm double"), spark.createDataFrame([(1, 0, 2.0)], "src long, dst long, norm double")]
    nodes = spark.createDataFrame([(0, 1.0), (1, -1.0)], "node long, x double")
    h = {0: 0.0, 1: 0.0}
    x = {0: 1.0, 1: -1.0}
    for edges, state in zip(snaps, S.coupled_scan(snaps, nodes, 0.5)):
        m = {0: 0.0, 1: 0.0}
        for s, d, n in [tuple(r) for r in edges.collect()]:
            m[d] += n * (h[s] + x[s])
        h = {k: 0.5 * h[k] + 0.5 * math.tanh(m[k]) for k in h}
        assert {r["node"]: r["h"] for r in state.collect()} == pytest.approx(h)
