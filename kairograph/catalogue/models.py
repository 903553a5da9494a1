"""Forward passes of temporal graph models with fixed weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import metrics as R
from ..operators import models as M
from ..operators import neighbors as N
from ..operators import state as S
from .base import ADJ, CUST, EDGES, SNAP, adjacency, edges, features, query, snapshots, with_
from .graph import _DEG
from .neighbors import _NEAR, _RANKED

_FEAT = f"feat AS (SELECT node, x0 / 1000 AS x0, x1 / 10 AS x1 FROM ({CUST}))"
_DIFF = "df AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS fw, w / sum(w) OVER (PARTITION BY dst) AS bw FROM edges)"
_LAST = "roots AS (SELECT node, max(ts) + 1 AS cutoff, count(*) AS degree FROM ranked GROUP BY node)"


def _scaled(spark, sf):
    return features(spark, sf).select("node", (F.col("x0") / 1000).alias("x0"), (F.col("x1") / 10).alias("x1"))


def _vectors(spark, sf):
    return _scaled(spark, sf).select("node", F.array("x0", "x1").alias("value"))


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(with_(EDGES, _FEAT, _DIFF, "SELECT node, round(sum(x0), 7) AS x0, round(sum(x1), 7) AS x1 FROM (SELECT node, x0, x1 FROM feat UNION ALL SELECT dst, fw * x0 * 0.5, fw * x1 * 0.5 FROM df JOIN feat ON node = src UNION ALL SELECT src, bw * x0 * 0.25, bw * x1 * 0.25 FROM df JOIN feat ON node = dst) GROUP BY node"))
def diffusion_conv(spark, sf):
    return _rounded(M.diffusion_conv(G.diffusion_norm(edges(spark, sf)), _scaled(spark, sf), ["x0", "x1"], 1, [(0.5, 0.25)]), 7, "x0", "x1")


@query(with_(EDGES, _FEAT, "SELECT pos, round(a.x0 * b.x0 + a.x1 * b.x1, 11) AS score FROM edges JOIN feat a ON a.node = src JOIN feat b ON b.node = dst"))
def edge_scores(spark, sf):
    return _rounded(M.edge_scores(edges(spark, sf).select("pos", "src", "dst"), _vectors(spark, sf)), 11, "score").select("pos", "score")


@query(
    with_(
        EDGES, ADJ, _RANKED, _LAST, _FEAT, "near AS (" + _NEAR.format(k=4) + ")",
        "s AS (SELECT n.node, n.cutoff, k.x0, k.x1, (q.x0 * k.x0 + q.x1 * k.x1) / sqrt(2) AS s FROM near n JOIN feat q ON q.node = n.node JOIN feat k ON k.node = n.other)",
        "e AS (SELECT *, exp(CASE WHEN s > 0 THEN s ELSE 0.2 * s END) AS e FROM s)",
        "SELECT node, cutoff, round(sum(e * x0) / sum(e), 7) AS o0, round(sum(e * x1) / sum(e), 7) AS o1 FROM e GROUP BY node, cutoff",
    )
)
def temporal_attention(spark, sf):
    a = adjacency(spark, sf)
    near = N.recent(a, a.groupBy("node").agg((F.max("ts") + 1).alias("cutoff")), 4)
    v = _vectors(spark, sf)
    out = M.attention(near.select("node", "cutoff", "other", "pos"), v, v.withColumnRenamed("node", "other"))
    return out.select("node", "cutoff", F.round(F.col("out")[0], 7).alias("o0"), F.round(F.col("out")[1], 7).alias("o1"))


@query(with_(EDGES, ADJ, _FEAT, "l AS (SELECT node, max(ts) AS ts FROM adj GROUP BY node), m AS (SELECT max(ts) AS t FROM edges)", "SELECT f.node, round(x0 * (1 + 0.5 * (t - l.ts) / 1e12), 8) AS v0, round(x1 * (1 - 0.25 * (t - l.ts) / 1e12), 8) AS v1 FROM feat f JOIN l ON l.node = f.node, m"))
def projected_memory(spark, sf):
    last = edges(spark, sf).agg(F.max("ts")).first()[0]
    ts = G.latest(adjacency(spark, sf), ["node"], ["pos"]).select("node", "ts")
    rows = _vectors(spark, sf).join(ts, "node").withColumn("cutoff", F.lit(last))
    out = M.time_projected(rows, "cutoff", [0.5 / 1e12, -0.25 / 1e12])
    return out.select("node", F.round(F.col("value")[0], 8).alias("v0"), F.round(F.col("value")[1], 8).alias("v1"))


@query(with_(EDGES, SNAP, _DEG, "SELECT round(avg(pow(ln(1 + d.in_deg) - coalesce(ln(1 + n.in_deg), 0), 2)), 8) AS mse FROM deg d LEFT JOIN deg n ON n.node = d.node AND n.snapshot = d.snapshot + 1 WHERE d.snapshot < (SELECT max(snapshot) FROM deg)"))
def persistence_mse(spark, sf):
    rows = G.next_log_degree(G.weighted_degrees(snapshots(spark, sf), "snapshot"), "snapshot").where("label is not null")
    return _rounded(R.squared_error(rows, "x", "label"), 8, "mse")


_LINKS = "links AS MATERIALIZED (SELECT snapshot, src, dst, w / 1000 AS norm FROM snaps UNION ALL SELECT s, node, node, NULL FROM feat, (SELECT unnest(range(max(snapshot) + 1)) AS s FROM snaps))"
_ALL = "(SELECT max(snapshot) + 1 FROM snaps)"


def _links(spark, sf):
    return snapshots(spark, sf).select("snapshot", "src", "dst", (F.col("w") / 1000).alias("norm"))


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES, SNAP, _FEAT, _LINKS,
        f"""s AS (SELECT 0::BIGINT AS k, node, x1 AS x, 0.0::DOUBLE AS h FROM feat UNION ALL
        SELECT k + 1, dst, max(x) FILTER (WHERE norm IS NULL), 0.5 * max(h) FILTER (WHERE norm IS NULL) + 0.5 * tanh(coalesce(sum(norm * (h + x)), 0)) FROM s JOIN links ON snapshot = k AND src = node WHERE k < {_ALL} GROUP BY k, dst)""",
        f"SELECT node, round(h, 8) AS h FROM s WHERE k = {_ALL}",
    ).removeprefix("WITH ")
)
def coupled_scan(spark, sf):
    """All snapshots, each reading the neighbours' states after the one before."""
    out = S.coupled_states(_links(spark, sf), _scaled(spark, sf).select("node", F.col("x1").alias("x")), 0.5)
    return _rounded(out.select("node", "h"), 8, "h")


_GRU = {"z": [[0.2, -0.3, 0.4, 0.1]], "r": [[-0.1, 0.2, 0.3, 0.5]], "n": [[0.5, 0.4, -0.2, 0.6]]}


def _sql_linear(k: str, names: str) -> str:
    return "(" + " + ".join(f"{w} * {x}" for w, x in zip(_GRU[k][0], names.split(), strict=True)) + ")"


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES, SNAP, _FEAT, _LINKS,
        f"""s AS (SELECT 0::BIGINT AS k, node, x1 AS x, 0.0::DOUBLE AS h FROM feat UNION ALL
        SELECT k + 1, node, x, z * h + (1 - z) * tanh({_sql_linear("n", "x ax r ar")}) FROM (
          SELECT k, dst AS node, coalesce(sum(norm * r), 0) AS ar, max(x) FILTER (WHERE norm IS NULL) AS x, max(ax) FILTER (WHERE norm IS NULL) AS ax, max(h) FILTER (WHERE norm IS NULL) AS h, max(z) FILTER (WHERE norm IS NULL) AS z, max(r) FILTER (WHERE norm IS NULL) AS r FROM (
            SELECT k, node, x, ax, h, 1 / (1 + exp(-{_sql_linear("z", "x ax h ah")})) AS z, h / (1 + exp(-{_sql_linear("r", "x ax h ah")})) AS r FROM (
              SELECT k, dst AS node, coalesce(sum(norm * x), 0) AS ax, coalesce(sum(norm * h), 0) AS ah, max(x) FILTER (WHERE norm IS NULL) AS x, max(h) FILTER (WHERE norm IS NULL) AS h
              FROM s JOIN links ON snapshot = k AND src = node WHERE k < {_ALL} GROUP BY k, dst)) g JOIN links ON snapshot = k AND src = node GROUP BY k, dst))""",
        f"SELECT node, round(h, 8) AS h0 FROM s WHERE k = {_ALL}",
    ).removeprefix("WITH ")
)
def gconv_gru(spark, sf):
    """A graph-convolutional GRU over all snapshots."""
    nodes = _scaled(spark, sf).select("node", F.col("x1").alias("x0"))
    return _rounded(M.gconv_gru(_links(spark, sf), nodes, 1, 1, _GRU).select("node", "h0"), 8, "h0")


_TGN = {
    "wz": [[0.02, -0.03, 0.05, 0.01, 0.04, 0.1], [0.03, 0.02, -0.01, 0.04, -0.02, 0.2]], "uz": [[0.1, -0.2], [0.3, 0.1]],
    "wr": [[-0.01, 0.02, 0.03, -0.05, 0.02, 0.3], [0.02, 0.01, 0.02, 0.03, 0.01, -0.1]], "ur": [[0.2, 0.1], [-0.1, 0.3]],
    "wn": [[0.3, -0.2, 0.1, 0.2, 0.5, -0.2], [-0.1, 0.4, 0.2, -0.3, 0.6, 0.1]], "un": [[0.4, 0.1], [-0.2, 0.5]],
}
_TGN_WINDOWS, _TGN_K = 6, 4


def _sql_tgn_update() -> str:
    xs, hs = [*[f"v{i}" for i in range(5)], "dt"], ["m0", "m1"]
    dot_ = lambda ws, names: "(" + " + ".join(f"{w} * {n}" for w, n in zip(ws, names, strict=True)) + ")"
    out = []
    for i in (0, 1):
        gate = {k: f"(1 / (1 + exp(-({dot_(_TGN['w' + k][i], xs)} + {dot_(_TGN['u' + k][i], hs)}))))" for k in "zr"}
        new = f"tanh({dot_(_TGN['wn'][i], xs)} + {gate['r']} * {dot_(_TGN['un'][i], hs)})"
        out.append(f"CASE WHEN mail_ts IS NULL THEN m{i} ELSE (1 - {gate['z']}) * {new} + {gate['z']} * m{i} END AS u{i}")
    return ", ".join(out)


def _sql_tgn() -> str:
    parts = [EDGES, ADJ, _FEAT, "n AS (SELECT count(*) AS n FROM edges)", f"win AS MATERIALIZED (SELECT *, pos * {_TGN_WINDOWS} // n AS k FROM edges, n)", "mem0 AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 0::BIGINT AS ts WHERE false)", "mail0 AS (SELECT 0::BIGINT AS node, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3, 0.0::DOUBLE AS v4, 0::BIGINT AS mail_ts WHERE false)"]
    for k in range(_TGN_WINDOWS):
        parts += [
            f"up{k} AS MATERIALIZED (SELECT node, x0, x1, {_sql_tgn_update()} FROM (SELECT f.node, x0, x1, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, v0, v1, v2, v3, v4, mail_ts, coalesce((mail_ts - m.ts) / 1e13, 0) AS dt FROM feat f LEFT JOIN mem{k} m ON m.node = f.node LEFT JOIN mail{k} l ON l.node = f.node))",
            f"told{k} AS MATERIALIZED (SELECT node, ts, v FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, pos DESC) AS r FROM (SELECT src AS node, ts, pos, [a.u0, a.u1, b.u0, b.u1, w] AS v FROM win JOIN up{k} a ON a.node = src JOIN up{k} b ON b.node = dst WHERE k = {k} UNION ALL SELECT dst, ts, pos, [b.u0, b.u1, a.u0, a.u1, w] FROM win JOIN up{k} a ON a.node = src JOIN up{k} b ON b.node = dst WHERE k = {k})) WHERE r = 1)",
            f"mem{k + 1} AS MATERIALIZED (SELECT * FROM mem{k} WHERE node NOT IN (SELECT node FROM told{k}) UNION ALL SELECT t.node, u0, u1, t.ts FROM told{k} t JOIN up{k} u ON u.node = t.node)",
            f"mail{k + 1} AS MATERIALIZED (SELECT * FROM mail{k} WHERE node NOT IN (SELECT node FROM told{k}) UNION ALL SELECT node, v[1], v[2], v[3], v[4], v[5], ts FROM told{k})",
        ]
        if k >= _TGN_WINDOWS // 2:
            parts += [
                f"hid{k} AS MATERIALIZED (SELECT node, x0 + u0 AS h0, x1 + u1 AS h1 FROM up{k})",
                f"near{k} AS (SELECT node, other FROM (SELECT r.node, a.other, row_number() OVER (PARTITION BY r.node ORDER BY a.ts DESC, a.pos DESC, a.dir DESC) AS back FROM (SELECT src AS node FROM win WHERE k = {k} UNION SELECT dst FROM win WHERE k = {k}) r JOIN adj a ON a.node = r.node AND a.ts < (SELECT min(ts) FROM win WHERE k = {k})) WHERE back <= {_TGN_K})",
                f"att{k} AS (SELECT node, sum(e * k0) / sum(e) AS a0, sum(e * k1) / sum(e) AS a1 FROM (SELECT node, k0, k1, exp(CASE WHEN s > 0 THEN s ELSE 0.2 * s END) AS e FROM (SELECT n.node, b.h0 AS k0, b.h1 AS k1, (a.h0 * b.h0 + a.h1 * b.h1) / sqrt(2) AS s FROM near{k} n JOIN hid{k} a ON a.node = n.node JOIN hid{k} b ON b.node = n.other)) GROUP BY node)",
                f"z{k} AS MATERIALIZED (SELECT h.node, h0 + coalesce(a0, 0) AS z0, h1 + coalesce(a1, 0) AS z1 FROM hid{k} h LEFT JOIN att{k} a ON a.node = h.node)",
                f"sc{k} AS (SELECT pos, 1 / (1 + exp(-(a.z0 * b.z0 + a.z1 * b.z1))) AS score FROM win JOIN z{k} a ON a.node = src JOIN z{k} b ON b.node = dst WHERE k = {k})",
            ]
    return with_(*parts, " UNION ALL ".join(f"SELECT pos, round(score, 8) AS score FROM sc{k}" for k in range(_TGN_WINDOWS // 2, _TGN_WINDOWS)))


@query(_sql_tgn())
def tgn_scores(spark, sf):
    """An event model over all windows: the first half warms up the state, the second half is scored."""
    e = edges(spark, sf)
    n = e.count()
    model = M.EventModel(_scaled(spark, sf), adjacency(spark, sf), 2, _TGN, _TGN_K, 1e13)
    window = F.floor(F.col("pos") * _TGN_WINDOWS / F.lit(n))
    for k in range(_TGN_WINDOWS // 2):
        model.replay(e.where(window == k))
    scores = [model.score(e.where(window == k)) for k in range(_TGN_WINDOWS // 2, _TGN_WINDOWS)]
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    return _rounded(out, 8, "score")
