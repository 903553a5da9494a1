"""Temporal state in batch, and model forward passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import models as M
from ..operators import state as S
from .base import ADJ, EDGES, HOT, SNAP, adjacency, edges, features, hot, in_months, order_items, query, snapshots, with_

_HALF = "half AS (SELECT count(*) // 2 AS h FROM edges)"
_LATEST = "SELECT node, ts, w AS value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, pos DESC) AS r FROM adj, half WHERE {where}) WHERE r = 1"


def _half(spark, sf):
    return edges(spark, sf).count() // 2


def _latest(spark, sf, where):
    rows = adjacency(spark, sf).where(where).withColumnRenamed("w", "value")
    return G.latest(rows, ["node"], ["value"])


@query(with_(EDGES, ADJ, _HALF, "a AS (" + _LATEST.format(where="pos < h") + ")", "b AS (" + _LATEST.format(where="pos >= h - 2000") + ")", "SELECT coalesce(a.node, b.node) AS node, CASE WHEN b.node IS NOT NULL AND (a.node IS NULL OR b.ts >= a.ts) THEN b.ts ELSE a.ts END AS ts, CASE WHEN b.node IS NOT NULL AND (a.node IS NULL OR b.ts >= a.ts) THEN b.value ELSE a.value END AS value FROM a FULL JOIN b ON a.node = b.node"))
def state_commit(spark, sf):
    h = _half(spark, sf)
    updates = adjacency(spark, sf).where(F.col("pos") >= h - 2000).select("node", "ts", "pos", F.col("w").alias("value"))
    return S.commit(_latest(spark, sf, F.col("pos") < h), updates)


@query(with_(EDGES, ADJ, HOT, _HALF, "a AS (" + _LATEST.format(where="pos < h") + ")", "b AS (" + _LATEST.format(where="node IN (SELECT node FROM hot)") + ")", "SELECT a.node, CASE WHEN b.ts > a.ts THEN b.ts ELSE a.ts END AS ts, CASE WHEN b.ts > a.ts THEN b.value ELSE a.value END AS value, CASE WHEN b.ts > a.ts THEN 'hot' ELSE 'own' END AS source FROM a LEFT JOIN b ON a.node = b.node"))
def overlay_newest(spark, sf):
    """The state of the first half, with the newest copies of hot nodes."""
    newest = G.latest(G.semi(adjacency(spark, sf), hot(spark, sf), "node").withColumnRenamed("w", "value"), ["node"], ["value"])
    return S.overlay_newest(_latest(spark, sf, F.col("pos") < _half(spark, sf)), newest)


_HIST = "hist AS (SELECT src AS node, snapshot + 1 AS version, sum(w) AS value FROM snaps GROUP BY ALL)"


def _history(spark, sf):
    return snapshots(spark, sf).groupBy(F.col("src").alias("node"), (F.col("snapshot") + 1).alias("version")).agg(F.sum("w").alias("value"))


@query(with_(EDGES, SNAP, _HIST, "o AS (SELECT node, value FROM hist WHERE version = 12)", "c AS (SELECT node, arg_max(value, version) AS value, max(version) AS cv FROM hist WHERE version <= 12 GROUP BY node)", "r AS (SELECT node, sum(value) AS value FROM hist GROUP BY node)", "SELECT c_custkey AS node, coalesce(o.value, CASE WHEN cv >= 10 THEN c.value END, r.value) AS value, CASE WHEN o.value IS NOT NULL THEN 'owner' WHEN cv >= 10 THEN 'cache' WHEN r.value IS NOT NULL THEN 'remote' ELSE 'none' END AS source FROM customer LEFT JOIN o ON o.node = c_custkey LEFT JOIN c ON c.node = c_custkey LEFT JOIN r ON r.node = c_custkey"))
def bounded_cascade(spark, sf):
    h = _history(spark, sf)
    cache = h.where("version <= 12").groupBy("node").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    remote = h.groupBy("node").agg(F.sum("value").alias("value"))
    n = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("node"))
    return S.bounded_cascade(n, h.where("version = 12").select("node", "value"), cache, remote, 12, 2)


_ASKED = "asked AS (SELECT c_custkey AS node, v AS version FROM customer, generate_series(5, 50, 15) g(v))"


def _asked(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("node"))
    return c.withColumn("version", F.explode(F.sequence(F.lit(5).cast("long"), F.lit(50).cast("long"), F.lit(15).cast("long"))))


@query(with_(EDGES, SNAP, _HIST, _ASKED, "SELECT a.node, a.version, max(h.version) AS found, arg_max(h.value, h.version) AS value FROM asked a LEFT JOIN hist h ON h.node = a.node AND h.version <= a.version GROUP BY ALL"))
def history_asof(spark, sf):
    return S.history_asof(_history(spark, sf), _asked(spark, sf))


_INC = "inc AS (SELECT node, version, value, count(*) OVER w AS n, avg(step) OVER w AS mean_inc FROM (SELECT *, (value - lag(value, 1, 0.0) OVER (PARTITION BY node ORDER BY version)) / (version - lag(version, 1, 0) OVER (PARTITION BY node ORDER BY version)) AS step FROM hist) WINDOW w AS (PARTITION BY node ORDER BY version ROWS UNBOUNDED PRECEDING))"


@query(with_(EDGES, SNAP, _HIST, _INC, "SELECT node, version, n, round(mean_inc, 9) AS mean_inc FROM inc"))
def increment_mean(spark, sf):
    return S.increments(_history(spark, sf)).withColumn("mean_inc", F.round("mean_inc", 9))


@query(with_(EDGES, SNAP, _HIST, _INC, _ASKED, "SELECT node, version, round(coalesce(value + (version - found) * mean_inc, 0), 9) AS predicted FROM (SELECT a.node, a.version, max(h.version) AS found, arg_max(h.value, h.version) AS value, arg_max(h.mean_inc, h.version) AS mean_inc FROM asked a LEFT JOIN inc h ON h.node = a.node AND h.version <= a.version GROUP BY a.node, a.version)"))
def history_predict(spark, sf):
    return S.predict(_history(spark, sf), _asked(spark, sf)).withColumn("predicted", F.round("predicted", 9))


_VECTORS = "vec AS MATERIALIZED (SELECT src AS node, snapshot + 1 AS version, sum(w) AS v0, sum(disc) * 100 AS v1, row_number() OVER (PARTITION BY src ORDER BY snapshot) AS k FROM snaps GROUP BY src, snapshot)"


def _published(moved: str, skips: int) -> str:
    """Each node's states in order, with the value last published and how many were held back since."""
    step = f"""SELECT node, k, version, v0, v1, p, CASE WHEN p THEN v0 ELSE l0 END, CASE WHEN p THEN v1 ELSE l1 END, CASE WHEN p THEN 0 ELSE held + 1 END
      FROM (SELECT *, {moved} OR held >= {skips} AS p FROM ({{rows}}))"""
    first = step.format(rows="SELECT node, k, version, v0, v1, 0.0::DOUBLE AS l0, 0.0::DOUBLE AS l1, 0 AS held FROM vec WHERE k = 1")
    more = step.format(rows="SELECT v.node, v.k, v.version, v.v0, v.v1, l0, l1, held FROM f JOIN vec v ON v.node = f.node AND v.k = f.k + 1")
    return "WITH RECURSIVE " + with_(EDGES, SNAP, _VECTORS, f"f(node, k, version, v0, v1, p, l0, l1, held) AS ({first} UNION ALL {more})", "SELECT node, version, p AS published FROM f").removeprefix("WITH ")


def _vector_history(spark, sf):
    """Sums in the order of the items' rows, as the SQL adds on one thread: a distance of just 40 turns on their last bits."""
    rows = in_months(order_items(spark, sf, F.struct("_metadata.file_name", "_metadata.row_index").alias("row")))
    rows = rows.select(F.col("src").alias("node"), (F.col("snapshot") + 1).alias("version"), "row", "w", "disc")
    upto = Window.partitionBy("node", "version").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("value", F.array(F.sum("w").over(upto), F.sum("disc").over(upto) * 100))
    return sums.groupBy("node", "version").agg(F.max_by("value", "row").alias("value"))


@query(_published("sqrt((v0 - l0) * (v0 - l0) + (v1 - l1) * (v1 - l1)) >= 40", 2))
def publish_filter(spark, sf):
    return S.refresh_admission(_vector_history(spark, sf), least_norm=40, max_skips=2)


@query(_published("1 - CASE WHEN l0 * l0 + l1 * l1 > 0 AND v0 * v0 + v1 * v1 > 0 THEN (v0 * l0 + v1 * l1) / sqrt((v0 * v0 + v1 * v1) * (l0 * l0 + l1 * l1)) ELSE 0 END > 0.01", 3))
def publish_filter_cosine(spark, sf):
    return S.refresh_admission(_vector_history(spark, sf), least_cosine=0.01, max_skips=3)


@query(with_(EDGES, "SELECT pos, src, dst, a.c_acctbal AS src_x, b.p_retailprice AS dst_x FROM edges JOIN customer a ON a.c_custkey = src JOIN part b ON 10000000 + b.p_partkey = dst"))
def endpoint_collect(spark, sf):
    from ..operators.targets import collect_endpoints

    f = features(spark, sf).select("node", F.col("x0").alias("x"))
    return collect_endpoints(edges(spark, sf).select("pos", "src", "dst"), f, ["x"])


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES, ADJ,
        "m AS MATERIALIZED (SELECT node, row_number() OVER (PARTITION BY node ORDER BY b) AS k, {'ts': ts, 'value': w} AS m FROM (SELECT *, pos // 500 AS b, row_number() OVER (PARTITION BY pos // 500, node ORDER BY ts DESC, pos DESC) AS r FROM adj) WHERE r = 1)",
        """f AS (SELECT node, k, [m] AS box FROM m WHERE k = 1 UNION ALL
        SELECT f.node, m.k, CASE WHEN len(box) < 3 THEN list_append(box, m.m) ELSE list_transform(box, lambda s, i: CASE WHEN i = list_position(list_transform(box, lambda x: x.ts), list_min(list_transform(box, lambda x: x.ts))) THEN m.m ELSE s END) END
        FROM f JOIN m ON m.node = f.node AND m.k = f.k + 1)""",
        "l AS (SELECT node, arg_max(box, k) AS box FROM f GROUP BY node)",
        "SELECT node, (i - 1)::INT AS slot, box[i].ts AS ts, box[i].value AS value FROM (SELECT node, box, unnest(range(1, len(box) + 1)) AS i FROM l)",
    ).removeprefix("WITH ")
)
def mailbox_fold(spark, sf):
    rows = adjacency(spark, sf).select("node", "ts", "pos", F.col("w").alias("value"), F.floor(F.col("pos") / 500).alias("batch"))
    return S.mailbox(rows, 3, "batch")


@query(with_(EDGES, ADJ, "m AS (SELECT node, ts, pos, w AS value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, pos DESC) AS r FROM adj) WHERE r = 1)", "d AS (SELECT *, 0 AS late FROM m UNION ALL SELECT e.dst, m.ts, m.pos, m.value, 1 FROM (SELECT DISTINCT src, dst FROM edges) e JOIN m ON m.node = e.src)", "SELECT node, ts, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts DESC, late DESC, pos DESC) AS r FROM d) WHERE r = 1"))
def mail_delivery(spark, sf):
    mails = G.latest(adjacency(spark, sf).withColumnRenamed("w", "value"), ["node"], ["pos", "value"])
    return S.deliver(edges(spark, sf).select("src", "dst").distinct(), mails)


@query(
    with_(
        EDGES, SNAP, "x AS (SELECT src AS node, snapshot, sum(w) AS x FROM snaps GROUP BY ALL)", "i AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY snapshot) AS k FROM x)",
        "SELECT a.node, a.snapshot, round(sum(b.x * (1 - 0.7310585786::DOUBLE) * pow(0.7310585786::DOUBLE, a.k - b.k)), 6) AS state FROM i a JOIN i b ON b.node = a.node AND b.k <= a.k GROUP BY a.node, a.snapshot",
    )
)
def recurrent_fold(spark, sf):
    rows = snapshots(spark, sf).groupBy(F.col("src").alias("node"), "snapshot").agg(F.sum("w").alias("x"))
    return S.recurrent_fold(rows, 0.7310585786).withColumn("state", F.round("state", 6))


_W = [[0.001, 0.02], [-0.002, 0.03]]


@query(
    with_(
        EDGES,
        """nd AS (SELECT coalesce(a.node, b.node) AS node, coalesce(o, 0) + 1 AS o, coalesce(i, 0) + 1 AS i FROM (SELECT src AS node, sum(w) AS o FROM edges GROUP BY src) a FULL JOIN (SELECT dst AS node, sum(w) AS i FROM edges GROUP BY dst) b ON a.node = b.node)""",
        "normed AS (SELECT e.src, e.dst, e.w / sqrt(a.o * b.i) AS norm FROM edges e JOIN nd a ON a.node = e.src JOIN nd b ON b.node = e.dst UNION ALL SELECT node, node, 1 / sqrt(o * i) FROM nd)",
        "feat AS (SELECT c_custkey AS node, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM customer UNION ALL SELECT 10000000 + p_partkey, p_retailprice, p_size::DOUBLE FROM part)",
        "SELECT dst AS node, round(greatest(sum(norm * (0.001 * x0 + 0.02 * x1)), 0), 5) AS h0, round(greatest(sum(norm * (-0.002 * x0 + 0.03 * x1)), 0), 5) AS h1 FROM normed JOIN feat ON feat.node = src GROUP BY dst",
    )
)
def gcn_layer(spark, sf):
    out = M.gcn_layer(G.gcn_norm(edges(spark, sf)), features(spark, sf), "x", _W)
    return out.withColumns({c: F.round(c, 5) for c in ("h0", "h1")})


_GATES = {k: [[0.1, -0.2], [0.05, 0.3]] for k in ("wz", "uz", "wr", "ur", "wn", "un")}


def _sql_gru() -> tuple[str, str]:
    def gate(k, i):
        return " + ".join([f"{_GATES[f'w{k}'][i][j]} * x{j}" for j in (0, 1)]), " + ".join([f"{_GATES[f'u{k}'][i][j]} * s{j}" for j in (0, 1)])

    def one(i):
        z, r, n = (gate(k, i) for k in "zrn")
        sig = lambda g: f"(1 / (1 + exp(-({g[0]} + {g[1]}))))"
        return f"(1 - {sig(z)}) * tanh({n[0]} + {sig(r)} * ({n[1]})) + {sig(z)} * s{i}"

    return one(0), one(1)


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES, SNAP,
        "sums AS (SELECT snapshot, node, sum(o) + 1 AS o, sum(i) + 1 AS i FROM (SELECT snapshot, src AS node, w AS o, 0 AS i FROM snaps UNION ALL SELECT snapshot, dst, 0, w FROM snaps) GROUP BY ALL)",
        "normed AS (SELECT e.snapshot, e.src, e.dst, e.w / sqrt(a.o * b.i) AS norm FROM snaps e JOIN sums a ON a.node = e.src AND a.snapshot = e.snapshot JOIN sums b ON b.node = e.dst AND b.snapshot = e.snapshot UNION ALL SELECT snapshot, node, node, 1 / sqrt(o * i) FROM sums)",
        "feat AS (SELECT c_custkey AS node, c_acctbal AS x0, c_nationkey::DOUBLE AS x1 FROM customer UNION ALL SELECT 10000000 + p_partkey, p_retailprice, p_size::DOUBLE FROM part)",
        "conv AS MATERIALIZED (SELECT snapshot, dst AS node, greatest(sum(norm * (0.001 * x0 + 0.02 * x1)), 0) AS x0, greatest(sum(norm * (-0.002 * x0 + 0.03 * x1)), 0) AS x1 FROM normed JOIN feat ON feat.node = src GROUP BY ALL)",
        f"w AS (SELECT 0::BIGINT AS k, node, 0.0::DOUBLE AS s0, 0.0::DOUBLE AS s1 FROM feat UNION ALL SELECT k + 1, node, {_sql_gru()[0]}, {_sql_gru()[1]} FROM (SELECT w.k, w.node, s0, s1, coalesce(x0, 0) AS x0, coalesce(x1, 0) AS x1 FROM w LEFT JOIN conv c ON c.snapshot = w.k AND c.node = w.node WHERE w.k <= (SELECT max(snapshot) FROM snaps)))",
        "SELECT node, CASE WHEN round(s0, 6) = 0 THEN 0 ELSE round(s0, 6) END AS s0, CASE WHEN round(s1, 6) = 0 THEN 0 ELSE round(s1, 6) END AS s1 FROM w WHERE k = (SELECT max(snapshot) + 1 FROM snaps)",
    ).removeprefix("WITH ")
)
def tgcn_scan(spark, sf):
    """All snapshots: their convolutions at once, then a GRU over each node's."""
    snaps, f = snapshots(spark, sf), features(spark, sf)
    sums = G.weighted_sums(snaps, "snapshot")
    normed = G.gcn_norm_by(snaps, sums, "snapshot")
    slim = f.select("node", *[c.alias(f"h{i}") for i, c in enumerate(M.linear([F.col("x0"), F.col("x1")], _W))])
    conv = normed.join(slim.withColumnRenamed("node", "src"), "src").groupBy("snapshot", F.col("dst").alias("node")).agg(*[F.greatest(F.sum(F.col("norm") * F.col(h)), F.lit(0.0)).alias(h) for h in ("h0", "h1")])
    out = M.tgcn_scan(conv, f.select("node"), _GATES)
    return out.withColumns({c: F.when(F.round(c, 6) == 0, 0.0).otherwise(F.round(c, 6)) for c in ("s0", "s1")})
