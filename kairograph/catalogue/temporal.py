"""Splits, windows and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as T
from .base import EDGES, edges, query, with_

BATCH = 500
_CUTS = "n AS (SELECT count(*) AS n FROM edges), cuts AS (SELECT 0 AS c0, round_even(n * 0.7, 0)::BIGINT AS c1, round_even(n * 0.85, 0)::BIGINT AS c2, n AS c3 FROM n)"
_RANGES = """ranges AS (SELECT 0 AS split, c0 AS "begin", c1 AS "end" FROM cuts UNION ALL SELECT 1, c1, c2 FROM cuts UNION ALL SELECT 2, c2, c3 FROM cuts)"""
_WINDOWS = f"""wins AS (SELECT split, k AS "window", "begin" + k * {BATCH} AS "begin", least("begin" + (k + 1) * {BATCH}, "end") AS "end"
  FROM ranges, generate_series(0, ("end" - "begin" + {BATCH} - 1) // {BATCH} - 1) g(k) WHERE "end" > "begin")"""
_ENDS = """ends AS (SELECT wins.*, e.ts AS end_ts FROM wins LEFT JOIN edges e ON e.pos = wins."end" - 1)"""


def _ranges(spark, sf):
    return T.split_ranges(edges(spark, sf))


def _windows(spark, sf):
    return T.batch_windows(edges(spark, sf), _ranges(spark, sf), BATCH)


@query(with_(EDGES, _CUTS, _RANGES, 'SELECT split, "begin", "end" FROM ranges'))
def split_ratio(spark, sf):
    return _ranges(spark, sf)


@query(
    with_(
        EDGES,
        _CUTS,
        """r1 AS (SELECT c1 AS c, (SELECT min(pos) FROM edges x WHERE x.ts = e.ts) AS a, (SELECT max(pos) + 1 FROM edges x WHERE x.ts = e.ts) AS b, n FROM cuts, n JOIN edges e ON e.pos = c1)""",
        """m1 AS (SELECT CASE WHEN a = c THEN c WHEN a <= 0 THEN b WHEN b = n THEN a WHEN c - a <= b - c THEN a ELSE b END AS c1 FROM r1)""",
        """r2 AS (SELECT c2 AS c, (SELECT min(pos) FROM edges x WHERE x.ts = e.ts) AS a, (SELECT max(pos) + 1 FROM edges x WHERE x.ts = e.ts) AS b, n, m1.c1 AS low FROM cuts, n, m1 JOIN edges e ON e.pos = c2)""",
        """m2 AS (SELECT CASE WHEN c <= low THEN low WHEN a = c THEN c WHEN a <= low THEN b WHEN b = n THEN a WHEN c - a <= b - c THEN a ELSE b END AS c2 FROM r2)""",
        """m AS (SELECT 0 AS c0, m1.c1, m2.c2, n AS c3 FROM m1, m2, n)""",
        """SELECT 0 AS split, c0 AS "begin", c1 AS "end" FROM m UNION ALL SELECT 1, c1, c2 FROM m UNION ALL SELECT 2, c2, c3 FROM m""",
    )
)
def split_tiesafe(spark, sf):
    return T.split_ranges(edges(spark, sf), tie_safe=True)


@query(with_(EDGES, _CUTS, "SELECT pos, CASE WHEN pos < c1 THEN 0 WHEN pos < c2 THEN 1 ELSE 2 END AS split FROM edges, cuts"))
def split_masks(spark, sf):
    return T.in_range(edges(spark, sf).select("pos"), _ranges(spark, sf)).select("pos", "split")


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, 'SELECT split, "window", "begin", "end" FROM wins'))
def batch_windows(spark, sf):
    return _windows(spark, sf)


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, f'SELECT split, "window", "begin", "end" FROM wins WHERE "end" - "begin" >= {BATCH}'))
def batch_windows_drop_last(spark, sf):
    return T.batch_windows(edges(spark, sf), _ranges(spark, sf), BATCH, drop_last=True)


@query(with_(EDGES, 'SELECT i AS slice, round_even(n * i / 16.0, 0)::BIGINT AS "begin", round_even(n * (i + 1) / 16.0, 0)::BIGINT AS "end" FROM (SELECT count(*) AS n FROM edges), generate_series(0, 15) g(i)'))
def equal_slices(spark, sf):
    return spark.createDataFrame(T.equal_slices(edges(spark, sf).count(), 16), "slice long, begin long, end long")


_LAGGED = """b AS (SELECT (SELECT max(ts) FROM (SELECT DISTINCT ts FROM edges ORDER BY ts LIMIT 6)) AS f, max(ts) AS l FROM edges),
w AS (SELECT i AS snapshot, (f + floor(i * ((l - f) / 12.0::DOUBLE)))::BIGINT AS t0, (f + floor((i + 3) * ((l - f) / 12.0::DOUBLE)))::BIGINT + CASE WHEN i + 3 = 12 THEN 1 ELSE 0 END AS t1 FROM b, generate_series(0, 9) g(i))"""


@query(with_(EDGES, _LAGGED, "SELECT w.snapshot::INT AS snapshot, t0, t1, count(*) AS n_edges FROM w JOIN edges ON ts >= t0 AND ts < t1 GROUP BY ALL HAVING count(*) > 50"))
def lagged_snapshots(spark, sf):
    e = edges(spark, sf)
    w = T.time_windows(e, 12, lags=2, skip=5)
    return w.join(T.window_counts(e, w, 50), "snapshot")


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, _ENDS, 'SELECT split, "window", end_ts FROM ends'))
def window_end_ts(spark, sf):
    return T.window_end_ts(edges(spark, sf), _windows(spark, sf)).select("split", "window", "end_ts")


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, 'SELECT pos, split, "window" FROM edges JOIN wins ON pos >= "begin" AND pos < "end"'))
def row_to_snapshot(spark, sf):
    return T.in_range(edges(spark, sf).select("pos"), _windows(spark, sf)).select("pos", "split", "window")


@query(with_(EDGES, "SELECT count(*) AS n_rows, 0::BIGINT AS in_none, 0::BIGINT AS in_many FROM edges"))
def window_coverage(spark, sf):
    return T.covered(edges(spark, sf), _windows(spark, sf))


_LABELS = "labels_ AS (SELECT DISTINCT o_custkey AS node, epoch_us(o_orderdate) + 43200000000 AS ts, (o_custkey % 3)::INT AS split FROM orders)"


def _labels(spark, sf, distinct=True):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    from ..sources.edges import micros

    rows = o.select(F.col("o_custkey").alias("node"), (micros(F.col("o_orderdate")) + 43200000000).alias("ts"), (F.col("o_custkey") % 3).cast("int").alias("split"))
    return rows.distinct() if distinct else rows


@query(
    with_(
        EDGES, _CUTS, _RANGES, _WINDOWS, _ENDS, _LABELS,
        """SELECT l.node, l.ts, l.split, coalesce(
          (SELECT min("window") FROM ends e WHERE e.split = l.split AND e.end_ts >= l.ts), (SELECT max("window") FROM ends e WHERE e.split = l.split)) AS "window" FROM labels_ l""",
    )
)
def label_to_window_asof(spark, sf):
    ends = T.window_end_ts(edges(spark, sf), _windows(spark, sf))
    return T.label_windows(_labels(spark, sf), ends)


_TIMES = """times AS (SELECT split, min(ts) AS low, max(ts) AS high FROM edges JOIN ranges ON pos >= "begin" AND pos < "end" GROUP BY split)"""


@query(with_(EDGES, _CUTS, _RANGES, _TIMES, _LABELS, "SELECT node, ts, coalesce((SELECT max(split) FROM times WHERE ts >= low - 1 AND ts < high), 2) AS split FROM (SELECT o_custkey AS node, epoch_us(o_orderdate) + 43200000000 AS ts FROM orders)"))
def label_split_range(spark, sf):
    times = T.in_range(edges(spark, sf), _ranges(spark, sf)).groupBy("split").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    return T.label_splits(_labels(spark, sf, distinct=False).drop("split"), times)


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, 'nxt AS (SELECT *, lead("window") OVER (PARTITION BY split ORDER BY "window") AS t FROM wins)', 'SELECT n.split, n."window", e.pos, e.pos AS eid FROM nxt n JOIN wins w ON w.split = n.split AND w."window" = n.t JOIN edges e ON e.pos >= w."begin" AND e.pos < w."end"'))
def edge_targets_next(spark, sf):
    return T.edge_targets(edges(spark, sf), _windows(spark, sf))


@query(with_(EDGES, _CUTS, _RANGES, _WINDOWS, 'SELECT split, "window", "window" <= max("window") OVER (PARTITION BY split) - 2 AS labelled FROM wins'))
def node_targets_horizon(spark, sf):
    return T.with_horizon(_windows(spark, sf), 2).select("split", "window", "labelled")


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES,
        "n AS (SELECT count(*) AS n FROM edges)",
        "r AS MATERIALIZED (SELECT pos, min(pos) OVER (PARTITION BY ts) AS a, max(pos) OVER (PARTITION BY ts) + 1 AS b FROM edges)",
        f"""w AS (SELECT -1::BIGINT AS "window", 0::BIGINT AS "begin", 0::BIGINT AS "end" UNION ALL
        SELECT "window" + 1, "end", CASE WHEN t = n OR t = b THEN t WHEN a <= "end" THEN b WHEN b = n OR t - a < b - t THEN a ELSE b END
        FROM (SELECT w.*, n, least("end" + {BATCH}, n) AS t FROM w, n WHERE "end" < n) q JOIN r ON r.pos = t - 1)""",
        'SELECT "window", "begin", "end" FROM w WHERE "window" >= 0',
    ).removeprefix("WITH ")
)
def adaptive_batches(spark, sf):
    return T.adaptive_batches(edges(spark, sf), BATCH)


@query(
    "WITH RECURSIVE "
    + with_(
        EDGES,
        "e AS (SELECT pos, ts, src AS node FROM edges UNION ALL SELECT pos, ts, dst FROM edges)",
        "g AS (SELECT pos, coalesce(max(gap), 0)::BIGINT AS gap FROM (SELECT pos, ts - lag(ts) OVER (PARTITION BY node ORDER BY pos) AS gap FROM e) GROUP BY pos)",
        f"lim AS (SELECT avg(s) + 0.5::DOUBLE * (max(s) - avg(s)) AS l FROM (SELECT sum(gap)::BIGINT AS s FROM g GROUP BY pos // {BATCH}))",
        "c AS MATERIALIZED (SELECT pos, (sum(gap) OVER (ORDER BY pos))::BIGINT AS c FROM g)",
        "n AS (SELECT count(*) AS n FROM edges)",
        """w AS (SELECT -1::BIGINT AS "window", 0::BIGINT AS "begin", 0::BIGINT AS "end", 0::BIGINT AS base UNION ALL
        SELECT "window" + 1, "end", coalesce(p, n - 1) + 1, coalesce(q, 0) FROM (
          SELECT "window", "end", n, min(c.pos) FILTER (c.c - base > l) AS p, (min(c.c) FILTER (c.c - base > l))::BIGINT AS q FROM w, n, lim, c WHERE "end" < n AND c.pos >= "end" GROUP BY ALL))""",
        'SELECT "window", "begin", "end" FROM w WHERE "window" >= 0',
    ).removeprefix("WITH ")
)
def staleness_windows(spark, sf):
    return T.staleness_windows(edges(spark, sf), BATCH, 0.5)


@query(
    with_(
        EDGES, _CUTS, _RANGES, _WINDOWS,
        """SELECT a.split, a."window", b."window" AS member, (a."window" - b."window")::INT AS age, CASE WHEN a."window" - b."window" >= 2 THEN [8, 4, 2][(a."window" - b."window" - 1)::INT] END AS "limit"
        FROM wins a JOIN wins b ON a.split = b.split AND b."window" BETWEEN a."window" - 4 AND a."window" """,
    )
)
def decayed_window(spark, sf):
    return T.decayed_window(_windows(spark, sf), full=2, history=3, decay=T.parse_decay("half", 3, 16))


@query(with_("SELECT l.user_id, l.event_id, epoch_us(l.ts) AS ts, (SELECT max(struct_pack(t := r.ts, i := event_id)).i FROM events r WHERE r.user_id = l.user_id AND r.event_type = 'purchase' AND r.ts < l.ts) AS last_purchase FROM events l WHERE l.event_type = 'view'").replace("WITH \n", ""))
def events_asof(spark, sf):
    from ..sources.edges import micros

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", micros(F.col("ts")).alias("ts"), "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return T.asof(e.where("event_type = 'view'").select("user_id", "event_id", "ts"), right, "user_id", "ts", ["last_purchase"], allow_equal=False)
