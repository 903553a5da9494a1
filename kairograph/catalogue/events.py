"""Event windows in batch, and the same through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import delete_at_exit, new_path
from ..streaming import events as S
from .base import events, query

_TUMBLE = "SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start, event_type, count(*) AS n, sum(round(value * 10000)::BIGINT)::BIGINT AS total FROM events GROUP BY 1, 2"
_SESSION = "s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)"
_LATEST = "SELECT user_id AS node, epoch_us(max(ts)) AS ts, max(struct_pack(t := ts, i := event_id, v := value)).v AS value FROM events GROUP BY user_id"
_RECENT = "SELECT a.user_id AS node, epoch_us(a.ts) AS cutoff, least(count(b.event_id), 3) AS n, coalesce(list_sum(list_sort(list(struct_pack(t := b.ts, i := b.event_id)) FILTER (b.event_id IS NOT NULL), 'DESC')[1:3].list_transform(lambda x: x.i)), 0)::BIGINT AS sum_id FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.ts < a.ts GROUP BY a.event_id, a.user_id, a.ts"


@query(_TUMBLE)
def events_tumbling(spark, sf):
    return S.tumbling(events(spark, sf), "6 hours")


@query("SELECT epoch_us(time_bucket(INTERVAL '3 hours', ts) - k * INTERVAL '3 hours') AS start, event_type, count(*) AS n, sum(round(value * 10000)::BIGINT)::BIGINT AS total FROM events, generate_series(0, 1) g(k) GROUP BY 1, 2")
def events_sliding(spark, sf):
    return S.sliding(events(spark, sf), "6 hours", "3 hours")


@query("WITH " + _SESSION + " SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS stop, count(*) AS n FROM g GROUP BY user_id, k")
def events_session(spark, sf):
    return S.sessions(events(spark, sf), "2 hours")


def _drain(spark, stream, mode):
    at = new_path(spark, "stream")
    rows = S.drained(stream, f"{at}/rows", f"{at}/checkpoint", mode)
    delete_at_exit(spark, at)
    return rows


@query(_TUMBLE)
def stream_tumbling(spark, sf):
    """The last value of each window that the stream wrote."""
    rows = _drain(spark, S.tumbling(S.read_events(spark, sf), "6 hours", "1 day"), "update")
    return rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v")).select("start", "event_type", "v.*")


@query(_LATEST)
def stream_latest_state(spark, sf):
    rows = _drain(spark, S.latest_state(S.read_events(spark, sf)), "update")
    return rows.groupBy("node").agg(F.max_by(F.struct("ts", "value"), "batch").alias("v")).select("node", "v.*")


@query(_RECENT)
def stream_recent_k(spark, sf):
    return _drain(spark, S.recent_neighbors(S.read_events(spark, sf), 3), "append").drop("batch")
