"""Event streams: file sources, watermarked windows, and keyed state that replays the batch semantics.

Late rows: a state commit rejects them, a mailbox takes them, as in the batch
operators.  Rows of equal time don't see each other: a node's rows are handled
in the order of (time, id) at each trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event types in order; a type's number is its place.
EVENT_COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of its files."""
    return spark.readStream.schema(EVENT_COLUMNS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def tumbling(events: DataFrame, length: str, delay: str | None = None) -> DataFrame:
    """``start, event_type, n, total``; with a ``delay`` the stream is watermarked."""
    return _windowed(events, F.window("ts", length), delay)


def sliding(events: DataFrame, length: str, slide: str, delay: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", length, slide), delay)


def _windowed(events: DataFrame, window, delay: str | None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("total"))
    return out.select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """``user_id, start, stop, n``: a user's events with gaps below ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("stop"), "n")


def without_repeats(events: DataFrame, delay: str) -> DataFrame:
    """Events without repeated ids inside the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def latest_state(events: DataFrame) -> DataFrame:
    """Stream of ``node, ts, value, version``: each node's newest value; older events are rejected."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, value, version = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        for t, v in zip(rows["ts"].tolist(), rows["value"].tolist(), strict=True):
            if ts is None or t >= ts:
                ts, value, version = t, v, version + 1
        state.update((ts, value, version))
        yield pd.DataFrame([(key[0], ts, value, version)], columns=["node", "ts", "value", "version"])

    rows = events.select(F.col("user_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id", "value")
    return rows.groupBy("node").applyInPandasWithState(update, "node long, ts long, value double, version long", "ts long, value double, version long", "update", GroupStateTimeout.NoTimeout)


def recent_neighbors(events: DataFrame, k: int) -> DataFrame:
    """Stream of ``node, cutoff, n, sum_id``: at each event, its user's ``k`` newest events of earlier times.

    State holds a node's newest k earlier events and those of the last time
    seen, which only later times may see.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, at = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")
        for t, i in zip(rows["ts"].tolist(), rows["event_id"].tolist(), strict=True):
            if at is None or t > at:
                seen, last, at = (seen + last)[-k:], [], t
            out.append((key[0], t, len(seen), sum(seen)))
            last.append(i)
        state.update((seen, last, at))
        yield pd.DataFrame(out, columns=["node", "cutoff", "n", "sum_id"])

    rows = events.select(F.col("user_id").alias("node"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_id")
    return rows.groupBy("node").applyInPandasWithState(update, "node long, cutoff long, n long, sum_id long", "seen array<long>, last array<long>, at long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """The rows that a stream writes until its source is exhausted, each with its ``batch``.

    ``mode`` "update" may write a key in several batches; the highest counts.
    """
    spark = stream.sparkSession

    def save(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
