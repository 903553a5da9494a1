"""Splits, windows and as-of joins over positions and times of edges (``pos``, ``ts``)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIOS = (0.7, 0.15, 0.15)


#: Ranges up to which a table of them is broadcast.
BROADCAST_RANGES = 100_000


def cut_points(n: int, ratios: Sequence[float] = RATIOS) -> list[int]:
    """Positions at which the splits begin and the last ends; ratios count as shares of their sum, halves go to the even neighbour."""
    if min(ratios) < 0 or not sum(ratios) > 0:
        raise ValueError("ratios may not be negative, nor all 0")
    sums = [sum(ratios[: i + 1]) / sum(ratios) for i in range(len(ratios))]
    return [0, *(round(round(n * s, 6)) for s in sums[:-1]), n]


def split_ranges(edges: DataFrame, ratios: Sequence[float] = RATIOS, tie_safe: bool = False) -> DataFrame:
    """``split, begin, end`` row ranges by ratio; with ``tie_safe`` no time is cut.

    A cut inside a run of equal times goes to the run's nearer edge, to its begin
    if both are as near.  No cut goes back before the one before it: a run that
    reaches back to that one is left at its end, and one that reaches the
    table's end at its begin.
    """
    n = edges.count()
    cuts = cut_points(n, ratios)
    if tie_safe and n:
        inner = [c for c in cuts[1:-1] if 0 < c < n]
        times = edges.where(F.col("pos").isin(inner)).select("pos", "ts")
        runs = edges.join(F.broadcast(times.select("ts").distinct()), "ts", "left_semi").groupBy("ts").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("after"))
        run_at = {r["pos"]: (r["first"], r["after"]) for r in times.join(runs, "ts").collect()}  # one row for each cut
        for i in range(1, len(cuts) - 1):
            cuts[i] = _off_run(cuts[i], cuts[i - 1], n, run_at)
    rows = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return edges.sparkSession.createDataFrame(rows, "split int, begin long, end long")


def _off_run(cut: int, low: int, n: int, run_at: dict[int, tuple[int, int]]) -> int:
    if not low < cut < n:
        return max(low, min(n, cut))
    first, after = run_at[cut]
    if first == cut:
        return cut
    if first <= low:
        return after
    if after == n or cut - first <= after - cut:
        return first
    return after


def in_range(rows: DataFrame, ranges: DataFrame, pos: str = "pos", by: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Rows with each range ``begin <= pos < end`` (of equal ``by``) that holds them; overlapping ranges give a row for each.

    An equi-join on blocks of the ranges' mean length, so that a row meets a few
    ranges only, however many there are.  A table of up to ``BROADCAST_RANGES``
    (checked) is broadcast, a larger one is shuffled by block.
    """
    ranges = ranges.where(F.col("end") > F.col("begin"))
    many, mean = ranges.agg(F.count("*"), F.avg(F.col("end") - F.col("begin"))).first()
    size = max(1, int(mean or 1))
    block = lambda x: F.floor(x / F.lit(size)).cast("long")
    taken = {*rows.columns, *ranges.columns}
    at = next(x for x in ("__block", "__block_", "__block__") if x not in taken)
    held = ranges.withColumn(at, F.explode(F.sequence(block(F.col("begin")), block(F.col("end") - 1))))
    held = F.broadcast(held) if many <= BROADCAST_RANGES else held
    left = rows.withColumn(at, block(F.col(pos)))
    inside = (F.col("l." + pos) >= held["begin"]) & (F.col("l." + pos) < held["end"])
    for k in (at, *by):
        inside = inside & (F.col("l." + k) == held[k])
    return left.alias("l").join(held, inside, how).select("l.*", *[held[x] for x in ranges.columns if x not in by]).drop(at)


def equal_slices(n: int, count: int) -> list[tuple[int, int, int]]:
    """``count`` slices of about as many rows each."""
    cuts = [round(n * i / count) for i in range(count + 1)]
    return [(i, cuts[i], cuts[i + 1]) for i in range(count)]


def batch_windows(edges: DataFrame, ranges: DataFrame, batch: int, drop_last: bool = False) -> DataFrame:
    """``split, window, begin, end``: tumbling batches of rows inside each split."""
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("end") - F.col("begin")) / batch) - 1, F.lit(0)).cast("long"))
    out = ranges.where("end > begin").select("split", F.explode(steps).alias("window"), F.col("begin").alias("b"), F.col("end").alias("e"))
    out = out.select("split", "window", (F.col("b") + F.col("window") * batch).alias("begin"), F.least(F.col("b") + (F.col("window") + 1) * batch, F.col("e")).alias("end"))
    return out.where(F.col("end") - F.col("begin") >= batch) if drop_last else out


def adaptive_batches(edges: DataFrame, batch: int) -> DataFrame:
    """``window, begin, end``: batches of about ``batch`` rows that never cut a time.

    A cut inside a run of equal times goes to its nearer edge, to its end if both
    are as near or the run begins the batch, and to its begin if the run ends the
    table.  Only the counts of the times go to the one task that walks through
    them, a stream of (time, count).
    """
    total = edges.count()
    counts = edges.groupBy("ts").count().orderBy("ts").coalesce(1)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = at = window = 0
        for part in parts:
            out = []
            for n in part["count"].tolist():
                first, after = at, at + n
                at = after
                while after - begin >= batch:
                    cut = begin + batch
                    if cut == after or first <= begin:
                        end = after
                    elif after == total or cut - first < after - cut:
                        end = first
                    else:
                        end = after
                    out.append((window, begin, end))
                    window, begin = window + 1, end
                    if end == after:
                        break
            yield pd.DataFrame(out, columns=["window", "begin", "end"])
        if at > begin:
            yield pd.DataFrame([(window, begin, at)], columns=["window", "begin", "end"])

    return counts.mapInPandas(walk, "window long, begin long, end long")


def time_windows(edges: DataFrame, count: int, lags: int = 0, skip: int = 0) -> DataFrame:
    """``snapshot, t0, t1``: sliding windows over time.

    The time after the first ``skip`` distinct times is cut into ``count`` steps;
    window i covers steps i to i + ``lags``.
    """
    times = edges.select("ts").distinct().orderBy("ts").limit(skip + 1).agg(F.max("ts").alias("first"))
    bounds = times.crossJoin(edges.agg(F.max("ts").alias("last")))  # one row each
    step = (F.col("last") - F.col("first")) / F.lit(count)
    at = lambda i: (F.col("first") + F.floor(i * step)).cast("long")
    out = bounds.select("first", "last", F.explode(F.sequence(F.lit(0), F.lit(count - lags - 1))).alias("snapshot"))
    return out.select("snapshot", at(F.col("snapshot")).alias("t0"), (at(F.col("snapshot") + lags + 1) + F.when(F.col("snapshot") + lags + 1 == count, 1).otherwise(0)).alias("t1"))


def window_counts(edges: DataFrame, windows: DataFrame, least: int = 0) -> DataFrame:
    """``snapshot, n_edges`` of time windows, those with more than ``least`` edges."""
    held = in_range(edges.select("ts"), windows.select("snapshot", F.col("t0").alias("begin"), F.col("t1").alias("end")), "ts")
    return held.groupBy("snapshot").agg(F.count("*").alias("n_edges")).where(F.col("n_edges") > least)


def window_end_ts(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """``window columns, end_ts``: time of the window's last row, null if it has none."""
    last = edges.select((F.col("pos") + 1).alias("end"), F.col("ts").alias("end_ts"))
    return windows.join(last, "end", "left").withColumn("end_ts", F.when(F.col("end") > F.col("begin"), F.col("end_ts")))


def covered(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: whether each row lies in exactly one window (``rows``, ``in_none``, ``in_many``)."""
    n = in_range(rows.select("pos"), windows).groupBy("pos").count()
    return rows.select("pos").join(n, "pos", "left").agg(F.count("*").alias("n_rows"), F.count_if(F.col("count").isNull()).alias("in_none"), F.count_if(F.col("count") > 1).alias("in_many"))


def label_windows(labels: DataFrame, windows: DataFrame) -> DataFrame:
    """Each label with the first window of its split that ends at its time or later; late ones with the last.

    ``windows`` has ``split, window, end_ts``; those without rows (null
    ``end_ts``) are passed over.  A label of a split without any has a null
    window.  Repeated labels each keep a row.
    """
    ends = windows.where("end_ts is not null").groupBy("split", "end_ts").agg(F.min("window").alias("window"), F.max("window").alias("last"))
    before = F.lag("end_ts").over(Window.partitionBy("split").orderBy("end_ts"))
    # The first window takes all before its end too: such labels are looked up at that end.
    spans = ends.select("split", F.col("window").alias("__window"), F.coalesce(before + 1, "end_ts").alias("begin"), (F.col("end_ts") + 1).alias("end"))
    edge = ends.groupBy("split").agg(F.min("end_ts").alias("__first"), F.max("last").alias("__last"))
    rows = labels.join(F.broadcast(edge), "split", "left").withColumn("__at", F.greatest("ts", "__first"))
    out = in_range(rows, spans, "__at", by=["split"], how="left")
    return out.select(*labels.columns, F.coalesce("__window", "__last").alias("window"))


def label_splits(labels: DataFrame, ranges: DataFrame) -> DataFrame:
    """Split of each label by time: a split covers from one before its first time to its last; later splits win, else the last.

    ``ranges`` has ``split, low, high`` times, a row for each split.  Repeated
    labels each keep a row.
    """
    all_ranges = ranges.agg(F.collect_list(F.struct("split", "low", "high")).alias("__ranges"))
    inside = F.filter("__ranges", lambda r: (F.col("ts") >= r["low"] - 1) & (F.col("ts") < r["high"]))
    split = F.coalesce(F.array_max(F.transform(inside, lambda r: r["split"])), F.array_max(F.transform("__ranges", lambda r: r["split"])))
    return labels.crossJoin(F.broadcast(all_ranges)).select(*labels.columns, split.alias("split"))  # one row


def next_windows(windows: DataFrame) -> DataFrame:
    """Each window with the next one of its split, null at the split's end."""
    return windows.withColumn("target_window", F.lead("window").over(Window.partitionBy("split").orderBy("window")))


def edge_targets(edges: DataFrame, windows: DataFrame) -> DataFrame:
    """``split, window, pos, eid``: the edges of the next window of the split are a window's targets."""
    chain = next_windows(windows)
    ahead = chain.where("target_window is not null").select("split", "window", "target_window")
    bounds = windows.select("split", F.col("window").alias("target_window"), "begin", "end")
    return in_range(edges.select("pos", "eid"), ahead.join(bounds, ["split", "target_window"])).select("split", "window", "pos", "eid")


def with_horizon(windows: DataFrame, horizon: int = 1) -> DataFrame:
    """Windows with ``labelled``: the last ``horizon`` of a split have no label."""
    return windows.withColumn("labelled", F.col("window") <= F.max("window").over(Window.partitionBy("split")) - horizon)


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: Sequence[str], allow_equal: bool = True) -> DataFrame:
    """Each left row with the values of the key's newest right row not after it (before it, without ``allow_equal``).

    Both sides are merged in one ordered pass per key.  Right rows with equal
    times are ordered by their values; no match gives nulls.
    """
    mark = F.lit(0 if allow_equal else 1)
    tagged = left.select(key, at, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(F.struct(*value)).schema[0].dataType).alias("r"), (1 - mark).alias("after"))
    tagged = tagged.unionByName(right.select(key, at, F.lit(None).cast(tagged.schema["l"].dataType).alias("l"), F.struct(*value).alias("r"), mark.alias("after")))
    newest = F.last("r", ignorenulls=True).over(Window.partitionBy(key).orderBy(at, "after", "r").rowsBetween(Window.unboundedPreceding, 0))
    return tagged.withColumn("r", newest).where("l is not null").select("l.*", "r.*")


def decayed_window(windows: DataFrame, full: int, history: int, decay: Sequence[int]) -> DataFrame:
    """``split, window, member, age, limit``: a window's own snapshots and older ones, with chunks that each may keep.

    The newest ``full`` members keep all chunks (null limit); older ones keep
    ``decay`` by their age.  Members never leave the split.
    """
    ages = F.sequence(F.lit(0), F.lit(full + history - 1))
    out = windows.select("split", "window", F.explode(ages).alias("age")).withColumn("member", F.col("window") - F.col("age"))
    out = out.join(windows.select("split", F.col("window").alias("member")), ["split", "member"])
    limits = F.array(*[F.lit(x) for x in decay])
    return out.select("split", "window", "member", "age", F.when(F.col("age") >= full, F.element_at(limits, F.least(F.col("age") - full + 1, F.lit(len(decay))))).alias("limit"))


def parse_decay(text: str, history: int, chunks: int) -> list[int]:
    """Chunks kept at each age: ``half``, ``auto:<rate>`` or a list that never grows."""
    if text == "half" or text.startswith("auto:"):
        rate = 0.5 if text == "half" else float(text[5:])
        if not 0 < rate <= 1:
            raise ValueError("a decay rate lies above 0 and at most at 1")
        return [max(1, int(chunks * rate ** (i + 1))) for i in range(history)]
    kept = [int(x) for x in text.split(",")]
    if len(kept) != history or any(a < b for a, b in zip(kept, kept[1:], strict=False)) or min(kept, default=0) < 0:
        raise ValueError(f"{history} chunk counts that never grow are asked for")
    return kept


def staleness_windows(edges: DataFrame, batch: int, rate: float) -> DataFrame:
    """``window, begin, end``: batches cut where the summed staleness of their end points is over a threshold.

    An edge's staleness is the time since its end points' last edges, as a share
    of the longest.  The threshold lies ``rate`` of the way from the mean to the
    largest sum of the batches of ``batch`` rows.
    """
    own = Window.partitionBy("node").orderBy("pos")
    ends = edges.select("pos", "ts", F.explode(F.array("src", "dst")).alias("node")).withColumn("gap", F.col("ts") - F.lag("ts").over(own))
    gaps = ends.groupBy("pos").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("gap"))
    sums = gaps.groupBy(F.floor(F.col("pos") / batch).alias("b")).agg(F.sum("gap").alias("s")).agg(F.avg("s"), F.max("s")).first()
    limit = (sums[0] or 0) + rate * ((sums[1] or 0) - (sums[0] or 0))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin = at = window = total = 0
        for part in parts:
            out = []
            for gap in part["gap"].tolist():
                at, total = at + 1, total + gap
                if total > limit:
                    out.append((window, begin, at))
                    begin, window, total = at, window + 1, 0
            yield pd.DataFrame(out, columns=["window", "begin", "end"])
        if at > begin:
            yield pd.DataFrame([(window, begin, at)], columns=["window", "begin", "end"])

    return gaps.orderBy("pos").select("gap").coalesce(1).mapInPandas(walk, "window long, begin long, end long")


def lag_column(column: str, partition: str, *order: str) -> Column:
    return F.lag(column).over(Window.partitionBy(partition).orderBy(*order))
