"""Splits, batches and range joins against plain walks over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from kairograph.operators import temporal as T
from kairograph.operators import views as V


def frame(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "pos long, ts long").repartition(2)


def ranges_of(df):
    return [(r["begin"], r["end"]) for r in df.orderBy("begin", "end").collect()]


def slow_cut(times, cut, low):
    if not low < cut < len(times):
        return max(low, min(len(times), cut))
    if times[cut - 1] != times[cut]:
        return cut
    left, right = cut, cut
    while left > low and times[left - 1] == times[cut]:
        left -= 1
    while right < len(times) and times[right] == times[cut]:
        right += 1
    if left == low:
        return right
    if right == len(times) or cut - left <= right - cut:
        return left
    return right


def slow_batches(times, batch):
    out, begin, n = [], 0, len(times)
    while begin < n:
        cut = min(begin + batch, n)
        left = right = cut
        while left > begin and cut < n and times[left - 1] == times[left]:
            left -= 1
        while right < n and times[right - 1] == times[right]:
            right += 1
        if cut == n:
            end = cut
        elif left == begin:
            end = right
        elif right == n or cut - left < right - cut:
            end = left
        else:
            end = right
        out.append((begin, end))
        begin = end
    return out


TIMES = [[0, 0, 0, 0, 1, 2, 3, 4, 5, 6], [0, 1, 2, 3, 4, 5, 6, 6, 6, 6], [7] * 10, [0, 1, 2, 2], list(range(10)), [0, 0, 1, 1, 1, 2, 2, 2, 2, 3, 3, 4, 4, 4, 5], []]


@pytest.mark.parametrize("times", TIMES, ids=str)
@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (0.1, 0.4, 0.5), (1.4, 0.3, 0.3), (1, 0, 1)])
def test_cuts_leave_runs_whole(spark, times, ratios):
    cuts = T.cut_points(len(times), ratios)
    a = slow_cut(times, cuts[1], 0)
    b = slow_cut(times, max(a, cuts[2]) if cuts[2] < a else cuts[2], a)
    got = T.split_ranges(frame(spark, times), ratios, tie_safe=True).orderBy("split").collect()
    assert [(r["begin"], r["end"]) for r in got] == [(0, a), (a, b), (b, len(times))]


def test_ratios_count_as_shares():
    assert T.cut_points(10, (1.4, 0.3, 0.3)) == T.cut_points(10, (0.7, 0.15, 0.15)) == [0, 7, 8, 10]
    with pytest.raises(ValueError):
        T.cut_points(10, (0, 0, 0))


@pytest.mark.parametrize("batch", [1, 3, 4])
def test_batches_leave_runs_whole(spark, batch):
    rng = random.Random(batch)
    for times in [*TIMES, sorted(rng.choices(range(8), k=23))]:
        assert ranges_of(T.adaptive_batches(frame(spark, times), batch)) == slow_batches(times, batch)


def test_range_joins_give_a_row_for_each_range(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i - 5, i % 2) for i in range(60)], "id long, pos long, k long")
    ranges = [(0, 10, 0), (3, 3, 0), (5, 40, 1), (39, 41, 0), (54, 90, 0), (-20, -4, 1)]
    held = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "r long, begin long, end long, k long")
    for limit in (T.BROADCAST_RANGES, 0):
        monkeypatch.setattr(T, "BROADCAST_RANGES", limit)
        got = sorted((x["pos"], x["r"]) for x in T.in_range(rows, held.drop("k")).collect())
        assert got == sorted((p - 5, i) for p in range(60) for i, (b, e, _) in enumerate(ranges) if b <= p - 5 < e)
        left = sorted(((x["pos"], x["r"]) for x in T.in_range(rows, held, by=["k"], how="left").collect()), key=str)
        found = [(p - 5, i) for p in range(60) for i, (b, e, k) in enumerate(ranges) if b <= p - 5 < e and k == p % 2]
        assert left == sorted([*found, *((p - 5, None) for p in range(60) if not any(f[0] == p - 5 for f in found))], key=str)


def test_labels_that_repeat_or_have_no_window(spark):
    labels = spark.createDataFrame([(1, 5, 0), (1, 5, 0), (2, 99, 0), (3, 1, 1), (4, -3, 0)], "node long, ts long, split int")
    windows = spark.createDataFrame([(0, 0, 4), (0, 1, 8), (0, 2, 8), (0, 3, None), (1, 0, None)], "split int, window long, end_ts long")
    got = sorted((r["node"], r["window"]) for r in T.label_windows(labels, windows).collect())
    assert got == [(1, 1), (1, 1), (2, 2), (3, None), (4, 0)]
    splits = spark.createDataFrame([(0, 0, 5), (1, 5, 9)], "split int, low long, high long")
    got = sorted((r["node"], r["split"]) for r in T.label_splits(labels.drop("split"), splits).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_no_nested_loops_over_windows(spark):
    edges = frame(spark, list(range(50))).withColumn("eid", F.col("pos")).withColumn("dst", F.col("pos") % 3)
    windows = T.batch_windows(edges, T.split_ranges(edges), 5)
    owners = spark.createDataFrame([(i, i % 2) for i in range(3)], "node long, part int")
    labels = edges.select(F.col("dst").alias("node"), "ts", (F.col("pos") % 3).cast("int").alias("split"))
    times = spark.createDataFrame([(0, 0, 20), (1, 10, 30)], "snapshot int, t0 long, t1 long")
    plans = [T.in_range(edges, windows), T.edge_targets(edges, windows), T.label_windows(labels, T.window_end_ts(edges, windows)), T.window_counts(edges, times)]
    for df in plans:
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    view = V.event_view(edges, owners, windows)._jdf.queryExecution().executedPlan().toString()
    assert view.count("NestedLoop") <= 1  # parts x windows, which is the result
