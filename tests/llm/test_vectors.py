import math

import numpy as np

from kairograph.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.standard_normal(24)
            for k in range(6):
                v = base + rng.standard_normal(24) * (0.05 + 0.08 * k)
                rows.append((n, [float(np.float32(x)) for x in v], label))
                n += 1
    dup = rows[7]
    rows += [(n, dup[1], dup[2]), (n + 1, dup[1], 1 - dup[2]), dup, (n + 2, [2 * x for x in dup[1]], dup[2]), (n + 3, None, 0), (n + 4, [], 0), (n + 5, [0.0] * 24, 0), (n + 6, [math.nan] * 24, 0), (n + 7, dup[1], None), (n + 8, [None, *dup[1][1:]], 0), (n + 9, [math.inf, *dup[1][1:]], 0), (None, dup[1], dup[2]), (n + 10, dup[1][:3], dup[2])]
    return rows


def slow(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.linalg.norm(a)

    units = [unit(v) if label is not None else None for _, v, label in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], n, least[g], r[0] is not None and r[0] == least[g]) for r, n, g in zip(rows, links, group)), key=str)


def got(df):
    return sorted((tuple(r) for r in V.near_duplicates(df).collect()), key=str)


def test_matches_brute_force(spark):
    rows = vectors()
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_split_cells(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 3)
    rows = vectors()
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    plan = V.calibrate(5000)
    hits = 0
    for _ in range(300):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9305
        key, last = plan.place(np.stack([a, c * a + math.sqrt(1 - c * c) * b]))
        hits += int(((key[0] == key[1]) & (np.abs(last[0] - last[1]) <= plan.reach)).sum() >= V.COUNT)
    assert hits / 300 >= 0.95


def test_plans_grow_below_the_square():
    a, b = V.calibrate(10_000), V.calibrate(10_000_000)
    assert b.tables / a.tables < 1000**0.35


def test_empty_and_other_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(vectors(), SCHEMA)
    assert V.near_duplicates(df.limit(0)).count() == 0
    odd = df.withColumn("node", F.lit("x")).withColumn("n_links", F.lit(1)).withColumn("id", F.lit(2)).withColumn("valid", F.lit(None))
    assert got(odd) == slow(vectors())
