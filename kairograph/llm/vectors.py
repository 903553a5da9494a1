"""Embedding near-duplicates by collision-counting projections.

Vectors of a label are compared through ``L`` tables.  A table projects the unit
vectors on random directions: all but the last are cut into cells at a random
offset, and inside a cell vectors are sorted by the last projection, where each
one's window, centred on it, collides with its neighbours.  A pair is a link if
it collides in ``COUNT`` tables at least and its cosine in double precision is
high enough; a task finds the close pairs of its window by blocked products
first, as their number is small, and counts the collisions of those.

``calibrate`` picks the number of projections so that a vector meets a few
unrelated ones in a table however many there are, and then the number of
tables so that a pair at the threshold reaches the count with probability
``RECALL``.  Closer pairs do so almost surely.  The work grows as n to the
power 1.24, not as its square.

Equal vectors are one class.  Cells over ``CELL`` classes are split into parts,
and every two parts meet in a task of their own.  A task counts links and
returns a spanning forest; each pair is counted in the first table in which it
collides, so no pairs are returned or shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import c, small_batches, written
from .components import Forest, connected_components

THRESHOLD = 0.93
#: Tables in which a pair must collide, and the recall at the threshold for which tables are added.
COUNT, RECALL = 2, 0.99
#: Most classes of a cell that one task compares with as many others.
CELL = 1024
#: Rows of a block of cosines, and pairs whose collisions are counted at once.
BLOCK, PAIRS = 256, 20_000
#: Unrelated vectors that a vector meets in a table, at most, on average.
STRANGERS = 0.1
#: Cell width and half the window's width, as multiples of the threshold's distance.
WIDTH, REACH = 4.0, 2.0
SEED = 9


def _same_cell(d: float, width: float) -> float:
    """Probability that two points at distance ``d`` fall in the same cell of a projection."""
    r = width / d
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def _reached(d: float, reach: float) -> float:
    return math.erf(reach / d / math.sqrt(2))


@dataclass(frozen=True)
class Plan:
    """Projections of each table and number of tables."""

    projections: int
    tables: int
    width: float
    reach: float

    @cache  # noqa: B019 (a plan lives as long as its process)
    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(SEED)
        return rng.standard_normal((dim, self.tables * self.projections)), rng.uniform(0, self.width, self.tables * self.projections)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell keys (n, tables) and last projections (n, tables) of unit vectors."""
        a, offset = self.directions(unit.shape[1])
        y = (unit @ a).reshape(len(unit), self.tables, self.projections)
        cells = np.floor((y[:, :, :-1] + offset.reshape(self.tables, self.projections)[None, :, :-1]) / self.width).astype(np.int64)
        key = np.zeros(cells.shape[:2], np.uint64)
        for i in range(self.projections - 1):
            key = (key ^ (cells[:, :, i] + 64).astype(np.uint64)) * np.uint64(0x100000001B3)
            key ^= key >> np.uint64(31)
        return key.view(np.int64), y[:, :, -1]


def calibrate(n: int, threshold: float = THRESHOLD, recall: float = RECALL, count: int = COUNT) -> Plan:
    """The plan for ``n`` vectors of one label."""
    near, far = math.sqrt(2 - 2 * threshold), math.sqrt(2)
    width, reach = WIDTH * near, REACH * near
    p, q = _same_cell(near, width), _same_cell(far, width)
    k = max(1, math.ceil(math.log(max(1.0, n * _reached(far, reach) / STRANGERS)) / -math.log(q)))
    hit, tables = p**k * _reached(near, reach), count
    while 1 - sum(math.comb(tables, i) * hit**i * (1 - hit) ** (tables - i) for i in range(count)) < recall:
        tables += 1
    return Plan(k + 1, tables, width, reach)


def _unit(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                node, block, vector = (part.column(i).to_pylist() for i in range(3))
                for dim in {len(v) for v in vector}:
                    rows = [i for i, v in enumerate(vector) if len(v) == dim]
                    key, _ = plan.place(_unit([vector[i] for i in rows]))
                    table = np.tile(np.arange(plan.tables, dtype=np.int32), len(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat([node[i] for i in rows], plan.tables), pa.int64()), pa.array(np.repeat([block[i] for i in rows], plan.tables), pa.int64()), pa.array(table), pa.array(key.ravel())],
                        names=["node", "block", "tab", "cell"],
                    )

    return run


def _compare(plan: Plan, threshold: float, count: int):
    """Links inside a group of classes, or between its two sides, first found in this table."""

    def windows(table: int, sides: np.ndarray, unit: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows in each other's window of this table that are close."""
        last = unit @ plan.directions(unit.shape[1])[0][:, table * plan.projections + plan.projections - 1]
        order = np.argsort(last, kind="stable")
        sides, unit, last = sides[order], unit[order], last[order]
        to = np.searchsorted(last, last + plan.reach, side="right")
        found = []
        for begin in range(0, len(unit), BLOCK):
            end = min(len(unit), begin + BLOCK)
            high = int(to[begin:end].max())
            at, other = np.arange(begin, end)[:, None], np.arange(begin, high)[None, :]
            near = (unit[begin:end] @ unit[begin:high].T >= threshold) & (other > at) & (other < to[begin:end, None])
            if two:
                near &= sides[begin:end, None] != sides[None, begin:high]
            a, b = np.nonzero(near)
            found.append((order[a + begin], order[b + begin]))
        return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))

    def counted(table: int, unit: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs, those that collide here first and in enough tables."""
        rows, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        key, last = plan.place(unit[rows])
        a, b = at[: len(x)], at[len(x) :]

        def collide(tables: slice) -> np.ndarray:
            return (key[a, tables] == key[b, tables]) & (np.abs(last[a, tables] - last[b, tables]) <= plan.reach)

        # Close pairs mostly collide early, so that a few tables sort most of them out.
        for begin in range(0, table, 8):
            keep = ~collide(slice(begin, min(table, begin + 8))).any(axis=1)
            x, y, a, b = x[keep], y[keep], a[keep], b[keep]
        keep = collide(slice(table, None)).sum(axis=1) >= count
        return x[keep], y[keep]

    def links(table: int, two: bool, node: np.ndarray, size: np.ndarray, side: np.ndarray, unit: np.ndarray) -> list[tuple[int, int | None, int]]:
        """Links that join what isn't joined yet, and each class's number of linked rows."""
        x, y = windows(table, side, unit, two)
        parts = [counted(table, unit, x[i : i + PAIRS], y[i : i + PAIRS]) for i in range(0, len(x), PAIRS)]
        out: list[tuple[int, int | None, int]] = []
        degree, forest = np.zeros(len(node), np.int64), Forest()
        for x, y in parts:
            np.add.at(degree, x, size[y])
            np.add.at(degree, y, size[x])
            out += [(a, b, 0) for a, b in zip(node[x].tolist(), node[y].tolist(), strict=True) if forest.join(a, b)]
        some = np.flatnonzero(degree)
        return out + [(v, None, n) for v, n in zip(node[some].tolist(), degree[some].tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, two = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends, rows = batch.column(2).offsets.to_numpy(), batch.column(2).values
            node, size, side = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("node", "size", "side"))
            vector = rows.field("vector")
            begins, values = vector.offsets.to_numpy(), vector.values.to_numpy(zero_copy_only=False)
            out: list[tuple[int, int | None, int]] = []
            for k in range(batch.num_rows):
                own = slice(ends[k], ends[k + 1])
                unit = _unit(values[begins[ends[k]] : begins[ends[k + 1]]].reshape(ends[k + 1] - ends[k], -1))
                out += links(table[k], two[k], node[own], size[own], side[own], unit)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], names=["a", "b", "n"])

    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite
    components, and vectors with a null label, link with nothing; vectors of
    different lengths don't link; equal vectors of a label link; repeated rows
    each keep a row and link; a null id counts as larger than any (a component
    with null ids only has a null id, and its rows aren't kept); an empty table
    gives an empty result.
    """
    small_batches(df.sparkSession)
    v = c(vector)
    valid = v.isNotNull() & c(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    block = F.xxhash64(c(label), F.size(v))
    rows = df.select(c(vec_id).alias("id"), F.coalesce(valid, F.lit(False)).alias("valid"), block.alias("block"), v.alias("vector"))
    rows = rows.withColumns({"h": F.xxhash64("block", "vector"), "check": F.hash("block", "vector")})
    classes, _ = written(rows.where("valid").groupBy("h", "check").agg(F.min("id").alias("first_id"), F.count("*").alias("size"), F.first("block").alias("block"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    most = classes.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    plan = calibrate(most, threshold, recall)
    cells, _ = written(classes.select("node", "block", "vector").mapInArrow(_cells(plan), "node long, block long, tab int, cell long"), "cells")
    shared = cells.groupBy("block", "tab", "cell").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / CELL).cast("int")).drop("count")
    member = cells.join(shared, ["block", "tab", "cell"])
    part = F.pmod(F.xxhash64("node", "tab"), F.col("parts")).cast("int")
    member = member.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = member.join(classes.select("node", "vector", "size"), "node")
    side = F.col("part") > F.col("other")
    groups = member.groupBy("block", "tab", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(F.collect_list(F.struct("node", "size", "vector", side.alias("side"))).alias("members"))
    found, _ = written(groups.where(F.size("members") > 1).select("tab", F.col("i") < F.col("j"), "members").mapInArrow(_compare(plan, threshold, COUNT), "a long, b long, n long"), "links")
    degrees = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null"))
    classes = classes.join(degrees, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component"))
    classes = classes.join(least, "root").select("h", "check", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"), "component")
    linked = rows.where("valid").select("id", "h", "check").join(classes, ["h", "check"]).select("id", "n", "component")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component"))
    out = linked.union(alone)
    return out.select(F.col("id").alias(vec_id), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op9_embeddings``: links and component of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``query``."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}::DOUBLE),
    r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.a = vec_id"""
