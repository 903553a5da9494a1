"""Owners, chunks, replicas and routes of a partitioned graph."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import with_position


def hot_nodes(edges: DataFrame, count: int | None = None, ratio: float | None = None, end: str | None = None) -> DataFrame:
    """``node, degree, place``: the nodes of highest degree, ties by id."""
    ends = F.explode(F.array("src", "dst")) if end is None else F.col(end)
    degrees = edges.select(ends.alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    if count is None:
        count = int((ratio or 0) * degrees.count())
    top = degrees.orderBy(F.desc("degree"), "node").limit(count)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), "node")))


def round_robin(nodes: DataFrame, parts: int) -> DataFrame:
    """``node, part``: owner by id modulo the number of parts."""
    return nodes.select("node", F.pmod("node", F.lit(parts)).cast("int").alias("part"))


def edge_owner(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges with ``part``: the owner of their destination."""
    return edges.join(owners.withColumnRenamed("node", "dst"), "dst")


def local_rows(owners: DataFrame, hot: DataFrame, per_part_offset: bool = True) -> DataFrame:
    """``node, part, loc, is_hot``: each part's rows, hot nodes first.

    All parts hold all hot nodes in the same rows 0..h-1; a part's own other nodes
    follow by id.  ``loc`` of a hot node is the same everywhere.
    """
    marked = owners.join(hot.select("node", (F.col("place") - 1).alias("__place")), "node", "left")
    n = hot.count() if per_part_offset else 0
    cold = marked.where("__place is null")
    # Ids of a part are counted in blocks of a global order, so that no task holds a part.
    numbered = with_position(cold.select("part", "node"), ["part", "node"], "__at")
    begins = numbered.groupBy("part").agg(F.min("__at").alias("__begin"))
    numbered = numbered.join(F.broadcast(begins), "part").select("node", "part", (F.col("__at") - F.col("__begin") + n).alias("loc"), F.lit(False).alias("is_hot"))
    return marked.where("__place is not null").select("node", "part", F.col("__place").cast("long").alias("loc"), F.lit(True).alias("is_hot")).unionByName(numbered)


def packed(rows: DataFrame) -> DataFrame:
    """Rows with ``dist_index``: part in the bits from 48 up, row below."""
    return rows.withColumn("dist_index", F.shiftleft(F.col("part").cast("long"), 48).bitwiseOR(F.col("loc").cast("long")))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"part": F.shiftright("dist_index", 48).cast("int"), "loc": F.col("dist_index").bitwiseAND(F.lit((1 << 48) - 1))})


def boundary(adjacency: DataFrame, owners: DataFrame, hot: DataFrame) -> DataFrame:
    """Adjacency with ``boundary``: the neighbour has another owner and is not hot; unknown owners count as boundary."""
    own = owners.select("node", F.col("part").alias("__own"))
    far = owners.select(F.col("node").alias("other"), F.col("part").alias("__far"))
    warm = hot.select(F.col("node").alias("other"), F.lit(True).alias("__hot"))
    out = adjacency.join(own, "node", "left").join(far, "other", "left").join(F.broadcast(warm), "other", "left")
    return out.withColumn("boundary", F.coalesce(F.col("__own") != F.col("__far"), F.lit(True)) & F.col("__hot").isNull()).drop("__own", "__far", "__hot")


def replica_sets(edges: DataFrame) -> DataFrame:
    """``node, n_parts, parts, replicated``: parts in which an edge touches the node; ``edges`` has ``part``."""
    ends = edges.select("part", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.groupBy("node").agg(F.count("*").alias("n_parts"), F.array_join(F.transform(F.array_sort(F.collect_set("part")), lambda x: x.cast("string")), ",").alias("parts")).withColumn("replicated", F.col("n_parts") > 1)


def exchange_route(edges: DataFrame, owners: DataFrame, by: str) -> DataFrame:
    """``by, from_part, to_part, node``: which source nodes each part needs of another in a snapshot."""
    far = owners.select(F.col("node").alias("src"), F.col("part").alias("from_part"))
    near = owners.select(F.col("node").alias("dst"), F.col("part").alias("to_part"))
    return edges.select(by, "src", "dst").join(far, "src").join(near, "dst").where("from_part != to_part").select(by, "from_part", "to_part", F.col("src").alias("node")).distinct()


def load_balance(edges: DataFrame, by: str) -> DataFrame:
    """``by, total, mean_load, sq_dev, max_min``: evenness of the parts' edge counts in a slice."""
    loads = edges.groupBy(by, "part").agg(F.count("*").alias("n"))
    return loads.groupBy(by).agg(F.sum("n").alias("total"), F.avg("n").alias("mean_load"), F.var_pop("n").alias("sq_dev"), (F.max("n") / F.min("n")).alias("max_min"))


def chunk_affinity(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``a, b, n``: edges between every two chunks, a <= b."""
    end = lambda name, to: chunks.select(F.col("node").alias(name), F.col("chunk").alias(to))
    rows = edges.select("src", "dst").join(end("src", "__s"), "src").join(end("dst", "__d"), "dst")
    return rows.groupBy(F.least("__s", "__d").alias("a"), F.greatest("__s", "__d").alias("b")).agg(F.count("*").alias("n"))


def chunk_load(edges: DataFrame, chunks: DataFrame, by: str) -> DataFrame:
    """``by, chunk, n``: edges of each slice by the chunk of their destination."""
    return edges.select(by, "dst").join(chunks.select(F.col("node").alias("dst"), "chunk"), "dst").groupBy(by, "chunk").agg(F.count("*").alias("n"))


def locality(sampled: DataFrame, owners: DataFrame) -> DataFrame:
    """``part, n_local, n_remote``: sampled neighbours owned by the root's part, and others."""
    own = owners.select("node", "part")
    far = owners.select(F.col("node").alias("other"), F.col("part").alias("__far"))
    rows = sampled.join(own, "node").join(far, "other")
    return rows.groupBy("part").agg(F.count_if(F.col("part") == F.col("__far")).alias("n_local"), F.count_if(F.col("part") != F.col("__far")).alias("n_remote"))


def range_part(rows: DataFrame, bounds: DataFrame, column: str) -> DataFrame:
    """Rows with the part whose id range [low, high) holds them; ``bounds`` has a row for each part."""
    return rows.join(F.broadcast(bounds), (F.col(column) >= F.col("low")) & (F.col(column) < F.col("high"))).drop("low", "high")


def chunk_filter_dst(edges: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Edges whose destination's chunk is below the limit."""
    kept = chunks.where(F.col("chunk") < limit).select(F.col("node").alias("dst"))
    return edges.join(kept, "dst", "left_semi")


def chunk_induced(edges: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """Edges of which both ends' chunks are below the limit."""
    kept = chunks.where(F.col("chunk") < limit)
    return edges.join(kept.select(F.col("node").alias("dst")), "dst", "left_semi").join(kept.select(F.col("node").alias("src")), "src", "left_semi")


class _Placement:
    """Loads, homes and decayed importance of nodes, part by part, as edges stream by.

    A cold node has one home and so one importance: a few bytes of flat arrays.
    Only hot nodes, a bounded list, have one for each part.
    """

    NONE, HOT = -1, -2

    def __init__(self, parts: int, hot: set, span: float) -> None:
        self.parts, self.hot, self.span = parts, hot, max(span, 1e-9)
        self.slots: dict[int, int] = {}
        self.home, self.weight, self.last = array("i"), array("d"), array("d")
        self.warm: dict[int, tuple[list[float], list[float]]] = {}  # of a hot node's slot; it lives where its weight is above 0
        self.edges, self.nodes, self.newest = [0] * parts, [0] * parts, [0.0] * parts
        self.room, self.fresh = [1.0] * parts, [1.0] * parts  # shares left by nodes and by newest times, kept until those change

    def place(self, columns: tuple[list, list, list, list]) -> list[int]:
        """Parts of edges (``pos, src, dst, ts`` in order)."""
        slots, home, weight, last, edges, span, out = self.slots, self.home, self.weight, self.last, self.edges, self.span, []
        for pos, s, d, at in zip(*columns, strict=True):
            i, j = slots.get(s), slots.get(d)
            if i is None:
                i = self._met(s)
            if j is None:
                j = slots[d] if s == d else self._met(d)
            a, b = home[i], home[j]
            if a >= 0 and (a == b or b == self.HOT):
                part = a
            elif b >= 0 and a == self.HOT:
                part = b
            else:
                found = self._shared(i, j) if a == b == self.HOT else None
                if not found:
                    low = min(edges)
                    wide = 1 + max(edges) - low
                    score = [r * (1 - (n - low) / wide) * f for r, n, f in zip(self.room, edges, self.fresh)]
                    if a != self.NONE or b != self.NONE:
                        near: dict[int, float] = {}
                        for k, h in ((i, a), (j, b)):
                            if h >= 0:
                                near[h] = near.get(h, 1.0) + weight[k] * exp((last[k] - at) / span)
                            elif h == self.HOT:
                                for p, x in self._near(k, at):
                                    near[p] = near.get(p, 1.0) + x
                        for p, x in near.items():
                            score[p] = x * self.room[p] * (1 - (edges[p] - low) / wide) * self.fresh[p]
                    least = max(score) - 1e-12
                    found = [p for p, x in enumerate(score) if x >= least]
                part = found[pos % len(found)]
            for k in (i, j):
                h = home[k]
                if h == part:
                    weight[k] = weight[k] * exp((last[k] - at) / span) + 1
                    last[k] = at
                elif h == self.NONE:
                    home[k], weight[k], last[k] = part, 1.0, at
                    self._joined(part)
                elif h == self.HOT:
                    self._warmed(k, part, at)
            edges[part] += 1
            if at > self.newest[part]:
                self.newest[part] = at
                low = min(self.newest)
                wide = max(self.newest) - low + 1
                self.fresh = [exp((low - x) / wide) for x in self.newest]
            out.append(part)
        return out

    def _met(self, node: int) -> int:
        """A slot for a node that has none."""
        k = self.slots[node] = len(self.home)
        self.home.append(self.HOT if node in self.hot else self.NONE)
        self.weight.append(0.0)
        self.last.append(0.0)
        if node in self.hot:
            self.warm[k] = ([0.0] * self.parts, [0.0] * self.parts)
        return k

    def _shared(self, i: int, j: int) -> list[int]:
        """Parts in which both of two hot nodes live."""
        return [p for p, (x, y) in enumerate(zip(self.warm[i][0], self.warm[j][0], strict=True)) if x and y]

    def _near(self, k: int, at: float) -> list[tuple[int, float]]:
        return [(p, w * exp((t - at) / self.span)) for p, (w, t) in enumerate(zip(*self.warm[k], strict=True)) if w]

    def _warmed(self, k: int, part: int, at: float) -> None:
        """A hot node lives wherever its edges go, another one where its first edge went."""
        weight, last = self.warm[k]
        if not weight[part]:
            self._joined(part)
        weight[part] = (weight[part] and weight[part] * exp((last[part] - at) / self.span)) + 1
        last[part] = at

    def _joined(self, part: int) -> None:
        self.nodes[part] += 1
        low = min(self.nodes)
        wide = 1 + max(self.nodes) - low
        self.room = [1 - (n - low) / wide for n in self.nodes]


def streaming_edge_parts(edges: DataFrame, hot: DataFrame, parts: int, lanes: int = 1, lane_by: str = "pos") -> DataFrame:
    """``pos, part``: greedy placement of edges in time.

    An edge of a hot and a cold node goes where the cold one lives, another one
    to a part where both ends live.  Without such a part every part's reuse (one
    plus both ends' decayed importance there) is multiplied by how far it is
    from the fullest in nodes, in edges and in newest times; the best wins, ties
    go by ``pos``.  The fold is sequential in each of ``lanes`` hash lanes; with
    one lane all edges go through one task.  They stream through it in order,
    sorted by Spark, which spills; the task holds its nodes, not its edges.
    """
    warm = {r[0] for r in hot.select("node").collect()}  # a bounded top list
    span = float(edges.agg(F.max("ts")).first()[0] or 0)
    lane = F.pmod(F.xxhash64(lane_by), F.lit(lanes)) if lanes > 1 else F.lit(0).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            lane_of = batch.column("lane").to_numpy()
            ends = [*(np.flatnonzero(np.diff(lane_of)) + 1).tolist(), len(lane_of)] if len(lane_of) else []
            for begin, end in zip([0, *ends], ends):  # a batch may hold the end of a lane and others' begins
                if lane_of[begin] != at:
                    at, state = lane_of[begin], _Placement(parts, warm, span)
                pos, s, d, t = batch.slice(begin, end - begin).select(["pos", "src", "dst", "ts"]).columns
                placed = state.place((pos.to_pylist(), s.to_pylist(), d.to_pylist(), t.cast("double", safe=False).to_pylist()))
                yield pa.RecordBatch.from_arrays([pos, pa.array(placed, pa.int32())], ["pos", "part"])

    rows = edges.select(lane.alias("lane"), F.col("pos").cast("long").alias("pos"), "src", "dst", "ts")
    rows = rows.repartition("lane") if lanes > 1 else rows.repartition(1)
    return rows.sortWithinPartitions("lane", "pos").mapInArrow(run, "pos long, part int")


def assign_chunks(loads: DataFrame, parts: int, affinity: DataFrame | None = None, weight: float = 0.0, passes: int = 64) -> dict[int, int]:
    """Chunk -> part so that every slice is even and chunks that share edges stay together.

    Chunks are placed from the largest on, no part takes more than its share of
    them, and each goes where the mean squared distance from an even slice grows
    least, plus ``weight`` times its ``affinity`` (``a, b, n``) to chunks placed
    elsewhere.  Then the swap of two chunks that most lowers the mean ratio of
    the fullest to the emptiest part is made while there is one.  ``loads``
    (``slice, chunk, n``) is a matrix of chunks by slices, small by choice of
    both numbers; it is worked on by the driver.
    """
    table = loads.toPandas().pivot_table(index="chunk", columns=loads.columns[0], values="n", fill_value=0, aggfunc="sum").sort_index()
    m, place = table.to_numpy(float), {int(x): i for i, x in enumerate(table.index)}
    tied = np.zeros((len(m), len(m)))
    for r in affinity.collect() if affinity is not None else ():
        if r["a"] in place and r["b"] in place and r["a"] != r["b"]:
            tied[place[r["a"]], place[r["b"]]] = tied[place[r["b"]], place[r["a"]]] = r["n"]
    at, even, room = np.full(len(m), -1), m.sum(axis=0) / parts, np.full(parts, -(-len(m) // parts))
    sums = np.zeros((parts, m.shape[1]))
    for i in np.argsort(-np.linalg.norm(m, axis=1), kind="stable"):
        away = np.array([tied[i][(at >= 0) & (at != p)].sum() for p in range(parts)])
        cost = ((sums + m[i] - even) ** 2 - (sums - even) ** 2).mean(axis=1) + weight * away
        at[i] = int(np.where(room > 0, cost, np.inf).argmin())
        sums[at[i]] += m[i]
        room[at[i]] -= 1

    def ratio(s: np.ndarray) -> float:
        busy = s.max(axis=0) > 0
        return float((s.max(axis=0)[busy] / np.maximum(s.min(axis=0)[busy], 1e-12)).mean()) if busy.any() else 0.0

    def swapped(i: int, j: int) -> np.ndarray:
        s = sums.copy()
        s[at[i]] += m[j] - m[i]
        s[at[j]] += m[i] - m[j]
        return s

    for _ in range(passes):
        tries = [(ratio(swapped(i, j)), i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if at[i] != at[j]]
        if not tries or min(tries)[0] >= ratio(sums) - 1e-9:
            break
        _, i, j = min(tries)
        sums = swapped(i, j)
        at[i], at[j] = at[j], at[i]
    return {c: int(at[i]) for c, i in place.items()}


def replica_masters(replicas: DataFrame, parts: int) -> DataFrame:
    """``node, part``: an owner for each replicated node among its parts, evenly by hash of the node.

    ``replicas`` has ``node, part``.  The choice needs no state, so it runs in
    any number of tasks: the part with the least hash of (node, part).
    """
    from ..functions.hashing import hash31

    return replicas.groupBy("node").agg(F.min_by("part", F.struct(hash31(F.col("node"), F.col("part"), 41), "part")).alias("part"))


def feature_rows(owners: DataFrame, hot: DataFrame, edges: DataFrame | None = None, replicate: bool = False, parts: int = 1) -> DataFrame:
    """``part, node``: nodes whose features a part holds: its own, the hot ones and, with ``edges``, sources of its edges."""
    if replicate:
        return owners.select("node").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("part", "node")
    out = owners.select("part", "node").union(hot.select("node").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("part", "node"))
    if edges is not None:
        out = out.union(edge_owner(edges, owners).select("part", F.col("src").alias("node")))
    return out.distinct()


def label_propagation_chunks(edges: DataFrame, nodes: DataFrame, chunks: int, rounds: int = 3) -> DataFrame:
    """``node, chunk``: chunks by the commonest chunk of the neighbours, from an id hash, for a few rounds."""
    from ..functions.hashing import hash31
    from ..sources.tables import written

    own = nodes.select("node", F.pmod(hash31(F.col("node"), 0, 43), F.lit(chunks)).cast("int").alias("chunk"))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    for _ in range(rounds):
        votes = both.join(own.select(F.col("node").alias("other"), "chunk"), "other").groupBy("node", "chunk").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.max_by("chunk", F.struct("n", -F.col("chunk"))).alias("best"))
        own = written(own.join(best, "node", "left").select("node", F.coalesce("best", "chunk").alias("chunk")), "chunks")
    return own


