"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written


class Forest:
    """Sets of joined values, for the links of one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        p, q = self.root(x), self.root(y)
        self.parent[p] = q
        return p != q


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that ``links`` touch; root is the smallest node reachable.

    A round hangs the larger neighbours of each node on its smallest neighbour
    (large star), then does the same for the smaller ones (small star).  Rounds
    end when the links are stars, after about log(n) rounds.  Each round is a
    table in the shared folder, so lost executors cost one round at most, and
    the driver sees only counts.  The rows of a star meet at its centre in joins
    only, whose large partitions Spark's skew join splits, and in combined
    aggregates.  Self-links and nulls join nothing.  Empty
    links give an empty result.
    """
    x, y = F.col(a), F.col(b)
    edges = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()
    edges, path = written(edges, "links")
    for _ in range(max_rounds):
        if is_stars(edges):
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lo"), F.least("u", "m").alias("m"))
        large = edges.join(nearest, "lo").select("hi", F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = least.select("hi", F.col("m").alias("lo")).union(joined.where("lo > m").select("lo", "m")).distinct()
        following, new = written(small, "links")
        remove(edges.sparkSession, path)
        edges, path = following, new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select("lo", "lo").distinct())


def is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one centre and no centre hangs on another."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("hi")).first()
    return n == nodes and edges.join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()
