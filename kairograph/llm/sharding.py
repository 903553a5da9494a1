"""Shards by a hierarchical weighted hash tree.

Leaves are shards, under racks, under regions; an inner node weighs what its
shards weigh.  A row descends level by level: among the children of its node it
takes the one with the least draw ``-ln(u) / weight``, with ``u`` hashed from
the row's id and the child's name.  A draw depends on nothing but the row, the
child and its weight, so when weights change, only rows that enter or leave the
subtrees that hold the changed shards move.

One more shard than planned is a subtree of its own under the root: all other
draws stay as they are, so it takes rows only into itself, and none moves
between others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, c, written

#: Shape of the tree: shards of a rack, racks of a region.
RACK, REGION = 4, 3
SHARDS = 24
#: Rows of a part of a shard that is numbered on its own, about.
PART_ROWS = 100_000

@dataclass(frozen=True)
class Shard:
    """A leaf and its place in the tree."""

    number: int
    region: int
    rack: int
    weight: float = 1.0


def tree(n: int, weights: Sequence[float] | None = None, rack: int = RACK, region: int = REGION, planned: int = SHARDS) -> list[Shard]:
    """``n`` shards: those ``planned`` in order, ``rack`` to a rack and ``region`` racks to a region, then each in a region of its own."""
    weights = list(weights or [1.0] * max(n, 0))
    if n < 1 or len(weights) != n or min(weights) <= 0:
        raise ValueError("there must be a shard, and a weight above 0 for each")
    last = min(n, planned) - 1
    places = [(i // (rack * region), i // rack) if i <= last else (last // (rack * region) + i - last, last // rack + i - last) for i in range(n)]
    return [Shard(i, *place, w) for i, (place, w) in enumerate(zip(places, weights, strict=True))]


def children(shards: Sequence[Shard]) -> dict[str, dict[str, float]]:
    """Names and weights of the children of each inner node; the root is the empty name."""
    out: dict[str, dict[str, float]] = {}
    for s in shards:
        path = ["", f"region{s.region}", f"rack{s.rack}", str(s.number)]
        for node, child in zip(path, path[1:], strict=False):
            below = out.setdefault(node, {})
            below[child] = below.get(child, 0.0) + s.weight
    return out


def _draw(key: Column, name: Column, weight: Column) -> Column:
    """The row's draw at a node; of 52 bits, so that u is exact and between 0 and 1."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), name).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _descend(rows: DataFrame, key: str, shards: Sequence[Shard], to: str) -> DataFrame:
    """``rows`` with the shard that ``key`` descends to; a row draws at the children of three nodes only."""
    nodes = children(shards)
    table = F.create_map(*[x for node, below in nodes.items() for x in (F.lit(node), F.array(*[F.struct(F.lit(k).alias("name"), F.lit(w).alias("weight")) for k, w in below.items()]))])
    rows = rows.withColumn(to, F.lit(""))
    for _ in range(3):
        least = F.array_min(F.transform(table[F.col(to)], lambda x: F.struct(_draw(F.col(key), x["name"], x["weight"]).alias("draw"), x["name"].alias("name"))))
        rows = rows.withColumn(to, least["name"])
    return rows.withColumn(to, F.col(to).cast("int"))


def assign(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHARDS, weights: Sequence[float] | None = None, added: float = 1.0, planned: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``law`` is ``key``: the id and the shards decide, and one more shard than
    ``planned`` (all ``n`` by default) takes rows only into itself;
    ``grown_shard`` is the shard after one more of weight ``added``.  A new plan
    of all shards is another tree, and moves rows between them.  ``slot`` numbers a shard's rows from 0 without gaps, by the MD5 of id
    and CRC.  Texts are read once, for a narrow table of distinct rows and their
    counts.  Parts of a shard, by the first digits of the MD5, are numbered on
    their own and get the sum of the parts before them, so no task holds a
    shard.  Defined cases: null texts have size 8 and CRC 0; a null id is a key
    of its own; repeated rows each get a slot; an empty table gives an empty
    result.
    """
    data, planned, weights = F.coalesce(c(text), F.lit("")).cast("binary"), planned or n, list(weights or [1.0] * n)
    rows = df.select(c(doc_id).alias("i"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.groupBy("i", "size", "text_crc32").agg(F.count("*").alias("n")).withColumn("key", F.coalesce(F.col("i").cast("string"), F.lit("")))
    rows = _descend(_descend(rows, "key", tree(n, weights, planned=planned), "shard"), "key", tree(n + 1, [*weights, added], planned=planned), "grown_shard")
    order = F.md5(F.concat("key", F.lit(":"), F.col("text_crc32").cast("string")).cast("binary"))
    rows, _ = written(rows.withColumn("m", order).drop("key"), "placed")
    total, most = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    digits = max(2, math.ceil(math.log(total / (n * PART_ROWS) + 1, 16)))
    rows = rows.withColumn("part", F.substring("m", 1, digits))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.sum("n").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(earlier), F.lit(0))).drop("k")
    own = Window.partitionBy("shard", "part").orderBy("m", "i", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(broadcast_if_small(written(counts, "counts")[0]), ["shard", "part"])
    numbered = numbered.withColumn("first", F.col("own") + F.col("before"))
    if most > PART_ROWS:  # a row that repeats so often comes out of several tasks
        numbered = numbered.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART_ROWS).cast("long")))).repartition("m", "b")
        numbered = numbered.withColumns({"first": F.col("first") + F.col("b"), "n": F.least(F.col("n") - F.col("b"), F.lit(PART_ROWS).cast("long"))})
    slots = numbered.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
    return slots.select(F.col("i").alias(doc_id), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def query(spark, sf_dir: str) -> DataFrame:
    """``op6_sharding``: shard and slot of every document."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_descent(shards: Sequence[Shard], key: str, name: str) -> list[str]:
    """Select items, level by level, each using the one before it."""
    nodes = children(shards)

    def least(node: str) -> str:
        draws = [f"{{'draw': -ln((('0x' || substr(md5({key} || ':{child}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / {w}::DOUBLE, 'name': '{child}'}}" for child, w in nodes[node].items()]
        return f"list_min([{', '.join(draws)}]).name"

    def level(before: str, kind: str) -> str:
        return "CASE " + before + " " + " ".join(f"WHEN '{x}' THEN {least(x)}" for x in nodes if x.startswith(kind)) + " END"

    return [f"{least('')} AS {name}_region", f"{level(f'{name}_region', 'region')} AS {name}_rack", f"({level(f'{name}_rack', 'rack')})::INT AS {name}"]


def oracle_sql() -> str:
    """DuckDB SQL for the rows of ``query``: draws at each level; CRC-32 is folded byte by byte."""
    step = "CASE WHEN z % 2 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END"
    entry = f"list_reduce(list_prepend(n::BIGINT, range(8)), lambda z, i: {step})"
    key = "coalesce(doc_id::VARCHAR, '')"
    placed = ", ".join([*_sql_descent(tree(SHARDS), key, "shard"), *_sql_descent(tree(SHARDS + 1), key, "grown_shard")])
    folded = "xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tab[xor(a, x) % 256 + 1])), 4294967295)"
    return f"""WITH crc AS MATERIALIZED (SELECT list({entry} ORDER BY n) AS tab FROM generate_series(0, 255) g(n)),
    b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes, {placed} FROM documents),
    c AS (SELECT doc_id, size, {folded} AS text_crc32, shard, grown_shard FROM b, crc)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5({key} || ':' || text_crc32::BIGINT::VARCHAR), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM c"""
