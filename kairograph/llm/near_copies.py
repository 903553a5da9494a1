"""Near copies by SimHash and BK-trees: groups linked by Jaccard similarities of 0.8 or more of sets of 5-word shingles.

The SimHash operator with the parameters of near copies.  Documents with equal
sets are one node.  A node goes to ``TABLES`` shards, each named by ``HASHES``
min-hashes of its set, so two sets of similarity J share one with probability
1 - (1 - J^4)^20: 0.99997 at 0.8, more above.  In a shard a BK-tree over the
64-bit SimHashes of the sets gives the candidates within ``RADIUS`` bits (at 0.8
two differ in 10 on average, in over 24 less than once in 10,000), and these
are compared shingle by shingle, so every link is right.

A shard gives a spanning forest of its links, never all pairs.  Two rounds: the
first takes a few tables and compares parts of ``PART`` nodes, which joins
nearly all of a large group; the second takes all tables and compares, in the
shards that still hold several components, the nodes outside of a shard's
largest component with all its nodes.  Parts bound every task, whatever the
size of a shard.  Work is quadratic only in nodes that share a shard without
being linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from .common import append_from_text, broadcast_if_small, c, remove, written
from .components import Forest, connected_components
from .simhash import BKTree, bit_counts, majority, signed, stand_for

WIDTH, SEED, RADIUS = 5, 42, 24
#: Shards of a node, min-hashes that name one, and tables of the first round.
TABLES, HASHES, EARLY = 20, 4, 4
#: Nodes of a part of a shard.
PART = 128
#: Shingles that are looked at together.
BLOCK = 4096

#: Odd multipliers, one for each min-hash: the multiples of one odd number.
_MULTIPLIERS = np.arange(1, 2 * TABLES * HASHES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LONGS = ArrayType(LongType())


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles, words as for ``simhash.fingerprint``; no words: none."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    found = {digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))} if words else ()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    n = len(x) + len(y)
    return 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * n


def simhash_of(x: np.ndarray) -> int:
    """SimHash of a set of shingles, as a signed long."""
    counts = sum((bit_counts(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)), np.zeros(64, np.int64))
    return signed(majority(counts, len(x)))


def shard_keys(x: np.ndarray) -> list[int]:
    """A key for each table, of the set's min-hashes; the empty set has none."""
    if not len(x):
        return []
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max)
    for i in range(0, len(x), BLOCK):
        # The product's high half depends on all bits of a hash, so it is what is compared first.
        np.minimum(least, (x[None, i : i + BLOCK] * _MULTIPLIERS[:, None]).min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(least[k * HASHES : (k + 1) * HASHES].tobytes(), k)) for k in range(TABLES)]


def node_of(x: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(x.tobytes(), SEED))


def _prints(rows: DataFrame) -> DataFrame:
    """``__id, text_key`` and of the row's set: ``node``, ``keys``."""

    def kernel():
        def run(batch):
            sets = [shingles(t) for t in batch]
            return [[node_of(x) for x in sets], [shard_keys(x) for x in sets]]

        return run

    return append_from_text(rows, "__t", ["__id", "text_key"], [StructField("node", LongType()), StructField("keys", _LONGS)], kernel)


def _sets(rows: DataFrame, prints: DataFrame, shards: DataFrame) -> DataFrame:
    """``node, fp, s``: SimHash and shingles of the nodes that meet others, each from one of its rows."""
    alone = prints.select("node", "text_key", F.col("__id").cast("string").alias("i")).join(shards.select("node").distinct(), "node", "left_semi")
    first = alone.groupBy("node").agg(F.min(F.struct("text_key", "i")).alias("r")).select(F.col("r.text_key").alias("text_key"), F.coalesce("r.i", F.lit("")).alias("i"))
    first, path = written(first.distinct(), "first")
    rows = rows.withColumn("i", F.coalesce(F.col("__id").cast("string"), F.lit("")))
    asked = rows.join(broadcast_if_small(first), ["text_key", "i"], "left_semi")

    def kernel():
        def run(batch):
            sets = [shingles(t) for t in batch]
            return [[node_of(x) for x in sets], [simhash_of(x) for x in sets], [x.view(np.int64) for x in sets]]

        return run

    found = append_from_text(asked, "__t", [], [StructField("node", LongType()), StructField("fp", LongType()), StructField("s", _LONGS)], kernel)
    out, _ = written(found.dropDuplicates(["node"]), "sets")
    remove(rows.sparkSession, path)
    return out


def _dealt(members: DataFrame, first: bool) -> DataFrame:
    """``g, node, root, member, query``: groups of at most two parts; a group's queries are compared with its members."""
    number = lambda parts: F.pmod(F.xxhash64("node", "key"), parts).cast("int")
    if first:
        sizes = members.groupBy("key").agg(F.ceil(F.count("*") / PART).alias("parts"))
        rows = members.join(sizes, "key").withColumn("i", number(F.col("parts")))
        yes = F.lit(True)
        return rows.select(F.xxhash64("key", "i").alias("g"), "node", "root", yes.alias("member"), yes.alias("query"))
    roots = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("all")).where("n < all")
    rows = members.join(sizes, "key").withColumns({"out": F.col("root") != F.col("most"), "pi": F.ceil((F.col("all") - F.col("n")) / PART), "pj": F.ceil(F.col("all") / PART)})
    rows = rows.withColumns({"i": number(F.col("pi")), "j": number(F.col("pj"))})
    yes, no = F.lit(True), F.lit(False)
    # As a member in every part of queries, and, from outside, as a query in every part of members.
    one = lambda i, j, member, query: F.struct(F.xxhash64("key", i, j).alias("g"), member.alias("member"), query.alias("query"))
    as_member = F.transform(F.sequence(F.lit(0), (F.col("pi") - 1).cast("int")), lambda i: one(i, F.col("j"), yes, F.col("out") & (i == F.col("i"))))
    elsewhere = F.filter(F.sequence(F.lit(0), (F.col("pj") - 1).cast("int")), lambda j: F.col("out") & (j != F.col("j")))
    as_query = F.transform(elsewhere, lambda j: one(F.col("i"), j, no, yes))
    return rows.select("node", "root", F.explode(F.concat(as_member, as_query)).alias("x")).select("x.g", "node", "root", "x.member", "x.query")


def _links_of(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between a group's queries and members of other roots."""
    tree, at, forest = BKTree(), {}, Forest()
    for row in rows:
        if row[3]:
            tree.add(row[2])
            at.setdefault(row[2], []).append(row)
    for node, root, fp, _, query, s in rows:
        if not query:
            continue
        near = sorted(tree.within(fp, RADIUS), key=lambda v: (v ^ fp).bit_count())
        for other, its, _, _, _, t in (x for v in near for x in at[v]):
            if forest.root(root) != forest.root(its) and similar(s, t):
                forest.join(root, its)
                yield node, other


def _compared(groups: DataFrame) -> DataFrame:
    """``a, b`` of groups that come together, sorted by ``g``; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, mask = None, (1 << 64) - 1

        def made(links):
            links = list(links)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            links: list[tuple[int, int]] = []
            g, node, root, fp, member, query = (batch.column(k).to_pylist() for k in range(6))
            ends, values = batch.column(6).offsets.to_numpy(), batch.column(6).values.to_numpy().view(np.uint64)
            for k in range(batch.num_rows):
                if g[k] != last:
                    links += _links_of(held)
                    held, last = [], g[k]
                held.append((node[k], root[k], fp[k] & mask, member[k], query[k], values[ends[k] : ends[k + 1]]))
            yield made(links)
        yield made(_links_of(held))

    return groups.mapInArrow(run, "a long, b long")


def _round(shards: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    members = shards.where(F.col("t") < EARLY).withColumn("root", F.col("node")) if roots is None else shards.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = _dealt(members.select("key", "node", "root"), roots is None).join(sets, "node")
    rows = rows.select("g", "node", "root", "fp", "member", "query", "s").repartition("g").sortWithinPartitions("g")
    return _compared(rows).distinct()


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``text_key`` (XXH64 of the text), ``component_id``, ``component_key``.

    ``component_id`` is the smallest id that links reach, the document's own
    included; ``component_key`` is the smallest node of the component.  Null,
    empty and blank texts have the empty set and are one group.  Null ids count
    as larger than any id.  Repeated rows each keep a row.  An empty table gives
    an empty result.
    """
    spark = df.sparkSession
    rows = df.select(c(doc_id).alias("__id"), c(text).alias("__t"), F.xxhash64(c(text)).alias("text_key"))
    prints, _ = written(_prints(rows), "prints")
    # Rows of a node are combined before their keys meet, so a text's copies are no hot key.
    keyed = prints.select("node", "keys").dropDuplicates(["node"]).select(F.posexplode("keys").alias("t", "key"), "node")
    many = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    # A small table, dealt anew so that it becomes a few files.
    shards, path = written(keyed.join(many, "key", "left_semi").hint("rebalance"), "shards")
    sets = _sets(rows, prints, shards)
    roots = connected_components(written(_round(shards, sets, None), "links")[0])
    links = roots.where("node != root").toDF("a", "b").union(written(_round(shards, sets, roots), "links")[0])
    roots = connected_components(links)
    remove(spark, path)
    for at in sets.inputFiles()[:1]:
        remove(spark, at.rpartition("/")[0])
    classes = prints.groupBy("node").agg(F.min("__id").alias("first_id"))
    classes = classes.join(roots, "node", "left").withColumn("component_key", F.coalesce("root", "node"))
    least = classes.groupBy("component_key").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "component_key").select("node", "component_key", "component_id")
    return prints.join(classes, "node").select(F.col("__id").alias(doc_id), "text_key", "component_id", "component_key")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stand for their group, as ``simhash.stand_for`` picks them."""
    return stand_for(df, near_copies(df, doc_id, text), doc_id, text)
