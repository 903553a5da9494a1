"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked through BK-trees.

Fingerprints within two bits agree on two of four 16-bit blocks at least, so
each distinct fingerprint goes to the six shards named by its pairs of blocks,
and no link is lost.  A shard's fingerprints form a BK-tree (children keyed by
their integer Hamming distance to the parent); a search follows only the edges
within the radius.  Shards over ``SHARD`` fingerprints are split into parts;
the tree of each part is sent to the other parts of that shard alone, so no
tree and no task grows with the data.  A task returns a spanning forest of the
links that it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import append_from_text, broadcast_if_small, c, unused, written
from .components import Forest, connected_components

SEED, WIDTH, RADIUS = 42, 3, 2
#: Most fingerprints of one BK-tree.
SHARD = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(text: bytes | None, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, as an unsigned integer.

    A-Z are lower-cased, words are runs without ASCII white space, a shingle
    joins ``width`` words by spaces (fewer words: all of them).  Every
    occurrence of a shingle counts.  No words or null: 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    first, last = begins[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[i:j], seed) for i, j in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], np.uint64)
        counts += bit_counts(h)
    return majority(counts, n)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, from the lowest."""
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The unsigned integer of the bits that over half of ``n`` hashes have."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprint(df: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """``keep`` columns (all by default) and ``simhash``, the fingerprint as a signed long."""

    def kernel():
        return lambda texts: [[signed(fingerprint(t, width)) for t in texts]]

    return append_from_text(df, text, df.columns if keep is None else keep, [StructField("simhash", LongType())], kernel)


class BKTree:
    """Burkhard-Keller tree over 64-bit fingerprints by Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield self.values[at]
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]


def _forest(tree_of: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join fingerprints not yet joined here; without queries, of the tree's own."""
    tree, out, forest, mask = BKTree(), [], Forest(), (1 << 64) - 1
    if queries:
        for value in tree_of:
            tree.add(value & mask)
    for value in queries or tree_of:
        for other in tree.within(value & mask, radius):
            if forest.join(value, signed(other)):
                out.append((value, signed(other)))
        if not queries:
            tree.add(value & mask)
    return out


def _shards(fp: Column, radius: int) -> Column:
    """One key for each choice of two of the four blocks."""
    if radius > 2:
        raise ValueError("four blocks find links of two bits at most")
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(4)]
    return F.array(*[F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(block[i], 16)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(4), 2))])


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a, b``: a spanning forest of the links within ``radius`` bits; ``fingerprints`` has distinct ``simhash``."""
    keyed = fingerprints.select(F.explode(_shards(F.col("simhash"), radius)).alias("shard"), "simhash")
    hot = keyed.groupBy("shard").count().where(F.col("count") > shard).select("shard", F.ceil(F.col("count") / shard).cast("int").alias("parts"))
    cold = keyed.join(hot, "shard", "left_anti").groupBy("shard").agg(F.collect_list("simhash").alias("tree")).where(F.size("tree") > 1)
    cold = cold.select("tree", F.expr("cast(array() as array<bigint>)").alias("queries"))
    part = F.pmod(F.xxhash64("simhash"), F.col("parts")).cast("int")
    split = keyed.join(hot, "shard").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.groupBy("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.collect_list(F.when(F.col("part") <= F.col("other"), F.col("simhash"))).alias("tree"),
        F.collect_list(F.when(F.col("part") > F.col("other"), F.col("simhash"))).alias("queries"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for tree, queries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in _forest(tree, queries, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return cold.union(split.where("i = j or size(queries) > 0").select("tree", "queries")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """One row per document: id, ``text_key`` (XXH64 of the text), ``simhash``, ``component_id``, ``component_key``.

    ``component_id`` is the smallest id that links reach, the document's own
    included; ``component_key`` is the smallest fingerprint of the component.
    Defined cases: null, empty and blank texts have fingerprint 0 and link like
    any other.  Repeated rows each keep a row.  Null ids count as larger than
    any id (a component with null ids only has a null id).  An empty table
    gives an empty result.  Other columns of the input, clashing names too,
    play no part.
    """
    slim = df.select(c(doc_id).alias("__id"), c(text).alias("__t"), F.xxhash64(c(text)).alias("text_key"))
    slim, _ = written(with_fingerprint(slim, "__t", ["__id", "text_key"], width), "fingerprints")
    classes = slim.groupBy("simhash").agg(F.min("__id").alias("first_id"))
    roots = connected_components(fingerprint_links(classes.select("simhash"), radius))
    classes = classes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").withColumn("component_key", F.coalesce("root", "simhash"))
    least = classes.groupBy("component_key").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "component_key").select("simhash", "component_key", "component_id")
    return slim.join(classes, "simhash").select(F.col("__id").alias(doc_id), "text_key", "simhash", "component_id", "component_key")


def stand_for(df: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stand for their component in ``found``: the smallest id, once.

    Where a component has null ids only, one of its rows stays.  Decisions are
    made in a narrow table of ids and text keys.  Rows that go are left out by a
    broadcast anti-join while their list is small (checked), so that no text is
    shuffled; only rows that repeat with the same id and text meet, and of those
    each task sends one.  A longer list is joined by a shuffle.
    """
    name = lambda x: F.coalesce(x.cast("string"), F.lit("null"))
    found = found.select(F.col(doc_id).alias("i"), "text_key", "component_key")
    found, _ = written(found.groupBy("i", "text_key", "component_key").agg(F.count("*").alias("n")), "decided")
    # A null id comes after all others.
    stay = found.groupBy("component_key").agg(F.min(F.struct(F.col("i").isNull().alias("z"), "i", "text_key")).alias("k"))
    both = found.join(stay, "component_key")
    same = F.col("i").eqNullSafe(F.col("k.i")) & (F.col("text_key") == F.col("k.text_key"))
    row, key = unused(df.columns, "__row"), unused(df.columns, "__key")
    listed = lambda x: x.select(name(F.col("i")).alias(row), F.col("text_key").alias(key))
    gone, _ = written(listed(both.where(~same)), "gone")
    again, _ = written(listed(both.where(same & (F.col("n") > 1))), "again")
    rows = df.withColumns({row: name(c(doc_id)), key: F.xxhash64(c(text))}).join(broadcast_if_small(gone), [row, key], "left_anti")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        rows = rows.join(again, [row, key], "left_anti").unionByName(rows.join(again, [row, key], "left_semi").dropDuplicates([row, key]))
    return rows.drop(row, key)


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df`` that stand for their component, as ``stand_for`` picks them."""
    return stand_for(df, near_duplicates(df, doc_id, text, radius), doc_id, text)


def hex16(fp: Column) -> Column:
    """A signed long as sixteen lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark, sf_dir: str) -> DataFrame:
    """``op1_simhash``: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex16(F.col("simhash")).alias("fingerprint"), "component_id")
