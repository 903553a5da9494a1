"""Readers that bring interaction data to canonical edges, labels and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists, prepared, with_position

#: First destination id in graphs whose two sides are numbered apart.
DST_BASE = 10_000_000
#: Names under which a field may come.
ALIASES = {"ts": ("ts", "time"), "split": ("split", "split_labels", "ext_roll", "role", "int_roll"), "node": ("node", "nid", "id"), "label": ("label", "y"), "eid": ("eid", "edge_ids"), "w": ("w", "weight", "edge_weight")}
#: Split codes.
SPLITS = ("train", "val", "test")
ORDER = ("ts", "src", "dst", "w", "price", "disc", "tax")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def read_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical edges of the order tables: ``pos, eid, src, dst, ts, w, price, disc, tax``.

    A customer buys a part at the order's date.  ``pos`` is the position in time,
    ties ordered by all columns; it is made once per application.
    """

    def make() -> DataFrame:
        return with_position(order_items(spark, sf_dir), ORDER).withColumn("eid", F.col("pos"))

    return prepared(spark, "edges", sf_dir, make)


def order_items(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """``src, dst, ts, w, price, disc, tax`` of the order tables, and ``more`` of the items' file."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    added = items.select(*more).columns
    items = items.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", *more)
    return orders.join(items, orders.o_orderkey == items.l_orderkey).select(
        F.col("o_custkey").alias("src"), (F.col("l_partkey") + DST_BASE).alias("dst"), micros(F.col("o_orderdate")).alias("ts"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), *added
    )


def canonical(df: DataFrame) -> DataFrame:
    """Any edge table to ``pos, eid, src, dst, ts, ...``: aliases resolved, ids and times defaulted, sorted in time.

    Without a time column rows keep the order of their ids; without ids they are
    numbered; rows with the same time are ordered by id, then by all columns.
    Raises ``ValueError`` without ``src`` and ``dst``.
    """
    df = resolve(df)
    if not {"src", "dst"} <= set(df.columns):
        raise ValueError("edges need src and dst")
    rest = [c for c in df.columns if c not in ("ts", "src", "dst", "eid")]
    if "ts" not in df.columns:
        df = with_position(df, ["eid"] if "eid" in df.columns else ["src", "dst", *rest], "ts")
    order = ["ts", *(["eid"] if "eid" in df.columns else []), "src", "dst", *[c for c in rest if not df.schema[c].dataType.typeName() == "map"]]
    out = with_position(df, order)
    return out if "eid" in df.columns else out.withColumn("eid", F.col("pos"))


def resolve(df: DataFrame) -> DataFrame:
    """Columns under their canonical names."""
    for name, others in ALIASES.items():
        if name not in df.columns and (found := [o for o in others if o in df.columns]):
            df = df.withColumnRenamed(found[0], name)
    return df


def read_csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; types by canonical name."""
    df = resolve(spark.read.csv(path, header=True))
    kinds = {"src": "long", "dst": "long", "ts": "long", "eid": "long", "w": "double", "split": "int", "label": "double"}
    return canonical(df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns if c and not c.startswith("_c")]))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A folder's ``edges.parquet``, or else its ``edges.csv``."""
    if exists(spark, f"{path}/edges.parquet"):
        return canonical(spark.read.parquet(f"{path}/edges.parquet"))
    if exists(spark, f"{path}/edges.csv"):
        return read_csv_edges(spark, f"{path}/edges.csv")
    raise FileNotFoundError(f"no edges.parquet or edges.csv in {path}")


def read_numeric_rows(spark: SparkSession, path: str, sep: str = r"[\s,]+", skip: str = "^[#%]") -> DataFrame:
    """Rows of numbers of a text file as ``cols``; comments and a header, which isn't numeric, are left out."""
    cols = F.transform(F.split(F.trim("value"), sep), lambda x: x.try_cast("double"))
    rows = spark.read.text(path).where(~F.col("value").rlike(skip) & (F.trim("value") != "")).select(cols.alias("cols"))
    return rows.where(F.forall("cols", lambda x: x.isNotNull()))


def web_edges(rows: DataFrame) -> DataFrame:
    """``src, dst, w, ts`` of rows with 3 (no weight), 4 (weight, time) or more columns."""
    n, at = F.size("cols"), lambda i: F.col("cols")[i]
    return rows.where(n >= 3).select(at(0).cast("long").alias("src"), at(1).cast("long").alias("dst"), F.when(n >= 4, at(2)).otherwise(1.0).alias("w"), F.when(n >= 4, F.try_element_at("cols", F.lit(4))).otherwise(at(2)).cast("long").alias("ts"))


def label_rows(df: DataFrame) -> DataFrame:
    """``node, ts, split, label`` from any of the aliases; split codes are held to 0..2."""
    df = resolve(df)
    split = F.least(F.greatest(F.col("split").cast("int"), F.lit(0)), F.lit(2)) if "split" in df.columns else F.lit(0)
    return df.select(F.col("node").cast("long").alias("node"), F.col("ts").cast("long").alias("ts"), split.alias("split"), F.col("label").alias("label"))


def flatten_labels(df: DataFrame, column: str = "labels") -> DataFrame:
    """``ts, node, label`` of a map from times to maps from nodes to labels."""
    return df.select(F.explode(column).alias("ts", "__of")).select("ts", F.explode("__of").alias("node", "label"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: ``node, other, dir`` (0: as given, 1: reversed) and the rest."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.inline(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(d).alias("dir")) for d, (a, b) in enumerate((("src", "dst"), ("dst", "src")))]))
    return edges.select(ends, *rest)


def remapped(edges: DataFrame) -> DataFrame:
    """``node, id``: dense ids from 0 of all end points, in the order of the nodes."""
    nodes = edges.select("src").union(edges.select("dst")).distinct().withColumnRenamed("src", "node")
    return with_position(nodes, ["node"], "id")


def random_features(nodes: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """``node, feat``: standard normal features that depend on the node, the component and the seed only."""
    from ..functions.hashing import uniform01

    def one(i: int) -> Column:
        u = 1 - uniform01(F.col("node"), 2 * i, seed)
        return F.sqrt(-2 * F.log(u)) * F.cos(F.lit(6.283185307179586) * uniform01(F.col("node"), 2 * i + 1, seed))

    return nodes.select("node", F.array(*[one(i) for i in range(width)]).alias("feat"))
