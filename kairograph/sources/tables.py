"""Tables in a folder that all executors share, positions over a whole table, and prepared artifacts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where a local session has it unset, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kairograph-"))
        folder = spark.sparkContext.getCheckpointDir()
        atexit.register(delete, spark, folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jvm is not None and spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let an existing path go when the driver ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again; with ``by`` in a folder for each of its values.  It goes when the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if by:
        df.repartition(by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_prepared: dict[tuple[str, str, str], DataFrame] = {}


def prepared(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table made once per application and source, then read."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _prepared:
        _prepared[key] = written(make(), name)
    return _prepared[key]


def with_position(df: DataFrame, order: Sequence[str], to: str = "pos") -> DataFrame:
    """``df`` with each row's position from 0 in a total order, without a task that holds all rows.

    Rows are dealt out by range and sorted there; positions inside a range come
    with its number, and the ranges' counts give where each begins.  The
    ranges are written once, so both passes see the same ones.
    """
    inside = F.monotonically_increasing_id()
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", inside), "ranges")
    part = F.shiftright("__id", 33)
    counts = ranged.groupBy(part.alias("__part")).count()
    begins = counts.withColumn("__begin", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(F.broadcast(begins), "__part").withColumn(to, (F.col("__begin") + local).cast("long")).drop("__id", "__part", "__begin")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows, and the sum over rows of 32 bits of their SHA-256; order plays no part."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_shards(df: DataFrame, path: str, part: str = "part") -> None:
    """Partitioned by owner, so that a reader of one part opens its files only."""
    df.repartition(part).write.mode("overwrite").partitionBy(part).parquet(path)


def read_shard(spark: SparkSession, path: str, part: int | None = None, column: str = "part") -> DataFrame:
    df = spark.read.parquet(path)
    return df if part is None else df.where(F.col(column) == part)
