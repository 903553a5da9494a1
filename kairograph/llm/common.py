"""Helpers shared by the operators: Arrow kernels over texts, and tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a kernel gets at once (one longer text still comes alone).
SLICE_BYTES = 2_000_000


def c(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (tests) a temporary folder is set; on a
    cluster that is an error, as executors could not read one another's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="kairograph-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
        atexit.register(remove, spark, folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a session that has ended leaves nothing to do."""
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again: cuts lineage, survives lost executors.

    It goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of an Arrow batch: Spark's 10,000 whole texts at once are too much for a small executor.
BATCH_ROWS = 500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``BATCH_ROWS``, for kernels over texts and lists."""
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


#: Rows of a narrow table up to which it is broadcast.
SMALL_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, a narrow written table, to be broadcast if it has no more than ``rows`` rows; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def append_from_text(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[StructField],
    kernel: Callable[[], Callable[[list[bytes | None]], list[list]]],
) -> DataFrame:
    """``keep`` columns plus ``fields``, which the kernel makes of the UTF-8 bytes of ``text``.

    ``kernel()`` is called once per task and returns a function from a list of
    texts (``None`` for null) to one list of values per field.  A kept column
    with the name of a field is left out.
    """
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    keep = [k for k in keep if k.lower() not in names]
    # Under names of our own inside, as a table's may be anything.
    source = df.select(*[c(k).alias(f"k{i}") for i, k in enumerate(keep)], c(text).cast("binary").alias("t"))
    made = [StructField(f"f{i}", f.dataType) for i, f in enumerate(fields)]
    schema = StructType([*source.schema.fields[:-1], *made])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            column = batch.column(n)
            for begin, end in pieces(column):
                part = batch.slice(begin, end - begin)
                made = apply(column.slice(begin, end - begin).to_pylist())
                arrays = [*part.columns[:n], *(pa.array(v, kind) for v, kind in zip(made, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def least_hashes(rows: DataFrame, key: Column, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` rows with the smallest hashes of ``key`` (of each value of ``by``), with ``h``.

    A group's count tells which hashes can be among its smallest, so all but a
    few rows fall away where they are read, and none gathers a group.  Ties go
    by the other columns.
    """
    group = [by] if by else []
    rows = rows.withColumn("h", F.xxhash64(key))
    counts = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    # Eight standard errors above the share that is asked for, so k rows are among them.
    limit = F.lit(-float(1 << 63)) + F.least(F.lit(1.0), F.lit(k + 8 * k**0.5 + 20) / F.col("__n")) * float(1 << 64)
    near = rows.join(F.broadcast(counts), by) if by else rows.crossJoin(F.broadcast(counts))  # one row
    near = near.where(F.col("h") <= limit).drop("__n")
    order = Window.partitionBy(*group).orderBy("h", *[x for x in near.columns if x not in ("h", by)])
    return near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def pieces(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about SLICE_BYTES, before any text becomes a Python object."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    begin = size = 0
    for i, s in enumerate(sizes):
        size += s
        if size >= SLICE_BYTES or i - begin >= 2000:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, or a variant that no column has."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name

