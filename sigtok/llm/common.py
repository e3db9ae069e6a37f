"""Helpers shared by the corpus operators: shared storage, stable ordinals, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtok.session import ship, spread

#: Rows that one window partition of ``ordinals`` holds on average.
ROWS_PER_SALT = 10_000
#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
#: A table of at most so many rows of a few numbers may be broadcast.
SMALL_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/documents.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is local, a temporary folder that goes with the process; on a
    cluster an unset folder is an error, as a machine-local one would lose files with an executor.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sigtok-shared-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Materialises ``df`` as Parquet in the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sigtok_path = path
    return back


def drop_shared(*tables: DataFrame) -> None:
    """Deletes tables of ``write_shared`` that no later plan reads."""
    for t in tables:
        path = t._sigtok_path
        jvm = t.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def whole_text(col: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most SMALL_ROWS rows; else joins shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def limit_batches(spark: SparkSession, nbytes: int) -> None:
    """Rows go to Python workers in batches of at most ``nbytes`` or one row, from now on in this session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= nbytes:
        spark.conf.set(name, str(nbytes))


def batch_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_BYTES or one row.

    The session's own limit is lowered to that for good, as plans are executed later.
    """
    limit_batches(df.sparkSession, BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``batch_map`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return batch_map(df, run, schema)


def slices(batch: pa.RecordBatch, nbytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of about ``nbytes``, one row at least."""
    rows = max(1, batch.num_rows * nbytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ordinals(df: DataFrame, key: str, order: list[str], out: str, rows: int, salt_by: str) -> DataFrame:
    """Adds ``out``: gapless ordinals from 0 in each ``key``, without a window over a whole key.

    Rows are numbered in (key, salt) groups of about ROWS_PER_SALT rows, a group's start is the number
    of rows of its key with smaller salts. Only the counts by (key, salt) meet in one window partition.
    The salt is a hash of ``salt_by``, so a task that runs again gives the same numbers.
    """
    salts = max(1, -(-rows // ROWS_PER_SALT))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt_by)), F.lit(salts)).cast("int"))
    starts = (
        salted.groupBy(key, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .drop("_n")
    )
    numbered = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)))
    return (
        numbered.join(starts, [key, "_salt"])
        .withColumn(out, (F.col("_start") + F.col("_rn") - 1).cast("long"))
        .drop("_salt", "_start", "_rn")
    )
