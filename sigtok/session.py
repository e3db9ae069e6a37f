"""Session setup: sane defaults, and this package on the Python workers' path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with this library's defaults."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.config(map=DEFAULTS | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers that see this folder import the package, whatever the driver's working folder.

    On clusters without such a folder, install the package there or give it with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


#: Inputs of less than this for each core may be dealt out.
SMALL_SHARE = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small scan of few splits, as of a file with one row group, dealt out to all cores.

    A row group is read by one task, whatever the splits. Inputs of more bytes or more splits stay as
    they are: nothing is shuffled where the scan keeps the cluster busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size < cores * SMALL_SHARE and df.rdd.getNumPartitions() <= 2 * cores
    return df.repartition(cores) if few else df


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a temporary one only where master and driver are one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sigtok-work-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later passes don't compute it again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most SMALL_ROWS rows; else joins shuffle. Counts ``df``."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
