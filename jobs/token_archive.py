"""New reads into a token archive: what has arrived since the last run is encoded and added.

    python -m jobs.token_archive INPUT TARGET CHECKPOINT [--config jobs/token_archive.json]

INPUT is a table of texts in Parquet, whose code points are the reads' samples, with a column that parts the
archive. It is read as a stream of files that ends with what is there; CHECKPOINT remembers the files that
are done, so a run takes only new ones. Each micro-batch is encoded by window where its reads are, without a
shuffle, and written to partitions of its own, ``batch=N/<partition>=...``: a batch that is run again after
a loss replaces just what it had written. TARGET and CHECKPOINT belong together: with a new checkpoint,
take a new target.

The archive has one row a window (SCHEMA): what the codec needs to bring the window back, its codes as four
hexadecimal digits each. A read without samples has one row without a window, so no read is lost.

Null texts are reads without samples; rows of equal ids are reads each; a null partition value is a partition
of its own; other columns of INPUT aren't read. Files that arrive with old times are taken too.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config_of, parser, session
from sigtok.operators import codecs
from sigtok.plans import pipeline
from sigtok.profile import PROFILE, Profile
from sigtok.sources.adapters import text_reads


@dataclass(frozen=True)
class Config:
    codec: str = "mean-quant"
    partition: str = "source"
    #: Files of a micro-batch: what is at most done again after a loss.
    files_per_batch: int = 1000
    #: Windows that the codec sees at once.
    windows_per_call: int = codecs.BATCH


def schema(config: Config) -> str:
    """The archive's columns; ``batch`` and the partition column are in its folders."""
    return (
        "read_pos long, num_samples long, seq int, start long, valid int, center float, scale float, codes string, "
        f"batch long, `{config.partition}` string"
    )


def encoded(docs: DataFrame, config: Config, p: Profile = PROFILE) -> DataFrame:
    """Rows of the archive, but for ``batch``, from rows (doc_id, text, partition)."""
    part = config.partition
    reads = text_reads(docs, [part])
    tokens = pipeline.encode(reads, codecs.create(config.codec, p), p, config.windows_per_call, ["num_samples", part], places=True)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 4, "0"))
    rows = tokens.select(
        "read_pos", "num_samples", "seq", "start", "valid", "center", "scale", F.array_join(digits, "").alias("codes"), part
    )
    # found by their lengths alone, without Python
    empty = docs.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select(
        F.col("doc_id").cast("long").alias("read_pos"), F.lit(0).cast("long").alias("num_samples"), F.lit(None).cast("int").alias("seq"),
        F.lit(None).cast("long").alias("start"), F.lit(0).alias("valid"), F.lit(None).cast("float").alias("center"),
        F.lit(None).cast("float").alias("scale"), F.lit("").alias("codes"), part,
    )
    return rows.unionByName(empty)


def archive(docs: DataFrame, batch: int, target: str, config: Config) -> dict[str, int]:
    """Writes one micro-batch over what it may have written before; what it had, for the log."""
    first = F.coalesce(F.col("seq"), F.lit(0)) == 0
    seen = Observation(f"archive-{batch}")
    rows = encoded(docs, config).observe(
        seen,
        F.count(F.when(first, 1)).alias("reads"),
        F.coalesce(F.sum(F.when(first, F.col("num_samples"))), F.lit(0)).alias("samples"),
        F.count("seq").alias("windows"),
    )
    rows = rows.withColumn("batch", F.lit(batch).cast("long"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("batch", config.partition).parquet(target)
    return seen.get


def stream_path(spark: SparkSession, source: str) -> str:
    """``source`` as file streams take it: a table of a single file as a pattern, as their paths are folders."""
    folder, _, name = source.rstrip("/").rpartition("/")
    files = spark.read.schema("doc_id long").parquet(source).inputFiles()
    return f"{folder}/{{{name}}}" if len(files) == 1 and files[0].endswith(f"/{name}") else source


def run(spark: SparkSession, source: str, target: str, checkpoint: str, config: Config = Config()) -> dict[str, int]:
    """Archives what is new in ``source``; how many batches, reads, samples and windows that was."""
    columns = f"doc_id long, text string, `{config.partition}` string"
    stream = (
        spark.readStream.schema(columns)
        .option("maxFilesPerTrigger", config.files_per_batch)
        .option("maxFileAge", "36500d")  # else files with times long before the newest are passed over
        .parquet(stream_path(spark, source))
    )
    total = {"batches": 0, "reads": 0, "samples": 0, "windows": 0}

    def each(docs: DataFrame, batch: int) -> None:
        had = archive(docs, batch, target, config)
        LOG.info("batch %d: read %d reads of %d samples, wrote %d windows to %s", batch, had["reads"], had["samples"], had["windows"], target)
        total["batches"] += 1
        for name, n in had.items():
            total[name] += n

    query = (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    LOG.info("read %s, %s", source, ", ".join(f"{n} {name}" for name, n in total.items()))
    return total


def read_back(spark: SparkSession, target: str, config: Config = Config()) -> DataFrame:
    return spark.read.schema(schema(config)).parquet(target)


def main(argv: list[str] | None = None) -> int:
    args = parser(
        "Encodes reads that are new since the last run.",
        ("input", "a Parquet table of texts; a file, a folder or a pattern"),
        ("target", "the archive's folder"),
        ("checkpoint", "the folder that remembers what is done"),
    ).parse_args(argv)
    config = config_of(Config, args.config)
    spark = session("token-archive")
    try:
        run(spark, args.input, args.target, args.checkpoint, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
