"""A quality report of a codec over a table of reads: what it loses, where, and for which reads.

    python -m jobs.quality_report INPUT TARGET [--config jobs/quality_report.json]

INPUT is a table of texts in Parquet, whose code points are the reads' samples, with a column that parts the
report. Each read is cut, encoded, decoded and stitched, and compared with itself by segment, so that no row
grows with a read. TARGET gets one row a figure (SCHEMA), partitioned by that column; a run replaces the
partitions of the values that it has seen, so running again gives the same.

Figures by partition: ``input`` (reads, samples, windows, short_read_share), ``read_length`` (percentiles),
``region`` (mae_pa and rmse_pa by where samples stand in their windows), ``length_bin`` (mean error of reads by
length), ``read_mae`` (percentiles of the reads' errors) and ``overall`` (mae_pa, mae_over_std). ``n`` is how many
samples or reads a figure is from. Percentiles are exact, by selection.

Null texts are reads without samples: they count in ``input`` and ``read_length`` alone. Ids name the reads in the
sums of their segments, so a null or repeated id is an error that says which. A null partition value is a
partition of its own. An empty table writes nothing.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, config_of, parser, session
from sigtok.errors import SigtokError
from sigtok.functions import scalar as S
from sigtok.operators import codecs, quality
from sigtok.operators.selection import quantiles
from sigtok.plans import pipeline
from sigtok.profile import PROFILE
from sigtok.session import stored
from sigtok.sources.adapters import text_reads

MARKS = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
#: Figures are rounded to so many digits, as the order of sums in them may differ from run to run.
DIGITS = 5


@dataclass(frozen=True)
class Config:
    codec: str = "mean-quant"
    partition: str = "source"


def schema(config: Config) -> str:
    return f"section string, name string, figure string, value double, n long, `{config.partition}` string"


def _figures(rows: DataFrame, part: str, section: str, name: Column | str, n: Column, figures: dict[str, Column]) -> DataFrame:
    """One row a figure of each row."""
    label = F.lit(name) if isinstance(name, str) else name
    each = F.array(*(F.struct(F.lit(k).alias("figure"), F.round(v.cast("double"), DIGITS).alias("value")) for k, v in figures.items()))
    exploded = rows.select(part, label.alias("name"), n.cast("long").alias("n"), F.explode(each).alias("f"))
    return exploded.select(F.lit(section).alias("section"), "name", "f.figure", "f.value", "n", part)


def figures(docs: DataFrame, config: Config) -> DataFrame:
    """The report's rows from rows (doc_id, text, partition)."""
    part, p = config.partition, PROFILE
    lengths = docs.select(part, F.col("doc_id").alias("read_pos"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("num_samples"))
    lengths = stored(lengths, "report-lengths")
    if twice := lengths.groupBy("read_pos").count().where("count > 1 or read_pos is null").head(1):
        raise SigtokError(f"reads need ids of their own; {twice[0]['read_pos']} isn't one")
    errors = pipeline.segment_errors(text_reads(docs, [part]), codecs.create(config.codec, p), p, [part])
    segments = stored(errors, "report-segments")
    reads = stored(quality.errors_by_read(segments, [part]), "report-reads")

    n = F.col("num_samples")
    totals = lengths.groupBy(part).agg(
        F.count(F.lit(1)).alias("reads"), F.sum(n).alias("samples"), F.sum(S.chunk_count(n, p)).alias("windows"),
        F.avg((n < p.chunk_samples).cast("double")).alias("short_read_share"),
    )
    regions = segments.select(part, F.inline("sums")).groupBy(part, "region").agg(
        F.sum("samples").alias("samples"), F.sum("abs").alias("abs"), F.sum("sq").alias("sq")
    )
    bins = reads.groupBy(part, S.length_bin(n).alias("bin")).agg(F.count(F.lit(1)).alias("reads"), F.avg("mae").alias("mae"))
    whole = reads.groupBy(part).agg(
        F.count(F.lit(1)).alias("reads"), (F.sum(F.col("mae") * n) / F.sum(n)).alias("mae"),
        F.avg(F.col("mae") / F.greatest("std", F.lit(1e-9))).alias("over_std"),
    )
    count = {name: table.groupBy(part).agg(F.count(F.lit(1)).alias("reads")) for name, table in (("read_length", lengths), ("read_mae", reads))}
    marks = {"read_length": quantiles(lengths, "num_samples", MARKS, [part]), "read_mae": quantiles(reads, "mae", MARKS, [part])}

    def percentiles(section: str) -> DataFrame:
        counted = count[section].withColumnRenamed(part, "of")
        rows = marks[section].join(counted, F.col(part).eqNullSafe(F.col("of")))
        return _figures(rows, part, section, "all", F.col("reads"), {m: F.col(m) for m in MARKS})

    samples = F.col("samples")
    parts = [
        _figures(totals, part, "input", "all", F.col("reads"), {c: F.col(c) for c in ("reads", "samples", "windows", "short_read_share")}),
        percentiles("read_length"),
        _figures(regions, part, "region", F.col("region"), samples, {"mae_pa": F.col("abs") / samples, "rmse_pa": F.sqrt(F.col("sq") / samples)}),
        _figures(bins, part, "length_bin", F.col("bin"), F.col("reads"), {"mean_read_mae": F.col("mae")}),
        percentiles("read_mae"),
        _figures(whole, part, "overall", "all", F.col("reads"), {"mae_pa": F.col("mae"), "mae_over_std": F.col("over_std")}),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def run(spark: SparkSession, source: str, target: str, config: Config = Config()) -> dict[str, int]:
    """Reports on ``source`` into ``target``; how many reads and samples it had and how many figures it wrote."""
    docs = spark.read.parquet(source).select("doc_id", "text", config.partition)
    # a few rows for each partition value, in one file each
    report = stored(figures(docs, config), "report")
    writer = report.repartition(config.partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(config.partition).parquet(target)
    had = report.where("section = 'input'").groupBy("figure").agg(F.sum("value").alias("v")).collect()
    seen = {r["figure"]: int(r["v"]) for r in had if r["figure"] != "short_read_share"}
    total = {"reads": 0, "samples": 0, "windows": 0} | seen | {"figures": report.count()}
    LOG.info("read %s: %d reads of %d samples in %d windows", source, total["reads"], total["samples"], total["windows"])
    LOG.info("wrote %d figures to %s", total["figures"], target)
    return total


def read_back(spark: SparkSession, target: str, config: Config = Config()) -> DataFrame:
    return spark.read.schema(schema(config)).parquet(target)


def main(argv: list[str] | None = None) -> int:
    args = parser(
        "Reports what a codec loses on a table of reads.",
        ("input", "a Parquet table of texts"),
        ("target", "the report's folder"),
    ).parse_args(argv)
    config = config_of(Config, args.config)
    spark = session("quality-report")
    try:
        run(spark, args.input, args.target, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
