"""Window plans: overlapping fixed-length windows over each read, the last one aligned to its end."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from sigtok.functions import scalar as S
from sigtok.profile import PROFILE, Profile


def with_counts(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    return reads.withColumn("num_chunks", S.chunk_count(F.col("num_samples"), p))


def chunk_plan(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """``reads`` by window, with seq, start and valid. Reads without samples have no window."""
    n = F.col("num_samples")
    start = S.chunk_start(n, F.col("seq"), p)
    return (
        reads.withColumn("seq", F.explode(S.chunk_indices(n, p)))
        .withColumn("start", start)
        .withColumn("valid", S.valid_length(n, F.col("start"), p))
    )


def window_signals(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """``chunk_plan`` with each window's own samples instead of the read's."""
    plan = chunk_plan(reads, p)
    return plan.withColumn("samples", F.slice("signal", F.col("start").cast("int") + 1, F.col("valid"))).drop("signal")


def samples(reads: DataFrame) -> DataFrame:
    """``reads`` by sample, with pos and adc: the exploded form, for checks."""
    rest = [c for c in reads.columns if c != "signal"]
    return reads.select(*rest, F.posexplode("signal").alias("pos", "adc"))


def cover_depth(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, num_samples, min_depth, max_depth, covered) by sweeping over window ends.

    Depth changes only where windows start or end, so a read's profile comes from its few windows and
    not from its samples.
    """
    plan = chunk_plan(reads.select("read_pos", "num_samples"), p)
    ends = plan.select("read_pos", "num_samples", F.col("start").alias("at"), F.lit(1).alias("d")).union(
        plan.select("read_pos", "num_samples", F.col("start") + F.col("valid"), F.lit(-1))
    )
    steps = ends.groupBy("read_pos", "num_samples", "at").agg(F.sum("d").alias("d"))
    along = Window.partitionBy("read_pos").orderBy("at")
    depth = steps.select(
        "read_pos",
        "num_samples",
        F.sum("d").over(along).alias("depth"),
        (F.lead("at").over(along) - F.col("at")).alias("width"),
    ).where(F.col("width") > 0)
    covered = F.sum(F.when(F.col("depth") > 0, F.col("width")).otherwise(0))
    return depth.groupBy("read_pos", "num_samples").agg(
        F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), covered.alias("covered")
    )


def prefix_offsets(reads: DataFrame, value: str, out: str, span: int = 1 << 20) -> DataFrame:
    """``out``: the sum of ``value`` over all reads before, in read_pos order.

    Sums are taken by ranges of read_pos and only one row per range meets in one window partition.
    """
    ranged = reads.withColumn("_range", F.floor(F.col("read_pos") / span))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    bases = bases.select("_range", F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(before.partitionBy("_range").orderBy("read_pos")), F.lit(0))
    return (
        ranged.withColumn("_inside", inside)
        .join(bases, "_range")
        .withColumn(out, (F.col("_base") + F.col("_inside")).cast("long"))
        .drop("_range", "_base", "_inside")
    )


def take_while_chunks(reads: DataFrame, limit: int, p: Profile = PROFILE) -> DataFrame:
    """The first reads until ``limit`` windows are reached; the read that reaches it is kept."""
    return prefix_offsets(with_counts(reads, p), "num_chunks", "chunk_offset").where(F.col("chunk_offset") < limit)


def register_udtf(spark, p: Profile = PROFILE) -> None:
    """SQL table function chunk_windows(num_samples): (seq, start, valid)."""
    length, hop = p.chunk_samples, p.hop_samples

    @udtf(returnType="seq: int, start: bigint, valid: int")
    class ChunkWindows:
        def eval(self, num_samples: int) -> Iterator[tuple[int, int, int]]:
            if num_samples is None or num_samples <= 0:
                return
            last = max(num_samples - length, 0)
            for i in range(1 if num_samples <= length else 1 - (length - num_samples) // hop):
                start = min(i * hop, last)
                yield i, start, min(length, num_samples - start)

    spark.udtf.register("chunk_windows", ChunkWindows)
