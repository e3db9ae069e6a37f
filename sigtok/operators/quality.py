"""Quality analytics: errors by region, length and level, and differences between token tables.

Errors have two forms. ``read_errors`` folds each read's arrays into a few sums where the read is, and only
those are grouped; ``sample_errors`` explodes reads into samples and is there to check the first by SQL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtok.functions import scalar as S
from sigtok.operators.arrow import Step, from_lists, sliced
from sigtok.operators.selection import quantiles
from sigtok.operators.stitch import to_adc
from sigtok.profile import PROFILE, Profile
from sigtok.session import stored


def input_stats(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """One row on the lengths; percentiles by selection, so ``reads`` is read a few times."""
    n, k = F.col("num_samples"), S.chunk_count(F.col("num_samples"), p)
    names = ("p5", "p50", "p95")
    marks = quantiles(reads, "num_samples", dict(zip(names, (0.05, 0.5, 0.95), strict=True)))
    totals = reads.agg(
        F.count(F.lit(1)).alias("reads"),
        F.sum(n).alias("samples"),
        F.sum(k).alias("chunks"),
        F.round(F.avg((n < p.chunk_samples).cast("double")), 9).alias("short_read_share"),
        F.round(F.avg(k), 9).alias("chunks_per_read_mean"),
    )
    one = totals.join(marks, F.lit(True))  # one row each
    return one.select(
        "reads", "samples", "chunks", *(F.floor(q).cast("long").alias(q) for q in names), "short_read_share", "chunks_per_read_mean"
    )


def errors(original: DataFrame, back: DataFrame) -> DataFrame:
    """(read_pos, num_samples, offset, scale, signal, back) of reads that have samples and equal lengths."""
    both = original.join(back.select("read_pos", F.col("signal").alias("back")), "read_pos")
    return both.where((F.size("signal") == F.size("back")) & (F.size("signal") > 0))


def sample_errors(pairs: DataFrame) -> DataFrame:
    """(read_pos, num_samples, pos, pa, err) by sample, in double precision."""
    zipped = F.arrays_zip("signal", "back")
    rows = pairs.select(
        "read_pos", "num_samples", S.f64(F.col("offset")).alias("offset"), S.f64(F.col("scale")).alias("scale"), F.posexplode(zipped).alias("pos", "s")
    )
    pa_ = (F.col("s.signal") + F.col("offset")) * F.col("scale")
    return rows.select("read_pos", "num_samples", "pos", pa_.alias("pa"), ((F.col("s.back") + F.col("offset")) * F.col("scale") - pa_).alias("err"))


def region_codes(n: int, p: Profile = PROFILE, first: int = 0, size: int | None = None) -> np.ndarray:
    """The place in S.REGIONS of each of ``size`` samples from ``first`` on, of a read of n samples."""
    length, hop, overlap = p.chunk_samples, p.hop_samples, p.overlap_samples
    size = n - first if size is None else size
    if n < length:
        return np.full(size, S.REGIONS.index("short"), dtype=np.int8)
    pos = np.arange(first, first + size)
    regular = (n - length) // hop + 1
    aligned_over = (regular - 1) * hop + length
    return np.select(
        [
            (pos < overlap) | (pos >= n - overlap),
            (aligned_over < n) & (pos >= n - length) & (pos < aligned_over),
            (pos >= hop) & (pos // hop < regular) & (pos % hop < overlap),
        ],
        [S.REGIONS.index(r) for r in ("edge", "tail", "seam")],
        S.REGIONS.index("interior"),
    ).astype(np.int8)


SUMS_ARROW = pa.list_(pa.struct([("region", pa.string()), ("samples", pa.int64()), ("abs", pa.float64()), ("sq", pa.float64())]))
_SUMS = "array<struct<region:string,samples:long,abs:double,sq:double>>"


def _region_sums(codes: np.ndarray, err: np.ndarray) -> list[dict]:
    count = np.bincount(codes, minlength=len(S.REGIONS))
    absolute = np.bincount(codes, np.abs(err), minlength=len(S.REGIONS))
    square = np.bincount(codes, err * err, minlength=len(S.REGIONS))
    return [
        {"region": r, "samples": int(count[k]), "abs": float(absolute[k]), "sq": float(square[k])}
        for k, r in enumerate(S.REGIONS)
        if count[k]
    ]


def read_folder(p: Profile) -> Step:
    """From (read_pos, num_samples, offset, scale, signal, back) to the rows of ``read_errors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4, 5):
            offset, scale = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
            mae, std, sums = [], [], []
            for k, (x, y) in enumerate(zip(from_lists(batch.column(4)), from_lists(batch.column(5)), strict=True)):
                level = (x.astype(np.float64) + offset[k]) * scale[k]
                err = (y.astype(np.float64) + offset[k]) * scale[k] - level
                mae.append(np.abs(err).mean())
                std.append(level.std())
                sums.append(_region_sums(region_codes(len(x), p), err))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(mae, pa.float64()), pa.array(std, pa.float64()), pa.array(sums, SUMS_ARROW)],
                ["read_pos", "num_samples", "mae", "std", "sums"],
            )

    return run


def read_errors(pairs: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, num_samples, mae, std, sums): a read's errors, std over the population, sums by region."""
    columns = pairs.select("read_pos", "num_samples", "offset", "scale", "signal", "back")
    return columns.mapInArrow(read_folder(p), f"read_pos long, num_samples long, mae double, std double, sums {_SUMS}")


def by_region(reads: DataFrame) -> DataFrame:
    """(region, samples, mae_pa, rmse_pa) from ``read_errors``."""
    rows = reads.select(F.explode("sums").alias("s")).select("s.*")
    n = F.sum("samples")
    return rows.groupBy("region").agg(
        n.alias("samples"), (F.sum("abs") / n).alias("mae_pa"), F.sqrt(F.sum("sq") / n).alias("rmse_pa")
    )


def segment_folder(p: Profile, carry: Sequence[str] = ()) -> Step:
    """From (read_pos, num_samples, segment, offset, scale, adc, pa, carry...) to the rows of ``segment_errors``."""
    hop = p.hop_samples
    names = ["read_pos", "num_samples", "segment", "offset", "scale", *carry, "differing", "level", "square", "back", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 5, 6):
            n, segment, offset, scale = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            figures, sums = [], []
            for k, (x, v) in enumerate(zip(from_lists(batch.column(5)), from_lists(batch.column(6)), strict=True)):
                if len(x) != min(hop, n[k] - segment[k] * hop):
                    raise ValueError(f"samples without a window in read {batch.column(0)[k]}")
                y = to_adc(v, offset[k], scale[k])
                o, s = float(offset[k]), float(scale[k])
                err = (y.astype(np.float64) + o) * s - (x.astype(np.float64) + o) * s
                x = x.astype(np.int64)
                figures.append(((x != y).sum(), x.sum(), (x * x).sum(), y.astype(np.int64).sum()))
                sums.append(_region_sums(region_codes(int(n[k]), p, int(segment[k]) * hop, len(x)), err))
            whole = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *batch.columns[7:], *whole, pa.array(sums, SUMS_ARROW)], names)

    return run


def segment_kinds(columns: DataFrame, carry: Sequence[str] = ()) -> str:
    """The types of ``segment_folder``'s rows, those of ``carry`` as in ``columns``."""
    more = [f"{c} {columns.schema[c].dataType.simpleString()}" for c in carry]
    kinds = ["read_pos long, num_samples long, segment long, offset float, scale float", *more]
    return ", ".join([*kinds, f"differing long, level long, square long, back long, sums {_SUMS}"])


def segment_errors(rows: DataFrame, p: Profile = PROFILE, carry: Sequence[str] = ()) -> DataFrame:
    """(read_pos, num_samples, segment, carry..., differing, level, square, back, sums) of ``pipeline.compared`` rows.

    ``level`` and ``square`` sum the samples and their squares, exactly, and ``back`` what came back; ``sums``
    has the errors by region as ``read_errors`` has them for whole reads.
    """
    columns = rows.select("read_pos", "num_samples", "segment", "offset", "scale", "adc", "pa", *carry)
    return columns.mapInArrow(segment_folder(p, carry), segment_kinds(columns, carry))


def errors_by_read(segments: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(read_pos, num_samples, carry..., mae, std) from ``segment_errors``; std from exact sums of the samples."""
    n = F.col("num_samples").cast("double")
    absolute = F.aggregate("sums", F.lit(0.0), lambda a, s: a + s["abs"])
    reads = segments.groupBy("read_pos", "num_samples", *carry).agg(
        F.sum(absolute).alias("abs"), F.sum("level").alias("level"), F.sum("square").alias("square"), F.max(F.abs("scale")).alias("scale")
    )
    whole = F.col("num_samples").cast("decimal(20,0)")
    spread = (whole * F.col("square") - F.col("level").cast("decimal(20,0)") * F.col("level")).cast("double")
    return reads.select(
        "read_pos", "num_samples", *carry, (F.col("abs") / n).alias("mae"), (F.sqrt(spread) / n * S.f64(F.col("scale"))).alias("std")
    )


def region_sizes(n: Column, p: Profile = PROFILE) -> dict[str, Column]:
    """How many samples of a read of n samples are in each region, in closed form.

    Edges take the first and last O samples; the tail is what the last, shifted window shares with the regular
    one before it; seams begin each regular window after the first. Each counts what the ones before left over.
    """
    length, hop, overlap = p.chunk_samples, p.hop_samples, p.overlap_samples
    zero, n = F.lit(0).cast("long"), n.cast("long")
    regular = F.floor((n - length) / hop).cast("long") + 1
    aligned_over = (regular - 1) * hop + length
    first, last = F.lit(overlap).cast("long"), n - overlap
    width = min(overlap, hop)

    def seams_before(x: Column) -> Column:
        """Seam samples before x, as if there were no edges or tail."""
        at = F.least(F.greatest(x, F.lit(hop).cast("long")), regular * hop)
        return (F.floor(at / hop).cast("long") - 1) * width + F.least(F.pmod(at, F.lit(hop)), F.lit(width).cast("long"))

    a, b = F.greatest(n - length, first), F.least(aligned_over, last)
    has_tail = (aligned_over < n) & (b > a)
    edge = F.least(n, F.lit(2 * overlap).cast("long"))
    tail = F.when(has_tail, b - a).otherwise(zero)
    inner = F.when(last > first, seams_before(last) - seams_before(first)).otherwise(zero)
    seam = inner - F.when(has_tail, seams_before(b) - seams_before(a)).otherwise(zero)
    sizes = {"edge": edge, "tail": tail, "seam": seam, "interior": n - edge - tail - seam}
    return {r: F.when(n < length, n if r == "short" else zero).otherwise(sizes.get(r, zero)) for r in S.REGIONS}


def region_counts(lengths: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(region, samples, reads), from the reads' lengths alone: five sums a read, whatever its length."""
    sizes = region_sizes(F.col("num_samples"), p)
    rows = lengths.select(
        F.inline(F.array(*(F.struct(F.lit(r).alias("region"), size.alias("samples")) for r, size in sizes.items())))
    ).where("samples > 0")
    return rows.groupBy("region").agg(F.sum("samples").alias("samples"), F.count(F.lit(1)).alias("reads"))


def region_error(errs: DataFrame, p: Profile = PROFILE) -> DataFrame:
    where = S.region(F.col("pos"), F.col("num_samples"), p).alias("region")
    e = F.col("err")
    return (
        errs.groupBy(where)
        .agg(F.count(F.lit(1)).alias("samples"), F.avg(F.abs(e)).alias("mae_pa"), F.sqrt(F.avg(e * e)).alias("rmse_pa"))
    )


def per_read(errs: DataFrame) -> DataFrame:
    """(read_pos, num_samples, mae, std) of each read, std over the population."""
    return errs.groupBy("read_pos", "num_samples").agg(
        F.avg(F.abs("err")).alias("mae"), F.stddev_pop("pa").alias("std")
    )


def mae_percentiles(reads: DataFrame) -> DataFrame:
    marks = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    return quantiles(stored(reads.select("mae"), "read-mae"), "mae", marks)


def by_length(reads: DataFrame) -> DataFrame:
    return reads.groupBy(S.length_bin(F.col("num_samples")).alias("length_bin")).agg(
        F.count(F.lit(1)).alias("reads"), F.avg("mae").alias("mean_read_mae")
    )


def by_level(reads: DataFrame) -> DataFrame:
    """Means by quarter of the reads' std: the quartiles themselves belong to the quarter above."""
    rows = stored(reads.select("std", "mae"), "read-levels")
    edges = quantiles(rows, "std", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    std = F.col("std")
    level = F.lit(1) + sum(((std >= F.lit(edge).cast("double")).cast("int") for edge in edges), F.lit(0))
    return rows.groupBy(level.alias("quarter")).agg(
        F.count(F.lit(1)).alias("reads"), F.avg("std").alias("pa_std_mean"), F.avg("mae").alias("mean_read_mae")
    )


def mae_over_std(reads: DataFrame) -> DataFrame:
    return reads.agg(F.avg(F.col("mae") / F.greatest("std", F.lit(1e-9))).alias("mae_over_std"))


def token_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Codes and windows that differ between two token tables of the same reads."""
    keys = ["read_pos", "seq"]
    both = a.select(*keys, "center", "scale", "codes").join(
        b.select(*keys, F.col("center").alias("c2"), F.col("scale").alias("s2"), F.col("codes").alias("d2")), keys, "full"
    )
    differ = F.aggregate(
        F.zip_with("codes", "d2", lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x
    )
    rows = both.select(
        F.greatest(F.size("codes"), F.size("d2")).cast("long").alias("n"),
        F.coalesce(differ, F.greatest(F.size("codes"), F.size("d2")).cast("long")).alias("d"),
        (F.col("center").eqNullSafe(F.col("c2")) & F.col("scale").eqNullSafe(F.col("s2"))).alias("same"),
    )
    return rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("differing_tokens"),
        F.coalesce(F.sum("d") / F.greatest(F.sum("n"), F.lit(1)), F.lit(0.0)).alias("differing_token_share"),
        F.count(F.when(F.col("d") > 0, 1)).alias("chunks_with_differences"),
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.every("same"), F.lit(True)).alias("centers_scales_identical"),
    )


def same(a: Column, b: Column) -> Column:
    """Equal, NaN with NaN and 0.0 with -0.0 too."""
    return a.eqNullSafe(b)


def meta_mismatch(a: DataFrame, b: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """Counts of reads in which any of ``columns``, the length, or the order of ids differ."""
    right = b.select("read_pos", *(F.col(c).alias(f"_{c}") for c in {*columns, id_col, "num_samples"}))
    both = a.join(right, "read_pos", "full")
    anything = F.lit(False)
    for c in columns:
        anything = anything | ~same(F.col(c), F.col(f"_{c}"))

    def count(cond: Column) -> Column:
        return F.count(F.when(cond, 1))

    return both.agg(
        count(anything).alias("meta"),
        count(~same(F.col("num_samples"), F.col("_num_samples"))).alias("length"),
        count(~same(F.col(id_col), F.col(f"_{id_col}"))).alias("order"),
    )


def padding_share(chunks: Column, batch: int) -> Column:
    """The share of rows in full batches that are padding."""
    calls = F.ceil(chunks / batch)
    return F.when(calls > 0, 1 - chunks / (calls * batch)).otherwise(0.0)


def compression_ratio(raw_bytes: Column, stored_bytes: Column) -> Column:
    return raw_bytes / F.greatest(stored_bytes, F.lit(1))
