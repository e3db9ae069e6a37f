"""Calibration and per-window normalization: array form for production, exploded form for checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtok.functions import scalar as S
from sigtok.operators.arrow import Step, chained, from_lists, picked, sliced, to_lists
from sigtok.operators.windows import chunk_plan, window_signals
from sigtok.profile import PROFILE, Profile


def window_stats(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, seq, start, valid, lo, hi, center, half) from the extrema of each window's slice.

    Calibration is monotone, so only two samples of a window are calibrated; a negative scale swaps them.
    """
    return _with_stats(window_signals(reads, p)).select("read_pos", "seq", "start", "valid", "lo", "hi", "center", "half")


def _with_stats(plan: DataFrame) -> DataFrame:
    a = S.adc_to_pa(F.array_min("samples"), F.col("offset"), F.col("scale"))
    b = S.adc_to_pa(F.array_max("samples"), F.col("offset"), F.col("scale"))
    lo_hi = plan.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    return lo_hi.withColumns({"center": S.midpoint(F.col("lo"), F.col("hi")), "half": S.half_range(F.col("lo"), F.col("hi"))})


def exploded_windows(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, num_samples, seq, start, valid, t, pos, pa, center, half, y), one row per window sample.

    A window's statistics go with its samples when it is exploded, so that no sample meets them in a join.
    """
    rows = _with_stats(window_signals(reads, p)).select(
        "read_pos", "seq", "num_samples", "offset", "scale", "start", "valid", F.posexplode("samples").alias("t", "adc"), "center", "half"
    )
    pa_ = S.adc_to_pa(F.col("adc"), F.col("offset"), F.col("scale"))
    rows = rows.withColumn("pos", F.col("start") + F.col("t")).withColumn("pa", pa_)
    return rows.withColumn("y", S.normalized(F.col("pa"), F.col("center"), F.col("half"), p))


def reflect_fill(y: np.ndarray, length: int) -> np.ndarray:
    n = len(y)
    if n >= length:
        return y
    if n == 1:
        return np.repeat(y, length)
    at = np.arange(length) % (2 * n - 2)
    return y[np.minimum(at, 2 * n - 2 - at)]


def prepare_window(adc: np.ndarray, offset: float, scale: float, p: Profile) -> tuple[np.ndarray, np.float32, np.float32]:
    """(values of full length in [-1, 1], center, half range), in single precision."""
    pa_ = (adc.astype(np.float32) + np.float32(offset)) * np.float32(scale)
    lo, hi = float(pa_.min()), float(pa_.max())
    if not np.isfinite(lo) or not np.isfinite(hi):
        raise ValueError("calibration gives values that aren't finite")
    center, half = np.float32((lo + hi) * 0.5), np.float32((hi - lo) * 0.5)
    if half < np.float32(p.normalization_epsilon):
        y = np.zeros(len(pa_), dtype=np.float32)
    else:
        y = np.clip((pa_ - center) / half, np.float32(-1), np.float32(1))
    return reflect_fill(y, p.chunk_samples), center, half


def cutter(p: Profile, carry: Sequence[str] = (), with_adc: bool = False) -> Step:
    """From (read_pos, offset, scale, signal, carry...) to (read_pos, seq, start, valid, center, half, y[, adc], carry..., last).

    A read's windows follow each other; ``last`` marks the last of them.
    """
    names = ["read_pos", "seq", "start", "valid", "center", "half", "y", *["adc"] * with_adc, *carry, "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, hop = p.chunk_samples, p.hop_samples
        for batch in sliced(batches, 3):
            offset, scale = (c.to_pylist() for c in batch.columns[1:3])
            rows: list[tuple] = []
            size = 0
            for k, signal in enumerate(from_lists(batch.column(3))):
                n = len(signal)
                count = 0 if n == 0 else 1 if n <= length else 1 + (n - length + hop - 1) // hop
                for i in range(count):
                    start = min(i * hop, max(n - length, 0))
                    part = signal[start : start + length]
                    rows.append((k, i, start, part, *prepare_window(part, offset[k], scale[k], p), i == count - 1))
                    size += length
                    if size >= 1 << 19:
                        yield packed(batch, rows)
                        rows, size = [], 0
            if rows:
                yield packed(batch, rows)

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        of, seq, start, parts, y, center, half, last = zip(*rows, strict=True)
        at = pa.array(of, pa.int64())
        columns = [
            batch.column(0).take(at),
            pa.array(seq, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array([len(x) for x in parts], pa.int32()),
            pa.array(np.array(center), pa.float32()),
            pa.array(np.array(half), pa.float32()),
            to_lists(y, pa.float32()),
            *([to_lists(parts, pa.int16())] if with_adc else []),
            *(batch.column(4 + c).take(at) for c in range(len(carry))),
            pa.array(last, pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    return run


def prepare(reads: DataFrame, p: Profile = PROFILE, carry: Sequence[str] = (), with_adc: bool = False) -> DataFrame:
    """(read_pos, seq, start, valid, center, half, y[, adc], carry...): every window ready for a codec.

    Windows are cut inside the task that holds the read: no shuffle, and arrays cross to Python once.
    ``carry`` names columns of the reads that go with each of their windows; ``adc`` are its own samples.
    """
    columns = reads.select("read_pos", "offset", "scale", "signal", *carry)
    names = ["read_pos", "seq", "start", "valid", "center", "half", "y", *["adc"] * with_adc, *carry]
    more = [f"{c} {columns.schema[c].dataType.simpleString()}" for c in carry]
    fixed = "read_pos long, seq int, start long, valid int, center float, half float, y array<float>"
    step = chained(cutter(p, carry, with_adc), picked(*names))
    return columns.mapInArrow(step, ", ".join([fixed, *["adc array<smallint>"] * with_adc, *more]))


__all__ = ["chunk_plan", "cutter", "exploded_windows", "prepare", "prepare_window", "reflect_fill", "window_stats"]
