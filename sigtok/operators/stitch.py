"""Overlap stitching: weighted sums of denormalized windows, then 16-bit samples.

A read is stitched by segments of one hop, each under at most three windows, so a very long read is
many small groups and not one task. Windows add up in their order, in single precision.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtok.functions import scalar as S
from sigtok.operators.arrow import PIECE_BYTES, Step, from_lists, sliced, sorted_groups, to_lists
from sigtok.operators.normalize import exploded_windows
from sigtok.profile import PROFILE, Profile


def edge_weights(p: Profile) -> np.ndarray:
    t, o = np.arange(p.chunk_samples, dtype=np.float64), p.overlap_samples + 1
    return np.minimum(1.0, np.minimum((t + 1) / o, (p.chunk_samples - t) / o)).astype(np.float32)


def to_adc(signal: np.ndarray, offset: float, scale: float) -> np.ndarray:
    v = np.rint(signal.astype(np.float64) / float(np.float32(scale)) - float(np.float32(offset)))
    return np.clip(v, -32768, 32767).astype(np.int16)


def weighed(y: np.ndarray, valid: int, center: np.float32, half: np.float32, weights: np.ndarray, eps: np.float32) -> np.ndarray:
    """A window's own samples, denormalized, times their weights."""
    signal = np.full(valid, center) if half < eps else y[:valid] * half + center
    return signal.astype(np.float32, copy=False) * weights[:valid]


def joiner(p: Profile, fixed: Sequence[str] = (), with_adc: bool = False) -> Step:
    """``stitch_segments`` of windows that follow each other as ``cutter`` gives them, without a shuffle.

    From (read_pos, seq, start, valid, center, half, last, y[, adc], fixed...) to (read_pos, segment, pa[, adc], fixed...).
    Windows start in order, so what lies before the segment of a window's start is done when the window comes.
    """
    hop, eps, weights = p.hop_samples, np.float32(p.normalization_epsilon), edge_weights(p)
    names = ["read_pos", "segment", "pa", *["adc"] * with_adc, *fixed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = covered = np.zeros(0, dtype=np.float32)
        own = np.zeros(0, dtype=np.int16)
        base, rows, size = 0, [], 0
        for batch in batches:
            seq, start, valid, center, half, last = (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:7])
            adc = from_lists(batch.column(8)) if with_adc else None
            for k, y in enumerate(from_lists(batch.column(7))):
                n, s = int(valid[k]), int(start[k])
                if seq[k] == 0:
                    total, covered, own, base = total[:0], covered[:0], own[:0], 0
                done = s // hop * hop
                rows += cut(k, base, total[: done - base], covered[: done - base], own[: done - base])
                keep, at, size_ = total[done - base :], s - done, s + n - done
                grown = np.zeros((2, size_), dtype=np.float32)
                grown[0, : len(keep)], grown[1, : len(keep)] = keep, covered[done - base :]
                grown[0, at:] += weighed(y, n, center[k], half[k], weights, eps)
                grown[1, at:] += weights[:n]
                if with_adc:
                    own = np.concatenate([own[done - base :][:at], adc[k]])
                total, covered, base = grown[0], grown[1], done
                if last[k]:
                    rows += cut(k, base, total, covered, own)
                size += 6 * n
                if size >= PIECE_BYTES and rows:
                    yield packed(batch, rows)
                    rows, size = [], 0
            if rows:
                yield packed(batch, rows)
                rows, size = [], 0

    def cut(k: int, base: int, total: np.ndarray, covered: np.ndarray, own: np.ndarray) -> list[tuple]:
        return [
            (k, (base + a) // hop, total[a : a + hop] / covered[a : a + hop], own[a : a + hop]) for a in range(0, len(total), hop)
        ]

    def packed(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        of, segment, values, own = zip(*rows, strict=True)
        at = pa.array(of, pa.int64())
        columns = [batch.column(0).take(at), pa.array(segment, pa.int64()), to_lists(values, pa.float32())]
        columns += [to_lists(own, pa.int16())] if with_adc else []
        return pa.RecordBatch.from_arrays([*columns, *(batch.column(7 + with_adc + c + 1).take(at) for c in range(len(fixed)))], names)

    return run


def by_read(segments: Step, fixed: Sequence[str]) -> Step:
    """Whole reads again: from (read_pos, offset, scale, signal, num_samples, fixed...) through ``segments``, which gives
    their segments (read_pos, segment, pa) in order, to (read_pos, num_samples, offset, scale, signal, fixed...).

    Reads without samples have no segment and come out empty.
    """
    names = ["read_pos", "num_samples", "offset", "scale", "signal", *fixed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: reads on their way, in slices: rows, lengths, what came back
        under_way: deque[tuple[pa.RecordBatch, list[int], list[np.ndarray]]] = deque()

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 3):
                under_way.append((batch, [len(x) for x in from_lists(batch.column(3))], []))
                yield batch.select(["read_pos", "offset", "scale", "signal"])

        def finished() -> Iterator[pa.RecordBatch]:
            while under_way:
                batch, sizes, back = under_way[0]
                while len(back) < len(sizes) and not sizes[len(back)]:
                    back.append(np.zeros(0, dtype=np.int16))
                if len(back) < len(sizes):
                    return
                if sizes != batch.column(4).to_pylist():
                    wrong = next(k for k, n in enumerate(batch.column(4).to_pylist()) if n != sizes[k])
                    raise ValueError(f"samples without a window in read {batch.column(0)[wrong]}")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(4), *batch.columns[1:3], to_lists(back, pa.int16()), *batch.columns[5:]], names
                )
                under_way.popleft()

        parts: list[np.ndarray] = []
        size = 0
        for part in segments(noted()):
            for v in from_lists(part.column(2)):
                yield from finished()  # reads without samples before this one
                batch, sizes, back = under_way[0]
                k = len(back)
                parts.append(to_adc(v, batch.column(1)[k].as_py(), batch.column(2)[k].as_py()))
                size += len(v)
                if size == sizes[k]:
                    back.append(np.concatenate(parts))
                    parts, size = [], 0
        yield from finished()

    return run


def stitch_segments(decoded: DataFrame, p: Profile = PROFILE, carry: Sequence[str] = ()) -> DataFrame:
    """(read_pos, segment, pa, carry...) of ``decoded`` windows (read_pos, seq, start, valid, center, half, y).

    Segments are numbered from 0 and start every hop. ``carry`` names columns of the windows that are the same
    for a whole read, and ``adc``, a window's own samples, which are cut to segments too.
    """
    hop, eps = p.hop_samples, np.float32(p.normalization_epsilon)
    weights = edge_weights(p)
    fixed = [c for c in carry if c != "adc"]
    with_adc = len(fixed) < len(carry)
    rest = [*["adc"] * with_adc, *fixed]
    before = ["read_pos", "segment", "seq", "at", "skip", "v", *rest]
    after = ["read_pos", "segment", "pa", *rest]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 6):
            seq, start, valid, center, half = (c.to_numpy() for c in batch.columns[1:6])
            adc = from_lists(batch.column(7)) if with_adc else None
            rows = []
            for k, y in enumerate(from_lists(batch.column(6))):
                n, s = int(valid[k]), int(start[k])
                part = weighed(y, n, center[k], half[k], weights, eps)
                for segment in range(s // hop, (s + n - 1) // hop + 1):
                    a, b = max(s, segment * hop), min(s + n, (segment + 1) * hop)
                    own = adc[k][a - s : b - s] if with_adc else None
                    rows.append((k, segment, seq[k], a - segment * hop, a - s, part[a - s : b - s], own))
            if rows:
                of, segment_, seq_, at, skip, v, own_ = zip(*rows, strict=True)
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(segment_, pa.int64()), pa.array(seq_, pa.int32()),
                     pa.array(at, pa.int32()), pa.array(skip, pa.int32()), to_lists(v, pa.float32()),
                     *([to_lists(own_, pa.int16())] if with_adc else []),
                     *(batch.column(7 + with_adc + c).take(take) for c in range(len(fixed)))],
                    before,
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            at, skip = (group.column(c).to_numpy() for c in ("at", "skip"))
            values = [x for c in group.column("v").chunks for x in from_lists(c)]
            if len(set(group.column("seq").to_pylist())) != len(at):
                raise ValueError("a window came twice")
            size = int(max(a + len(v) for a, v in zip(at, values, strict=True)))
            total, covered = np.zeros(size, dtype=np.float32), np.zeros(size, dtype=np.float32)
            for a, b, v in zip(at, skip, values, strict=True):
                total[a : a + len(v)] += v
                covered[a : a + len(v)] += weights[b : b + len(v)]
            if not (covered > 0).all():
                raise ValueError("samples without a window")
            columns = [to_lists([total / covered], pa.float32())]
            if with_adc:
                own = np.zeros(size, dtype=np.int16)
                for a, x in zip(at, (x for c in group.column("adc").chunks for x in from_lists(c)), strict=True):
                    own[a : a + len(x)] = x
                columns.append(to_lists([own], pa.int16()))
            first = [group.column(c)[:1].combine_chunks() for c in ("read_pos", "segment", *fixed)]
            yield pa.RecordBatch.from_arrays([*first[:2], *columns, *first[2:]], after)

    columns = decoded.select("read_pos", "seq", "start", "valid", "center", "half", "y", *rest)
    more = [f"{c} {columns.schema[c].dataType.simpleString()}" for c in rest]
    parts = columns.mapInArrow(
        cut, ", ".join(["read_pos long, segment long, seq int, at int, skip int, v array<float>", *more])
    ).repartition("read_pos", "segment")
    return parts.sortWithinPartitions("read_pos", "segment", "seq").mapInArrow(
        merge, ", ".join(["read_pos long, segment long, pa array<float>", *more])
    )


def stitch(decoded: DataFrame, reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, num_samples, offset, scale, signal): ``stitch_segments`` with each read in one row.

    ``reads`` gives num_samples, offset and scale, also of reads without windows, which come out empty. A row
    holds a read's whole signal, as rows of reads do; what works on segments alone doesn't need it.
    """
    whole = stitch_segments(decoded, p).groupBy("read_pos").agg(F.sort_array(F.collect_list(F.struct("segment", "pa"))).alias("s"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4):
            n, offset, scale = (batch.column(k).to_numpy() for k in (1, 2, 3))
            out = []
            for k, v in enumerate(from_lists(batch.column(4))):
                # a missing window at the end of a segment leaves it short
                if len(v) != n[k]:
                    raise ValueError(f"samples without a window in read {batch.column(0)[k]}")
                out.append(to_adc(v, offset[k], scale[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], to_lists(out, pa.int16())], names)

    names = ["read_pos", "num_samples", "offset", "scale", "signal"]
    joined = reads.select("read_pos", "num_samples", "offset", "scale").join(whole, "read_pos", "left")
    joined = joined.select(*names[:4], F.coalesce(F.flatten("s.pa"), F.array().cast("array<float>")).alias("pa"))
    return joined.mapInArrow(finish, "read_pos long, num_samples long, offset float, scale float, signal array<smallint>")


def stitch_exploded(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, pos, pa, windows): the identity round trip by sample, for checks.

    Sums run over windows in order and in single precision, which sum() would not do.
    """
    rows = exploded_windows(reads, p)
    pa_ = S.denormalized(F.col("y"), F.col("center"), F.col("half"), p)
    w = S.edge_weight(F.col("t"), p)
    rows = rows.select("read_pos", "pos", F.struct("seq", (pa_ * w).alias("v"), w.alias("w")).alias("c"))
    parts = rows.groupBy("read_pos", "pos").agg(F.sort_array(F.collect_list("c")).alias("c"))

    def folded(name: str) -> Column:
        return F.aggregate("c", S.f32(0.0), lambda a, x: S.f32(a + x[name]))

    return parts.select("read_pos", "pos", S.f32(folded("v") / folded("w")).alias("pa"), F.size("c").alias("windows"))


def cover_guard(decoded: DataFrame, reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """(read_pos, num_chunks, present, distinct_seq, ok): whether each window is there exactly once."""
    counts = decoded.groupBy("read_pos").agg(
        F.count(F.lit(1)).alias("present"), F.countDistinct("seq").alias("distinct_seq")
    )
    planned = reads.select("read_pos", S.chunk_count(F.col("num_samples"), p).alias("num_chunks"))
    joined = planned.join(counts, "read_pos", "left").fillna(0, ["present", "distinct_seq"])
    ok = (F.col("present") == F.col("num_chunks")) & (F.col("distinct_seq") == F.col("num_chunks"))
    return joined.withColumn("ok", ok)
