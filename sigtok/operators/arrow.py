"""Arrow plumbing: lists of fixed-type numbers, groups of sorted batches, steps that follow each other in one worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What ``mapInArrow`` takes.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of texts or lists that a step works on at a time, however many rows an Arrow batch has.
PIECE_BYTES = 2 << 20


def to_lists(arrays: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if len(arrays) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def from_lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column as numpy views."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long rows as a matrix."""
    rows = from_lists(column)
    return np.stack(rows) if rows else np.empty((0, 0))


def chained(*steps: Step) -> Step:
    """The steps one after the other in the same worker: between them nothing goes through the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return run


def picked(*names: str) -> Step:
    return lambda batches: (b.select(list(names)) for b in batches)


def _row_bytes(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return np.diff(column.offsets.to_numpy()).astype(np.int64) * (column.type.value_type.bit_width // 8)
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], *columns: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of the text or list ``columns``, or of one row."""
    for batch in batches:
        ends = np.cumsum(sum(_row_bytes(batch.column(k)) for k in columns))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal values in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def refilled(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, whatever the batches they came in; only the last may be shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
