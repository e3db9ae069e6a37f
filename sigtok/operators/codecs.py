"""Codecs: what turns prepared windows into codes and codes into windows, row by row.

A row's result depends on the row alone, so batches and partitions may be cut anywhere. Codecs are
plain objects that pickle; ``register`` makes more of them known by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigtok.operators.arrow import Step, from_lists, matrix, refilled, to_lists
from sigtok.operators.quantize import Book
from sigtok.profile import PROFILE, Profile

#: Windows that a codec sees at once.
BATCH = 64


class Codec(Protocol):
    def encode(self, y: np.ndarray) -> np.ndarray:
        """float32 (rows, L) in [-1, 1] to codes (rows, T)."""

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """codes (rows, T) to float32 (rows, L)."""


class MeanQuant:
    """A code is the quantized mean of its stretch of samples; content alone decides it."""

    def __init__(self, p: Profile = PROFILE) -> None:
        self.length, self.tokens, self.size = p.chunk_samples, p.tokens_per_chunk, p.codebook_size

    def encode(self, y: np.ndarray) -> np.ndarray:
        means = y.astype(np.float64).reshape(len(y), self.tokens, -1).mean(axis=2)
        return np.clip(np.floor((means + 1) * 0.5 * (self.size - 1) + 0.5), 0, self.size - 1).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        y = (codes / (self.size - 1) * 2 - 1).astype(np.float32)
        return np.repeat(y, self.length // self.tokens, axis=1)


class Identity:
    """Keeps each sample: codes are the samples' bits, so any wrong mapping or order shows."""

    def encode(self, y: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(y, dtype="<f4").view("<i4")

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes, dtype="<i4").view("<f4")


class VectorQuant:
    """Codes are nearest codewords of stretches of L / T samples."""

    def __init__(self, words: np.ndarray, p: Profile = PROFILE) -> None:
        self.words, self.tokens = words.astype(np.float32), p.tokens_per_chunk
        self.book = Book(self.words)

    def encode(self, y: np.ndarray) -> np.ndarray:
        flat = y.reshape(len(y) * self.tokens, -1)
        return self.book.search(flat).reshape(len(y), self.tokens).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[codes].reshape(len(codes), -1)


_registry: dict[str, tuple[Callable[..., Codec], str]] = {}


def register(name: str, make: Callable[..., Codec], about: str) -> None:
    _registry[name] = (make, about)


def create(name: str, p: Profile = PROFILE) -> Codec:
    if name not in _registry:
        raise KeyError(f"no codec {name!r}; there are {sorted(_registry)}")
    return _registry[name][0](p)


def listed() -> dict[str, str]:
    return {name: about for name, (_, about) in sorted(_registry.items())}


register("mean-quant", MeanQuant, "segment means, quantized")
register("identity", lambda p: Identity(), "lossless, for checks")


def encoder(codec: Codec, batch: int = BATCH, carry: Sequence[str] = ()) -> Step:
    """From (read_pos, seq, center, scale, y, carry...) to the same with codes for y, ``batch`` windows a call."""
    names = ["read_pos", "seq", "center", "scale", "codes", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in refilled(batches, batch):
            codes = codec.encode(matrix(part.column(4)).astype(np.float32, copy=False))
            yield pa.RecordBatch.from_arrays([*part.columns[:4], to_lists(list(codes), pa.int32()), *part.columns[5:]], names)

    return run


def decoder(codec: Codec, rest: Sequence[str], batch: int = BATCH) -> Step:
    """From (rest..., codes) to (rest..., y); values that aren't finite are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in refilled(batches, batch):
            y = codec.decode(np.stack(from_lists(part.column(len(rest)))))
            if not np.isfinite(y).all():
                raise ValueError("the decoder gave values that aren't finite")
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], to_lists(list(y), pa.float32())], [*rest, "y"])

    return run


def encode_windows(prepared: DataFrame, codec: Codec, batch: int = BATCH, carry: Sequence[str] = ()) -> DataFrame:
    """(read_pos, seq, center, scale, codes, carry...) of prepared windows, where they are: no shuffle.

    The codec sees ``batch`` windows a call, over the edges of reads and Arrow batches, but for a partition's last.
    """
    columns = prepared.select("read_pos", "seq", "center", F.col("half").alias("scale"), "y", *carry)
    more = [f"{c} {columns.schema[c].dataType.simpleString()}" for c in carry]
    return columns.mapInArrow(encoder(codec, batch, carry), ", ".join(["read_pos long, seq int, center float, scale float, codes array<int>", *more]))


def decode_windows(tokens: DataFrame, codec: Codec, batch: int = BATCH) -> DataFrame:
    """``tokens`` with y instead of codes; values that aren't finite are an error."""
    rest = [c for c in tokens.columns if c != "codes"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "codes")
    return tokens.select(*rest, "codes").mapInArrow(decoder(codec, rest, batch), f"{kinds}, y array<float>")
