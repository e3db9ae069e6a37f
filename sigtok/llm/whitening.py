"""Embedding whitening by a two-pass covariance over distinct vectors in fixed point.

Entries become integers, x = floor(256 * c), so that sums are exact and the mean S / n is a fraction
without error. The fit list, each distinct x once, is written to the shared folder. Its first pass sums
integers; its second pass centres each batch and sums outer products by one matrix product a batch. The
partial sums of tasks, d and d * d numbers, are merged by treeAggregate. The driver takes the
eigenvectors of the d x d covariance (LAPACK's symmetric solver) and broadcasts d x k of the projection;
all rows are then centred and projected where they are. A third pass measures the covariance of what
comes out over the fit list.

Centring is exact before its one rounding: x - S / n is (x - q) - r / n with q and r the quotient and rest
of S by n. What is held anywhere is one batch and a few d x d matrices.

Defined results: rows whose vector is null or holds null, NaN or infinite entries go; repeated rows and
rows of a null id stay, each with its own result, though equal vectors count once in the fit; an empty
table, or one in which every vector goes or is empty, gives an empty result. Where a component's
eigenvalue is zero to rounding, as with one distinct vector, whitened is null and explained is 0 (null
where the trace is 0); identity_error leaves such components out and is null if none is left. Equal
eigenvalues leave a choice, taken as the solver gives it; an eigenvector's largest entry is positive.
Vectors of different lengths, and entries of 2**45 or more, are errors. Other columns are ignored,
whatever their names; texts play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import batch_map, drop_shared, write_shared
from sigtok.session import ship, spread

SCALE = 256
#: Entries of x must be less than this, so that they and their differences are exact in doubles.
LARGEST = 1 << 53
COMPONENTS = 4
#: Sums are kept as high and low parts of so many bits, exact for 2 ** 36 rows a task.
LOW_BITS = 26


def fixed_point(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x): the rows whose vectors have finite entries only, as integers."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(
        entries,
        lambda c: F.when(F.abs(c * SCALE) < float(LARGEST), F.floor(c * SCALE)).otherwise(
            F.raise_error(F.lit("an entry is too large to be exact in fixed point")).cast("long")
        ),
    )
    rows = df.where(F.col(vector).isNotNull() & ~bad)
    return rows.select(F.col(key).cast("long").alias("vec_id"), scaled.alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of integers."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(set(sizes.tolist())) > 1:
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _tree_sum(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum of ``part`` of each batch's matrix: within tasks, then between them by treeAggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = _plus(total, part(_matrix(batch.column(0))))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = batch_map(fit, run, "part binary").rdd
    # integers are summed as Python's, which have no largest
    exact = kind == "<i8"
    return parts.treeAggregate(
        None, lambda acc, row: _plus(acc, np.frombuffer(row["part"], kind).astype(object if exact else kind)), _plus
    )


def _plus(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    if a is None or b is None:
        return b if a is None else a
    if a.shape != b.shape:
        raise ValueError("vectors have different lengths")
    return a + b


def _counted(x: np.ndarray) -> np.ndarray:
    """Rows, then the high and the low parts of the sums by dimension."""
    high = x >> LOW_BITS
    return np.concatenate([[len(x)], high.sum(axis=0), (x - (high << LOW_BITS)).sum(axis=0)]).astype("<i8")


@dataclass(frozen=True)
class Centre:
    """The exact mean of n vectors: quotients and rests of the sums by n."""

    n: int
    quotient: tuple[int, ...]
    rest: tuple[int, ...]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, tuple(q for q, _ in parts), tuple(r for _, r in parts))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles, rounded once."""
        return (x - np.array(self.quotient, np.int64)) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - S) ** 2 over the dimensions of each row, exact."""
        y, n, rest = x - np.array(self.quotient, np.int64), self.n, self.rest
        largest = int(np.abs(y).max(initial=0))
        fits = len(rest) * max(largest, 1) * max(largest, n) < 1 << 62
        y, r = (y, np.array(rest, np.int64)) if fits else (y.astype(object), np.array(rest, object))
        squares, mixed, alone = (y * y).sum(axis=1).tolist(), (y @ r).tolist(), sum(k * k for k in rest)
        return [n * n * a - 2 * n * b + alone for a, b in zip(squares, mixed, strict=True)]


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``directions`` (d x k) holds eigenvectors over the roots of their eigenvalues."""

    centre: Centre
    eigenvalues: tuple[float, ...]
    trace: float
    vectors: np.ndarray
    directions: np.ndarray
    identity_error: float | None

    @property
    def live(self) -> int:
        """Components whose eigenvalue isn't zero to rounding."""
        return self.directions.shape[1]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of ``rows``; None where there is none."""
    distinct = write_shared(rows.where(F.size("x") > 0).select("x").distinct(), "fit-list")
    sums = _tree_sum(distinct, _counted, "<i8")
    if sums is None:
        drop_shared(distinct)
        return None
    n, d = int(sums[0]), (len(sums) - 1) // 2
    centre = Centre.of(n, [(int(h) << LOW_BITS) + int(low) for h, low in zip(sums[1 : d + 1], sums[d + 1 :], strict=True)])

    def outer(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return (c.T @ c).ravel()

    products = _tree_sum(distinct, outer, "<f8").reshape(d, d)
    covariance = (products + products.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    k = int((values > trace * d * np.finfo(float).eps).sum())
    directions = vectors[:, :k] / np.sqrt(values[:k])

    def whitened_products(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ directions
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    error = None
    if k:
        got = _tree_sum(distinct, whitened_products, "<f8") / n
        mean, second = got[:k], got[k:].reshape(k, k)
        error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    drop_shared(distinct)
    return Whitening(centre, tuple(np.maximum(values, 0.0).tolist()), trace, vectors, directions, error)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): each row's exact deviation and its whitened coordinates."""
    shared = rows.sparkSession.sparkContext.broadcast((model.centre, model.directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, directions = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            w = centre.centred(x) @ directions
            offsets = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
            deviations = pa.array(map(Decimal, centre.deviations(x)), pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, lists], ["vec_id", "deviation", "whitened"])

    return batch_map(rows.where(F.size("x") > 0), run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def components(rows: DataFrame, model: Whitening) -> DataFrame:
    """``project`` by component, with n, explained and identity_error beside each."""
    numbers = range(len(model.eigenvalues))
    explained = F.array(*(F.lit(model.eigenvalues[i] / model.trace if model.trace > 0 else None).cast("double") for i in numbers))
    return project(rows, model).select(
        "vec_id",
        F.explode(F.array(*(F.lit(i + 1) for i in numbers))).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        F.get("whitened", F.col("component") - 1).alias("whitened"),
        F.get(explained, F.col("component") - 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds, possible from some 10 ** 8 distinct vectors on, is null there and in ``deviation_text``."""
    rows = fixed_point(spread(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet")))
    model = fit(rows)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"
        return spark.createDataFrame([], schema)
    exact = F.col("deviation").cast("string").alias("deviation_text")
    found = components(rows, model)
    return found.select(*(F.expr("try_cast(deviation as bigint) as deviation") if c == "deviation" else c for c in found.columns), exact)
