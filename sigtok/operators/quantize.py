"""Exact nearest codewords: a broadcast form for small codebooks, a blocked one for large.

Ties go to the lowest code. The blocked form visits the tiles of the codebook that are within reach and keeps
each row's best, so the distance matrix never exists as a whole; results don't depend on the tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigtok.operators.arrow import matrix
from sigtok.session import small

#: The join form is for codebooks of at most so many words.
SMALL_CODEBOOK = 4096


def squared_distance(a: str, b: str) -> Column:
    terms = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def nearest(latents: DataFrame, codebook: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, code, distance) by comparing each latent with each word of a small codebook."""
    words = codebook.select("code", "vec")
    n = words.count()
    if n > SMALL_CODEBOOK:
        raise ValueError(f"{n} codewords; use nearest_blocked")
    # a bounded codebook against all rows: each row meets each word inside its own task
    book = F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("book")
    rows = latents.crossJoin(F.broadcast(words.agg(book)))
    best = F.aggregate(
        F.transform("book", lambda w: F.struct(squared_distance("z", w["vec"]).alias("d"), w["code"].alias("code"))),
        F.struct(F.lit(float("inf")).alias("d"), F.lit(-1).alias("code")),
        lambda a, x: F.when((x["d"] < a["d"]) | ((x["d"] == a["d"]) & (x["code"] < a["code"])), x).otherwise(a),
    )
    return rows.select(id_col, best.alias("best")).select(id_col, "best.code", F.col("best.d").alias("distance"))


def codebook_array(codebook: DataFrame) -> np.ndarray:
    """The codebook as a matrix on the driver; its size is the model's, not the data's."""
    rows = codebook.orderBy("code").collect()
    if [r["code"] for r in rows] != list(range(len(rows))):
        raise ValueError("codes must be 0, 1, 2, ...")
    return np.array([r["vec"] for r in rows], dtype=np.float32)


class Book:
    """A codebook in tiles of words of like length, so that most tiles are out of reach of a latent.

    The distance of two vectors is at least the difference of their lengths. Latents are taken in order of length,
    too, and visit tiles from the nearest in length on, until the bound is beyond their best word. A tile's product
    finds the few candidates; direct differences, summed dimension by dimension, decide between them, and the lowest
    code wins ties. So the result is that of comparing with every word, whatever the tiles.
    """

    def __init__(self, words: np.ndarray, block: int = 256) -> None:
        words = words.astype(np.float64)
        lengths = np.sqrt((words * words).sum(axis=1))
        self.order = np.argsort(lengths, kind="stable")
        self.words, self.lengths = words[self.order], lengths[self.order]
        self.squares = self.lengths**2
        self.starts = np.arange(0, len(words), block)
        self.ends = np.minimum(self.starts + block, len(words))
        #: Pairs of a latent and a tile that were compared.
        self.visited = 0

    def search(self, z: np.ndarray) -> np.ndarray:
        z = z.astype(np.float64)
        code = np.zeros(len(z), dtype=np.int64)
        lengths = np.sqrt((z * z).sum(axis=1))
        by_length = np.argsort(lengths, kind="stable")
        for at in range(0, len(z), 256):
            rows = by_length[at : at + 256]
            code[rows] = self._nearest(z[rows], lengths[rows])
        return code

    def _nearest(self, z: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        low, high = self.lengths[self.starts], self.lengths[self.ends - 1]
        apart = np.maximum(0, np.maximum(low[None] - lengths[:, None], lengths[:, None] - high[None]))
        best, code = np.full(len(z), np.inf), np.full(len(z), len(self.words), dtype=np.int64)
        slack = 1e-6 * (1 + lengths**2)
        for tile in np.argsort(apart.min(axis=0), kind="stable"):
            rows = np.flatnonzero(apart[:, tile] ** 2 <= best + slack)
            if not len(rows):
                if apart[:, tile].min() ** 2 > (best + slack).max():
                    break
                continue
            self.visited += len(rows)
            a, b = self.starts[tile], self.ends[tile]
            d = lengths[rows, None] ** 2 + self.squares[a:b] - 2 * (z[rows] @ self.words[a:b].T)
            rounding = slack[rows, None] + 1e-12 * self.squares[b - 1]
            r, k = np.nonzero(d <= np.minimum(d.min(axis=1), best[rows])[:, None] + rounding)
            if not len(r):
                continue
            exact = np.zeros(len(r))
            for x, w in zip(z[rows].T, self.words[a:b].T, strict=True):
                exact += (x[r] - w[k]) ** 2
            which = self.order[a:b][k]
            first = np.lexsort((which, exact, r))
            first = first[np.concatenate([[True], r[first][1:] != r[first][:-1]])]
            own, e, c = rows[r[first]], exact[first], which[first]
            better = (e < best[own]) | ((e == best[own]) & (c < code[own]))
            best[own[better]], code[own[better]] = e[better], c[better]
        return code


def search(z: np.ndarray, words: np.ndarray, block: int = 256) -> np.ndarray:
    """Lowest-index nearest word of each row, in double precision."""
    return Book(words, block).search(z)


def nearest_blocked(latents: DataFrame, words: np.ndarray, block: int = 256, id_col: str = "id") -> DataFrame:
    """(id, code) against a codebook that is sent to the workers once."""
    shared = latents.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Book(shared.value, block)
        for batch in batches:
            if batch.num_rows:
                code = book.search(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code, pa.int32())], [id_col, "code"])

    return latents.select(F.col(id_col).cast("long").alias(id_col), "z").mapInArrow(run, f"{id_col} long, code int")


def lookup(codes: DataFrame, codebook: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, code, vec) of rows (id, code); a code without a word has a null vector."""
    return codes.join(small(codebook.select("code", "vec")), "code", "left").select(id_col, "code", "vec")


def project(base: np.ndarray, w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The affine map of a base codebook, folded once before it is sent out."""
    return (base.astype(np.float32) @ w.astype(np.float32) + bias).astype(np.float32)


__all__ = ["Book", "codebook_array", "lookup", "nearest", "nearest_blocked", "project", "search", "squared_distance"]
