"""Token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned and sorted by id before they are encoded, so that each file holds one
range of ids in ascending order. The ids are an array<int> column, which ORC writes with its run-length
encoding; row indexes and a Bloom filter on ``doc_id`` let readers skip stripes and row groups, and
splits of a file are read by stripe.

Defined results: a null text is an empty one and has the end id alone; rows of equal doc_id stay next to
each other in one file, those of a null one come first; texts of any length are one row; other columns are ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigtok.llm.common import batch_map, documents, shared_path, whole_text, write_shared
from sigtok.llm.wordcache import ByteLevelUnits, loaded

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SCHEMA = "doc_id long, row long, ids array<int>"
ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}


def id_lists(parts: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> array of packed ids."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, row, ids) in ascending doc_id order; ``row`` counts from 0 in each partition."""
    ordered = (
        df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, row = loaded(ByteLevelUnits, vocabulary), 0
        for batch in batches:
            ids = [units.encode(t.as_py()) + end for t in batch.column(1)]
            rows = np.arange(row, row + batch.num_rows, dtype=np.int64)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows), id_lists(ids)], ["doc_id", "row", "ids"])

    return batch_map(ordered, run, SCHEMA)


def write_tokens(df: DataFrame, path: str, **kwargs: str) -> None:
    """Encodes the texts of ``df`` into ORC files at ``path``."""
    encode(df, **kwargs).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with the file of each; filters on doc_id reach the files' indexes."""
    return spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored row, start counting the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "row", "file", "n_tokens", "ids_crc32"],
            )

    stored = read_tokens(spark, path)
    rows = write_shared(
        batch_map(stored, run, "doc_id long, row long, file string, n_tokens long, ids_crc32 long"), "token-index"
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row per file meets in one window partition
    files = (
        rows.groupBy("file")
        .agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"))
        .withColumn("base", F.coalesce(F.sum("n").over(before.orderBy("first")), F.lit(0)))
        .select("file", "base")
    )
    inside = F.coalesce(F.sum("n_tokens").over(before.partitionBy("file").orderBy("row")), F.lit(0))
    return (
        rows.withColumn("inside", inside)
        .join(files, "file")
        .select("doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens-orc")
    write_tokens(documents(spark, sf_dir), path)
    return token_index(spark, path)
