"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scan, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last keep the columns of ``docs``; where a text changes, n_chars follows it. Documents go only by
rules that reject them (quality), by being left with white space alone (line dedup) or as later copies
(near-dedup). Rows of one doc_id and text are treated alike; empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm import linedup, neardup, packing, quality, secretscan
from sigtok.llm.common import documents, limit_batches, write_shared


#: Stages of a pipeline follow each other in the same executors, whose memory they share with each other's workers.
BATCH_BYTES = 1 << 20
CACHE_SHARE = 4


def _recounted(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with n_chars of its texts."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return df.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are; those that they reject go."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs of 50 words and more go; so do documents of which only white space is left."""
    limit_batches(spark, BATCH_BYTES)
    return _recounted(linedup.drop_repeats(docs), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: five words, 80 percent."""
    limit_batches(spark, BATCH_BYTES)
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    limit_batches(spark, BATCH_BYTES)
    return _recounted(secretscan.redact(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens; the columns are the packing's own."""
    limit_batches(spark, BATCH_BYTES)
    return packing.pack(docs, CACHE_SHARE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Neither the packing plan nor the token ids can be given in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, each one's result written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
