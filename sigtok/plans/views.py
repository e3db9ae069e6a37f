"""The engine's tables as SQL views: reads, chunks, tokens and codebook."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sigtok.operators import codecs
from sigtok.operators.windows import chunk_plan, with_counts
from sigtok.plans import pipeline
from sigtok.profile import PROFILE, Profile
from sigtok.sources import adapters


def register(spark: SparkSession, sf_dir: str, prefix: str = "sigtok_", codec: str = "mean-quant", p: Profile = PROFILE) -> dict[str, str]:
    """Makes the views over the tables of a folder; their names by table. Nothing is read until they are."""
    reads = adapters.read_lengths(spark, sf_dir)
    tables = {
        "reads": with_counts(reads, p),
        "chunks": chunk_plan(reads, p),
        "tokens": pipeline.encode(adapters.document_reads(spark, sf_dir), codecs.create(codec, p), p),
        "codebook": adapters.codebook(spark, sf_dir),
    }
    names = {}
    for table, df in tables.items():
        names[table] = f"{prefix}{table}"
        df.createOrReplaceTempView(names[table])
    return names
