"""Queries that go through files, the network and streams."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigtok.functions import scalar as S
from sigtok.operators import checks, codecs, network, quality
from sigtok.operators.windows import chunk_plan, samples
from sigtok.plans import pipeline
from sigtok.profile import SMALL, NetworkConfig, Profile
from sigtok.schema import END_REASONS, PAIRS, READ_META, RUN_INFO, RUN_INFO_RANGES, RUN_INFO_TEXTS
from sigtok.session import small, stored, work_path
from sigtok.sources import adapters, tokens
from sigtok.streaming import windows as streams


#: Floats that must come back bit by bit; every eighth read has one of them in a field.
ODD_FLOATS = ("-0.0", "Infinity", "-Infinity", "NaN")


def _field(name: str, kind: T.DataType) -> Column:
    """A value of a field's whole range by the hash of the read and the field's name."""
    h = F.xxhash64("read_pos", F.lit(name))
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(f"{name} äß漢 "), F.pmod(h, F.lit(3)).cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.pmod(h, F.lit(2)) == 0
    if isinstance(kind, T.FloatType):
        odd = F.get(F.array(*(F.lit(x).cast("float") for x in ODD_FLOATS)), F.pmod(h, F.lit(8 * len(ODD_FLOATS))).cast("int"))
        return F.coalesce(odd, (h / 2**40).cast("float"))
    bits = min(62, 8 * tokens.META[name].itemsize)
    return F.pmod(h, F.lit(1 << bits)).cast(kind)


def full_reads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Event reads with every metadata field, and their run infos: two, made of each field's name and type."""
    by_hash = {f.name: _field(f.name, f.dataType) for f in READ_META.fields if f.name in tokens.META.names or f.name == "pore_type"}
    which = F.pmod("read_pos", F.lit(2)).cast("string")
    given = by_hash | {
        "file": F.lit("events"),
        "read_id": F.unhex(F.md5(F.col("read_pos").cast("string"))),
        "num_samples": F.col("num_samples"),
        "calibration_offset": F.col("offset"),
        "calibration_scale": F.col("scale"),
        "end_reason": F.element_at(F.array(*map(F.lit, END_REASONS)), (F.pmod("read_pos", F.lit(len(END_REASONS))) + 1).cast("int")),
        "acquisition_id": F.concat(F.lit("run-"), which),
    }
    reads = adapters.event_reads(spark, sf).withColumns(given).select(*READ_META.names, "signal", "offset", "scale")
    infos = []
    for k in range(2):
        row = {n: f"{n} äß漢" for n in RUN_INFO_TEXTS} | {n: bounds[k] for n, bounds in RUN_INFO_RANGES.items()}
        row |= {"acquisition_id": f"run-{k}", "sample_rate": SMALL.sample_rate_hz}
        row |= {f.name: [("twice", "a"), ("twice", "b"), ("", "")][k:] for f in RUN_INFO.fields if f.dataType == PAIRS}
        infos.append(tuple(row[n] for n in RUN_INFO.names))
    return reads, spark.createDataFrame(infos, RUN_INFO)


def _plain_path(spark: SparkSession, name: str) -> str:
    """A shared path as token files take it: mounted like any folder, without a scheme; its folder exists."""
    path = work_path(spark, name).removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _token_file(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    """The event reads as rows of a token file, and the file."""
    reads, run_info = full_reads(spark, sf)
    codec = codecs.MeanQuant(SMALL)
    stored = pipeline.stored_reads(reads, run_info, pipeline.encode(reads, codec, SMALL), SMALL, group_chunks=64, group_reads=40)
    path = _plain_path(spark, "tokens")
    tokens.write_tokens(stored, path, SMALL)
    return stored, path


def token_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    stored, path = _token_file(spark, sf)
    back = tokens.read_tokens(spark, path)
    names = [c for c in stored.columns if c != "read_pos"]
    right = back.select("read_pos", *(F.col(c).alias(f"_{c}") for c in names))
    both = stored.join(right, "read_pos", "full")
    counts = [F.count(F.when(~quality.same(F.col(c), F.col(f"_{c}")), 1)).alias(c) for c in names]
    return both.agg(F.count(F.lit(1)).alias("reads"), *counts)


def token_window_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a token file, read as rows of their own: no row holds a read's codes."""
    return tokens.read_windows(spark, _token_file(spark, sf)[1])


def token_read_range(spark: SparkSession, sf: str) -> DataFrame:
    """The middle half of a token file's reads; groups outside it are not read."""
    path = _token_file(spark, sf)[1]
    n = tokens.read_header(path).read_count
    rows = tokens.read_tokens(spark, path, with_codes=False)
    return rows.where((F.col("read_pos") >= n // 4) & (F.col("read_pos") < n - n // 4))


#: Windows that the subset is cut at.
SUBSET = 100


def token_subset(spark: SparkSession, sf: str) -> DataFrame:
    """The first reads of a token file up to SUBSET windows, as a token file of their own."""
    path, part = _token_file(spark, sf)[1], _plain_path(spark, "tokens-subset")
    tokens.write_subset(path, part, SUBSET)
    return tokens.read_tokens(spark, part)


def faults() -> dict[str, dict[str, Column]]:
    """How a read is made to break each rule."""
    return {
        "calibration": {"scale": F.lit(0.0)},
        "sample_rate": {"sample_rate": F.lit(4000)},
        "read_id": {"read_id": F.lit(b"short")},
        "pore_type": {"pore_type": F.repeat(F.lit("é"), (1 << 19) + 1)},
        "end_reason": {"end_reason": F.lit("odd")},
        "context_tags": {"context_tags": F.array(F.struct(F.lit("key").alias("key"), F.lit(None).cast("string").alias("value")))},
        "tracking_id": {"tracking_id": F.array_repeat(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value")), 32768)},
        "run_info_texts": {"sample_id": F.repeat(F.lit("x"), (1 << 20) + 1)},
        "signal_length": {"signal": F.concat("signal", F.array(F.lit(0).cast("smallint")))},
        "num_samples": {"num_samples": F.lit(-1).cast("long"), "num_chunks": F.lit(0).cast("long"), "signal": F.lit(None).cast("array<smallint>")},
        "num_chunks": {"num_chunks": F.col("num_chunks") + 1},
        "extrema": {"lo": F.lit(float("-inf"))},
        "window_stats": {"half": F.lit(-1.0).cast("float")},
        "codes": {"codes": F.array_repeat(F.lit(65536), 16)},
        "decoded": {"y": F.array(F.lit(float("nan")).cast("float"))},
    }


def faulty_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Event reads with everything that rules look at, each with the fault of its number, or none."""
    reads, run_info = full_reads(spark, sf)
    infos = run_info.select(*(c for c in run_info.columns if c not in reads.columns or c == "acquisition_id"))
    whole = reads.join(small(infos), "acquisition_id").withColumns(
        {
            "num_chunks": S.chunk_count(F.col("num_samples"), SMALL), "lo": F.lit(0.0).cast("float"), "hi": F.lit(1.0).cast("float"),
            "center": F.lit(0.5).cast("float"), "half": F.lit(0.5).cast("float"),
            "codes": F.array_repeat(F.lit(7), SMALL.tokens_per_chunk), "y": F.array(F.lit(0.5).cast("float")),
        }
    )
    known = faults()
    which = F.pmod("read_pos", F.lit(len(known) + 1))
    changed: dict[str, Column] = {}
    for k, columns in enumerate(known.values()):
        for name, value in columns.items():
            kind = whole.schema[name].dataType
            changed[name] = F.when(which == k, value.cast(kind)).otherwise(changed.get(name, F.col(name)))
    return whole.select(*(changed.get(c, F.col(c)).alias(c) for c in whole.columns))


def fault_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Reads by the rule that they break."""
    return checks.violations(faulty_reads(spark, sf), "read_pos", SMALL).groupBy("rule").agg(F.count(F.lit(1)).alias("reads"))


#: A network small enough for a check on processors: 64 samples to 16 tokens.
TINY = NetworkConfig(
    enc_channels=(4, 8, 8), enc_down_strides=(2, 2), enc_stage_num_res_blocks=(1, 2), latent_dim=8, latent_bilstm_layers=1,
    latent_bilstm_hidden_dim=4, quantizer_dim=8, codebook_size=64, dec_channels=(8,), decoder_dim=8, decoder_intermediate_dim=16,
    decoder_num_layers=2, decoder_pos_net_attention_heads=2, istft_n_fft=16, istft_hop_length=4, residual_correction_hidden_dim=4,
)


def network_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Event reads through an untrained network of random weights: sizes are right, errors are what they are."""
    p = Profile.of(64, 16, TINY.tokens_for(64), TINY.codebook_size)
    codec = network.NetworkCodec(network.Network(TINY, network.random_weights(TINY, 5)))
    errs = pipeline.segment_errors(adapters.event_reads(spark, sf), codec, p)
    return quality.by_region(errs).select("region", "samples", F.round("mae_pa", 2).alias("mae_pa"))


def streamed(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of all event reads as a stream, out of order: windows that the batch plan has, and those it hasn't."""
    reads = adapters.event_reads(spark, sf)
    flat = samples(reads).select("read_pos", F.col("pos").cast("long").alias("pos"), "adc", (F.col("pos") == F.col("num_samples") - 1).alias("last"))
    flat = flat.withColumn("at", F.timestamp_seconds(F.col("pos") + 1_600_000_000))
    source, target, mark = (work_path(spark, n) for n in ("samples", "stream-windows", "stream-state"))
    # each micro-batch has a part of every stretch, in as many files as there are cores, and the ends come first
    part = F.when(F.col("last"), 0).otherwise(F.pmod(F.xxhash64("read_pos", "pos"), F.lit(4)))
    flat, files = stored(flat, "stream-samples"), spark.sparkContext.defaultParallelism
    for k in range(4):
        flat.where(part == k).repartition(files).sortWithinPartitions(F.xxhash64("pos")).write.mode("append").parquet(source)
    stream = streams.stream_reads(spark, source, "read_pos long, pos long, adc smallint, last boolean, at timestamp", files)
    with streams.state_store(spark):
        q = (
            streams.sample_windows(stream, SMALL)
            .writeStream.format("parquet")
            .option("path", target)
            .option("checkpointLocation", mark)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
    got = spark.read.schema(streams.OUTPUT).parquet(target)
    plan = chunk_plan(reads, SMALL)
    want = plan.select("read_pos", "seq", "start", "valid", F.slice("signal", F.col("start").cast("int") + 1, F.col("valid")).alias("want"))
    both = got.join(want, ["read_pos", "seq", "start", "valid"], "full")
    same = S.f64(F.col("samples").eqNullSafe(F.col("want")).cast("int"))
    return both.agg(F.count(F.lit(1)).alias("windows"), F.sum(same).cast("long").alias("equal"))
