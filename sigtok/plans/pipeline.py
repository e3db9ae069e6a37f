"""Encode, decode and validate: the three flows, over reads with signal and calibration.

encode: windows are cut, normalized and encoded in the task that holds the read. decode: windows are
decoded where they are; one shuffle brings a read's segments together. validate: joins and aggregates.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sigtok.errors import SigtokError
from sigtok.functions import scalar as S
from sigtok.operators import checks, codecs, grouping, quality
from sigtok.operators.arrow import Step, chained, picked
from sigtok.operators.normalize import cutter, prepare
from sigtok.operators.stitch import by_read, joiner, stitch
from sigtok.operators.windows import chunk_plan
from sigtok.profile import PROFILE, ModelIdentity, Profile
from sigtok.schema import READ_META, READS, RUN_INFO
from sigtok.session import small
from sigtok.sources import tokens as token_files


def encode(
    reads: DataFrame, codec: codecs.Codec, p: Profile = PROFILE, batch: int = codecs.BATCH, carry: Sequence[str] = (), places: bool = False
) -> DataFrame:
    """(read_pos, seq, center, scale, codes[, start, valid], carry...) of every window, cut and encoded by one worker."""
    more = [*["start", "valid"] * places, *carry]
    step = chained(cutter(p, carry), picked("read_pos", "seq", "center", "half", "y", *more), codecs.encoder(codec, batch, more))
    columns = reads.select("read_pos", "offset", "scale", "signal", *carry)
    kinds = ["read_pos long, seq int, center float, scale float, codes array<int>", *["start long, valid int"] * places, *_kinds(columns, carry)]
    return columns.mapInArrow(step, ", ".join(kinds))


def _kinds(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"{c} {df.schema[c].dataType.simpleString()}" for c in names]


def decode(
    tokens: DataFrame, reads: DataFrame, codec: codecs.Codec, p: Profile = PROFILE, batch: int = codecs.BATCH
) -> DataFrame:
    """(read_pos, num_samples, offset, scale, signal) of all ``reads``; their signals aren't needed."""
    plan = chunk_plan(reads.select("read_pos", "num_samples"), p).select("read_pos", "seq", "start", "valid")
    ready = tokens.withColumnRenamed("scale", "half").join(plan, ["read_pos", "seq"])
    return stitch(codecs.decode_windows(ready, codec, batch), reads, p)


def _decoded(reads: DataFrame, codec: codecs.Codec, p: Profile, carry: Sequence[str] = (), with_adc: bool = False) -> DataFrame:
    """Windows through the codec and back where they are; a read's windows stay beside each other."""
    prepared = prepare(reads, p, carry, with_adc)
    kept = ["start", "valid", *["adc"] * with_adc, *carry]
    encoded = codecs.encode_windows(prepared, codec, carry=kept).withColumnRenamed("scale", "half")
    return codecs.decode_windows(encoded, codec)


def _segments(codec: codecs.Codec, p: Profile, fixed: Sequence[str] = (), with_adc: bool = False) -> Step:
    """From ``cutter``'s reads to ``joiner``'s segments: windows through the codec and back and stitched by one worker."""
    kept = ["start", "valid", "last", *["adc"] * with_adc, *fixed]
    head = ["read_pos", "seq", "center", "scale"]
    return chained(
        cutter(p, fixed, with_adc),
        picked("read_pos", "seq", "center", "half", "y", *kept),
        codecs.encoder(codec, carry=kept),
        picked(*head, *kept, "codes"),
        codecs.decoder(codec, [*head, *kept]),
        picked("read_pos", "seq", "start", "valid", "center", "scale", "last", "y", *["adc"] * with_adc, *fixed),
        joiner(p, fixed, with_adc),
    )


def roundtrip(reads: DataFrame, codec: codecs.Codec, p: Profile = PROFILE, carry: Sequence[str] = ()) -> DataFrame:
    """decode(encode(reads)) without tokens in between, where the reads are: no shuffle. ``carry`` as in ``compared``."""
    columns = reads.select("read_pos", "offset", "scale", "signal", "num_samples", *carry)
    kinds = ["read_pos long, num_samples long, offset float, scale float, signal array<smallint>", *_kinds(columns, carry)]
    return columns.mapInArrow(by_read(_segments(codec, p), carry), ", ".join(kinds))


def _gained(reads: DataFrame, carry: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """What ``compared`` reads, and the columns that go with each segment."""
    fixed = ["num_samples", "gain_offset", "gain_scale", *carry]
    named = reads.withColumns({"gain_offset": F.col("offset"), "gain_scale": F.col("scale")})
    return named.select("read_pos", "offset", "scale", "signal", *fixed), fixed


def compared(reads: DataFrame, codec: codecs.Codec, p: Profile = PROFILE, carry: Sequence[str] = ()) -> DataFrame:
    """(read_pos, segment, pa, adc, num_samples, offset, scale, carry...): a round trip beside its source.

    By segment, so that no row grows with a read beyond the source's own. Reads without samples have none. Clashing
    names in ``carry`` are the caller's to avoid; its columns are the same for a whole read.
    """
    columns, fixed = _gained(reads, carry)
    kinds = ["read_pos long, segment long, pa array<float>, adc array<smallint>", *_kinds(columns, fixed)]
    rows = columns.mapInArrow(_segments(codec, p, fixed, True), ", ".join(kinds))
    return rows.withColumnsRenamed({"gain_offset": "offset", "gain_scale": "scale"})


def segment_errors(reads: DataFrame, codec: codecs.Codec, p: Profile = PROFILE, carry: Sequence[str] = ()) -> DataFrame:
    """``quality.segment_errors`` of ``compared``, by the same worker: signals cross to Python once and don't come back."""
    columns, fixed = _gained(reads, carry)
    order = ["read_pos", "num_samples", "segment", "gain_offset", "gain_scale", "adc", "pa", *carry]
    step = chained(_segments(codec, p, fixed, True), picked(*order), quality.segment_folder(p, carry))
    return columns.mapInArrow(step, quality.segment_kinds(columns, carry))


def stored_reads(reads: DataFrame, run_info: DataFrame, tokens: DataFrame, p: Profile = PROFILE, **limits: int) -> DataFrame:
    """Rows of a token file: metadata, group, run info and the windows' tokens by read."""
    by_read = tokens.groupBy("read_pos").agg(F.sort_array(F.collect_list(F.struct("seq", "center", "scale", "codes"))).alias("t"))
    infos = grouping.first_rows(run_info.withColumn("_row", F.lit(0)), "acquisition_id", "_row").drop("_row")
    info = F.struct(*(F.col(c) for c in run_info.columns)).alias("run_info")
    with_info = reads.join(small(infos.select("acquisition_id", info)), "acquisition_id", "left")
    with_info = with_info.withColumn(
        "run_info",
        F.when(F.col("run_info").isNotNull(), F.col("run_info")).otherwise(
            F.raise_error(F.concat(F.lit("no run info "), F.coalesce("acquisition_id", F.lit("null")))).cast(
                with_info.schema["run_info"].dataType
            )
        ),
    )
    groups = grouping.admit(with_info, p, dictionaries=["run_info", "pore_type", "end_reason"], **limits)
    joined = with_info.join(groups.select("read_pos", "group_id"), "read_pos").join(by_read, "read_pos", "left")
    floats, codes = "array<float>", "array<int>"
    return joined.select(
        *(c for c in READ_META.names if c in joined.columns and c not in ("file", "acquisition_id")),
        "group_id",
        "run_info",
        S.chunk_count(F.col("num_samples"), p).alias("num_chunks"),
        F.coalesce("t.center", F.array().cast(floats)).alias("centers"),
        F.coalesce("t.scale", F.array().cast(floats)).alias("scales"),
        F.coalesce(F.flatten("t.codes"), F.array().cast(codes)).alias("codes"),
    )


def window_tokens(stored: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """Rows of a token file by window again."""
    t = p.tokens_per_chunk
    rows = stored.select(
        "read_pos", "centers", "scales", "codes", F.explode(S.chunk_indices(F.col("num_samples"), p)).alias("seq")
    )
    return rows.select(
        "read_pos",
        "seq",
        F.get("centers", F.col("seq")).alias("center"),
        F.get("scales", F.col("seq")).alias("scale"),
        F.slice("codes", F.col("seq") * t + 1, F.lit(t)).alias("codes"),
    )


def encode_file(
    spark: SparkSession, source: str, target: str, codec: str = "mean-quant", p: Profile = PROFILE, force: bool = False, batch: int = codecs.BATCH
) -> DataFrame:
    """Parquet reads (READS, with a run_info table beside them) to a token file; the report has one row.

    Reads are checked by the plan that encodes them and counted by the plan that is written, so nothing is read
    for a check or a report alone.
    """
    began = time.monotonic()
    run_info = checks.require_types(spark.read.parquet(f"{source}/run_info"), RUN_INFO, "run_info")
    for fault, what in ((checks.nulls(run_info, "acquisition_id"), "column"), (checks.violations(run_info, "acquisition_id", p), "rule")):
        if first := fault.head(1):
            raise SigtokError(f"{what} {first[0][what]} is {'null' if what == 'column' else 'broken'}", f"at run info {first[0]['acquisition_id']}")
    given = checks.require_types(spark.read.parquet(f"{source}/reads"), READS, "reads")
    reads = given.withColumns({"offset": F.col("calibration_offset"), "scale": F.col("calibration_scale")})
    checked = checks.enforce(reads, p, key="read_pos", full=True)
    stored = stored_reads(reads, run_info, encode(checked, codecs.create(codec, p), p, batch), p)
    seen = Observation("encode-file")
    n, k = F.col("num_samples"), F.col("num_chunks")
    stored = stored.observe(
        seen, F.count(F.lit(1)).alias("reads"), F.count(F.when(n == 0, 1)).alias("empty_reads"), F.coalesce(F.sum(k), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(n), F.lit(0)).alias("samples"), F.coalesce(F.max("group_id") + 1, F.lit(0)).alias("groups"),
        F.coalesce(F.sum(S.payload_bytes(k, p)), F.lit(0)).alias("payload_bytes"),
    )
    try:
        token_files.write_tokens(stored, target, p, ModelIdentity(), force)
    except PySparkException as e:
        if fault := re.search(r"(?:rule \w+ is broken|column \w+ is null) at read_pos -?\w+", str(e)):
            raise SigtokError(fault[0]) from e
        raise
    return written(spark, seen.get, began)


def written(spark: SparkSession, seen: dict[str, int], began: float) -> DataFrame:
    """The report's row: what was counted, its ratio to 16-bit samples, and the seconds since ``began``."""
    row = dict(seen) | {
        "ratio": round(2.0 * seen["samples"] / max(1, seen["payload_bytes"]), 6), "seconds": round(time.monotonic() - began, 3),
    }
    kinds = ", ".join(f"{name} {'double' if isinstance(v, float) else 'long'}" for name, v in row.items())
    return spark.createDataFrame([tuple(row.values())], kinds)


def decode_file(
    spark: SparkSession, source: str, target: str, codec: str = "mean-quant", force: bool = False, p: Profile = PROFILE
) -> DataFrame:
    """A token file to Parquet reads. Before anything is decoded, the file has to be of this version's model and of the
    profile ``p``, and all its end reasons known. Windows are read as rows, so no task holds a read's codes."""
    header = token_files.read_header(source)
    if header.model != ModelIdentity():
        raise SigtokError(f"the file was written by model {header.model.repo_id}")
    if header.profile != p:
        other = [name for name, v in header.profile.to_json_dict().items() if v != p.to_json_dict()[name]]
        raise SigtokError(f"the file's profile differs in {', '.join(other)}")
    stored = token_files.read_tokens(spark, source, with_codes=False)
    rules = [r for r in checks.RULES if r.name == "end_reason"]
    if first := checks.violations(stored, "read_pos", p, rules).head(1):
        raise SigtokError("the file has an end reason that isn't known", f"at read {first[0]['read_pos']}")
    reads = stored.select(*(c for c in READ_META.names if c in stored.columns), F.col("run_info.acquisition_id").alias("acquisition_id"))
    reads = reads.withColumns({"offset": F.col("calibration_offset"), "scale": F.col("calibration_scale")})
    tokens = token_files.read_windows(spark, source).select("read_pos", "seq", "center", "scale", "codes")
    signals = decode(tokens, reads, codecs.create(codec, p), p).select("read_pos", "signal")
    mode = "overwrite" if force else "error"
    reads.drop("offset", "scale").join(signals, "read_pos").withColumn("file", F.lit(target)).write.mode(mode).parquet(f"{target}/reads")
    infos = stored.select("run_info.*", F.col("read_pos").alias("_pos"))
    grouping.first_rows(infos, "acquisition_id", "_pos").drop("_pos").write.mode(mode).parquet(f"{target}/run_info")
    return report(reads, p)


def report(reads: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """Reads, empty reads, windows, samples."""
    n = F.col("num_samples")
    return reads.agg(
        F.count(F.lit(1)).alias("reads"),
        F.count(F.when(n == 0, 1)).alias("empty_reads"),
        F.coalesce(F.sum(S.chunk_count(n, p)), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum(n), F.lit(0)).alias("samples"),
    )


def validate(original: DataFrame, back: DataFrame, p: Profile = PROFILE) -> dict[str, DataFrame]:
    """The quality report's tables, by name."""
    reads = quality.read_errors(quality.errors(original, back), p)
    tables: dict[str, Callable[[], DataFrame]] = {
        "input": lambda: quality.input_stats(original, p),
        "by_region": lambda: quality.by_region(reads),
        "percentiles": lambda: quality.mae_percentiles(reads),
        "by_length": lambda: quality.by_length(reads),
        "by_level": lambda: quality.by_level(reads),
        "mae_over_std": lambda: quality.mae_over_std(reads),
    }
    return {name: make() for name, make in tables.items()}
