"""Validation rules. Each is a named condition that good rows meet; violations are rows, or an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigtok.errors import SigtokError
from sigtok.functions import scalar as S
from sigtok.profile import PROFILE, Profile
from sigtok.schema import END_REASONS, RUN_INFO_TEXTS

MAX_TEXT = 1 << 20
MAX_SAMPLES = 1 << 40
MAX_PAIRS = 32767


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


@dataclass(frozen=True)
class Rule:
    """``good`` gives the condition; ``needs`` are the columns it reads."""

    name: str
    needs: tuple[str, ...]
    good: Callable[[Profile], Column]


def _pairs_ok(c: str) -> Column:
    return (F.size(c) <= MAX_PAIRS) & F.forall(c, lambda x: x["key"].isNotNull() & x["value"].isNotNull())


RULES = (
    Rule(
        "calibration",
        ("offset", "scale"),
        lambda p: finite(S.f32(F.col("offset"))) & finite(S.f32(F.col("scale"))) & (S.f32(F.col("scale")) != 0),
    ),
    Rule("extrema", ("lo", "hi"), lambda p: finite(F.col("lo")) & finite(F.col("hi"))),
    Rule("sample_rate", ("sample_rate",), lambda p: F.col("sample_rate") == p.sample_rate_hz),
    Rule("read_id", ("read_id",), lambda p: F.octet_length("read_id") == 16),
    Rule("pore_type", ("pore_type",), lambda p: F.octet_length("pore_type") <= MAX_TEXT),
    Rule("end_reason", ("end_reason",), lambda p: F.col("end_reason").isin(*END_REASONS)),
    Rule("context_tags", ("context_tags",), lambda p: _pairs_ok("context_tags")),
    Rule("tracking_id", ("tracking_id",), lambda p: _pairs_ok("tracking_id")),
    Rule(
        "run_info_texts",
        RUN_INFO_TEXTS,
        lambda p: reduce(lambda a, b: a & b, (F.octet_length(c) <= MAX_TEXT for c in RUN_INFO_TEXTS)),
    ),
    Rule("signal_length", ("signal", "num_samples"), lambda p: F.size("signal") == F.col("num_samples")),
    Rule("num_samples", ("num_samples",), lambda p: (F.col("num_samples") >= 0) & (F.col("num_samples") <= MAX_SAMPLES)),
    Rule(
        "num_chunks",
        ("num_chunks", "num_samples"),
        lambda p: F.col("num_chunks") == S.chunk_count(F.greatest("num_samples", F.lit(0)), p),
    ),
    Rule("window_stats", ("center", "half"), lambda p: finite(F.col("center")) & finite(F.col("half")) & (F.col("half") >= 0)),
    Rule(
        "codes",
        ("codes",),
        lambda p: (F.size("codes") == p.tokens_per_chunk)
        & (F.array_min("codes") >= 0)
        & (F.array_max("codes") < p.codebook_size),
    ),
    Rule("decoded", ("y",), lambda p: ~F.exists("y", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))),
)


def applicable(df: DataFrame) -> list[Rule]:
    return [r for r in RULES if set(r.needs) <= set(df.columns)]


def violations(df: DataFrame, key: str = "read_pos", p: Profile = PROFILE, rules: list[Rule] | None = None) -> DataFrame:
    """(key, rule) for each broken rule of each row; nulls in a needed column break the rule."""
    chosen = rules if rules is not None else applicable(df)
    broken = F.array_compact(
        F.array(*(F.when(~F.coalesce(r.good(p), F.lit(False)), F.lit(r.name)) for r in chosen)).cast("array<string>")
    )
    return df.select(key, F.explode(broken).alias("rule"))


def nulls(df: DataFrame, key: str = "read_pos") -> DataFrame:
    """(key, column) for each null in a column that has to be preserved."""
    names = [c for c in df.columns if c != key]
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in names)))
    return df.select(key, F.explode(missing).alias("column"))


def enforce(
    df: DataFrame, p: Profile = PROFILE, rules: list[Rule] | None = None, key: str | None = None, full: bool = False
) -> DataFrame:
    """``df`` itself; a row that breaks a rule raises an error that names it when the row is computed.

    With ``key`` the error says which row. ``full`` makes a null in any column an error too.
    """
    chosen = rules if rules is not None else applicable(df)
    where = F.concat(F.lit(f" at {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))) if key else F.lit("")
    ok = F.lit(True)
    for c in df.columns if full else ():
        fault = F.raise_error(F.concat(F.lit(f"column {c} is null"), where)).cast("boolean")
        ok = ok & F.when(F.col(c).isNotNull(), True).otherwise(fault)
    for r in chosen:
        good = F.coalesce(r.good(p), F.lit(False))
        ok = ok & F.when(good, True).otherwise(F.raise_error(F.concat(F.lit(f"rule {r.name} is broken"), where)).cast("boolean"))
    return df.where(ok)


def require_types(df: DataFrame, schema: StructType, about: str) -> DataFrame:
    """``df``, if it has the columns of ``schema`` in their types, times as whole milliseconds among them."""
    have = {f.name: f.dataType for f in df.schema}
    for f in schema.fields:
        if f.name not in have:
            raise SigtokError(f"{about} has no column {f.name}")
        # arrays may allow nulls here; values are looked at row by row
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise SigtokError(f"{about}.{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df


def tree_difference(want: DataFrame, have: DataFrame) -> DataFrame:
    """(path, problem) between two tables (path, shape, dtype): missing, unexpected or mismatched."""
    missing = want.join(have, "path", "left_anti").select("path", F.lit("missing").alias("problem"))
    extra = have.join(want, "path", "left_anti").select("path", F.lit("unexpected").alias("problem"))
    right = have.select("path", F.col("shape").alias("s2"), F.col("dtype").alias("d2"))
    both = want.join(right, "path")
    wrong = both.where(~(F.col("shape").eqNullSafe(F.col("s2")) & F.col("dtype").eqNullSafe(F.col("d2"))))
    return missing.union(extra).union(wrong.select("path", F.lit("mismatched").alias("problem")))
