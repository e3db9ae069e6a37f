"""Column functions: window geometry, calibration, weights, regions. All stay in the JVM.

Single-precision results need care: Spark divides floats as doubles and widens short + float, so every
operand is cast and every quotient cast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigtok.profile import NetworkConfig, Profile


def f32(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def f64(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def chunk_count(n: Column, p: Profile) -> Column:
    """Windows of a sequence of n samples; a negative length is an error."""
    length, hop = p.chunk_samples, p.hop_samples
    more = F.floor((n - length + hop - 1) / hop) + 1
    return (
        F.when(n < 0, F.raise_error(F.lit("a sequence can't have a negative length")).cast("long"))
        .when(n == 0, 0)
        .when(n <= length, 1)
        .otherwise(more)
        .cast("long")
    )


def chunk_start(n: Column, i: Column, p: Profile) -> Column:
    """Start of window i: regular ones every hop, the last aligned to the end."""
    return F.least(i.cast("long") * p.hop_samples, F.greatest(n - p.chunk_samples, F.lit(0).cast("long"))).cast("long")


def valid_length(n: Column, start: Column, p: Profile) -> Column:
    return F.least(F.lit(p.chunk_samples).cast("long"), n - start).cast("int")


def chunk_indices(n: Column, p: Profile) -> Column:
    """0 to the last window; empty for an empty sequence, where sequence() would run backwards."""
    k = chunk_count(n, p)
    return F.when(k > 0, F.sequence(F.lit(0), (k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def adc_to_pa(adc: Column, offset: Column, scale: Column) -> Column:
    return (f32(adc) + f32(offset)) * f32(scale)


def midpoint(lo: Column, hi: Column) -> Column:
    return f32((f64(lo) + f64(hi)) * 0.5)


def half_range(lo: Column, hi: Column) -> Column:
    return f32((f64(hi) - f64(lo)) * 0.5)


def normalized(pa: Column, center: Column, half: Column, p: Profile) -> Column:
    safe = F.when(half < f32(p.normalization_epsilon), f32(1.0)).otherwise(half)
    y = F.greatest(F.least(f32((pa - center) / safe), f32(1.0)), f32(-1.0))
    return F.when(half < f32(p.normalization_epsilon), f32(0.0)).otherwise(y)


def denormalized(y: Column, center: Column, half: Column, p: Profile) -> Column:
    return F.when(half < f32(p.normalization_epsilon), center).otherwise(f32(y) * half + center)


def pa_to_adc(pa: Column, offset: Column, scale: Column) -> Column:
    """Half-even rounding in double precision, clipped to 16 bits."""
    v = F.rint(f64(pa) / f64(scale) - f64(offset))
    return F.greatest(F.least(v, F.lit(32767.0)), F.lit(-32768.0)).cast("short")


def millionths(v: Column) -> Column:
    """round(v * 1000000) of a single-precision value within [-1, 1], half away from zero, without round()'s decimals.

    The product has 44 bits at most, so no sum with a half is rounded up to the next whole number.
    """
    x = f64(v) * 1000000
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def edge_weight(t: Column, p: Profile) -> Column:
    n, o = p.chunk_samples, p.overlap_samples + 1.0
    return f32(F.least(F.lit(1.0), (t + 1) / F.lit(o), (F.lit(n) - t) / F.lit(o)))


def reflect_index(i: Column, valid: Column) -> Column:
    """Where position i of a window with ``valid`` samples reads: mirrored without repeating the edge."""
    period = F.greatest(2 * valid - 2, F.lit(1))
    at = F.pmod(i, period)
    return F.when(valid == 1, 0).when(at < valid, at).otherwise(period - at).cast("int")


def reflect_pad(values: Column, valid: Column, length: int) -> Column:
    """``values`` filled up to ``length`` by reflection."""
    more = F.transform(
        F.sequence(valid, F.lit(length - 1)), lambda i: F.element_at(values, reflect_index(i, valid) + 1)
    )
    return F.when(valid < length, F.concat(values, more)).otherwise(values)


def uuid_text(raw: Column) -> Column:
    groups = "^(.{8})(.{4})(.{4})(.{4})(.{12})$"
    return F.regexp_replace(F.lower(F.hex(raw)), groups, "$1-$2-$3-$4-$5")


def tokens_for(samples: Column, strides: Sequence[int]) -> Column:
    for s in strides:
        samples = F.floor((samples + (s - 1)) / s)
    return samples.cast("int")


def downsample_factor(strides: Column) -> Column:
    return F.aggregate(strides, F.lit(1), lambda a, s: a * s)


def band_of(bin_index: Column, config: NetworkConfig) -> Column:
    band = F.lit(len(config.band_stops()))
    for k in range(len(config.band_stops()) - 1, -1, -1):
        band = F.when(bin_index < config.band_stops()[k], k).otherwise(band)
    return band.cast("int")


def pow2_scale(bound: Column) -> Column:
    """The power of two that brings ``bound`` into [2^14, 2^15), exponents held to +-100."""
    exponent = 14 - F.floor(F.log2(bound))
    exact = F.when(bound * F.pow(F.lit(2.0), exponent) >= 2.0**15, exponent - 1).otherwise(exponent)
    exact = F.when(bound * F.pow(F.lit(2.0), exact) < 2.0**14, exact + 1).otherwise(exact)
    return F.pow(F.lit(2.0), F.greatest(F.least(exact, F.lit(100)), F.lit(-100)).cast("double"))


def hann(i: Column, length: int) -> Column:
    if length <= 1:
        return F.lit(1.0)
    return 0.5 - 0.5 * F.cos(2 * F.pi() * i / (length - 1))


REGIONS = ("interior", "seam", "tail", "edge", "short")


def region(pos: Column, n: Column, p: Profile) -> Column:
    """Where a sample stands in its read's windows; the ends of a read come before all but 'short'."""
    length, hop, overlap = p.chunk_samples, p.hop_samples, p.overlap_samples
    regular = F.floor((n - length) / hop) + 1
    in_tail = (F.pmod(n - length, F.lit(hop)) != 0) & (pos >= n - length) & (pos < (regular - 1) * hop + length)
    in_seam = (pos >= hop) & (F.floor(pos / hop) < regular) & (F.pmod(pos, F.lit(hop)) < overlap)
    return (
        F.when(n < length, "short")
        .when((pos < overlap) | (pos >= n - overlap), "edge")
        .when(in_tail, "tail")
        .when(in_seam, "seam")
        .otherwise("interior")
    )


def length_bin(n: Column) -> Column:
    return (
        F.when(n < 8192, "0-8192").when(n < 50_000, "8192-50000").when(n < 200_000, "50000-200000").otherwise("200000-inf")
    )


def payload_bytes(chunks: Column, p: Profile) -> Column:
    """Length of a stored read: 104 bytes, two floats and T two-byte codes for each window."""
    return (104 + 8 * chunks + 2 * chunks * p.tokens_per_chunk).cast("long")


def swish(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def gelu_tanh(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.sqrt(F.lit(2.0) / F.pi()) * (x + 0.044715 * x * x * x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
