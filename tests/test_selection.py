"""Quantiles by selection against numpy, on ties, wide ranges and groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtok.operators import quality, selection

MARKS = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def table(spark, values, parts=3):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "v double").repartition(parts)


RNG = np.random.default_rng(11)
CASES = {
    "one": [7.25],
    "two": [1.0, 2.0],
    "ties": [3.0] * 500 + [1.0] * 100 + [9.0],
    "all equal": [-2.5] * 50,
    "uniform": RNG.uniform(-5, 5, 2000).tolist(),
    "heavy tail": np.exp(RNG.normal(0, 40, 1500)).tolist(),
    "widest": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0],
    "smallest": [0.0, 5e-324, 1e-323, 1.5e-323],
    "integers": RNG.integers(-(2**50), 2**50, 1000).tolist(),
    "near": [1.0 + k * 2.0**-52 for k in range(300)],
}


@pytest.mark.parametrize("case", CASES)
def test_quantiles_equal_numpy(spark, case):
    values = CASES[case]
    got = selection.quantiles(table(spark, [*values, None, float("nan")]), "v", MARKS).first()
    with np.errstate(over="ignore", invalid="ignore"):
        want = np.quantile(np.array(values, float), list(MARKS.values()))
    for name, w in zip(MARKS, want):
        if np.isfinite(w):
            assert got[name] == pytest.approx(w, rel=1e-12), name


def test_groups_with_ties_and_a_hot_one(spark):
    rows = [("hot", float(k % 7)) for k in range(3000)] + [(None, 1.0), (None, 4.0), ("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r for r in selection.quantiles(df, "v", MARKS, ["g"]).collect()}
    assert set(got) == {"hot", None, "one", "none"}
    for g in ("hot", None, "one"):
        want = np.quantile([v for k, v in rows if k == g], list(MARKS.values()))
        assert [got[g][m] for m in MARKS] == pytest.approx(want.tolist())
    assert all(got["none"][m] is None for m in MARKS)


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 0)
    df = spark.range(600).select((F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), F.lit(1000)).alias("v"))
    got = {r.g: (r.a, r.b) for r in selection.quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).collect()}
    for g in range(3):
        want = np.quantile([r.v for r in df.where(F.col("g") == g).collect()], [0.25, 0.9])
        assert got[g] == pytest.approx(tuple(want))


def test_no_values(spark):
    got = selection.quantiles(table(spark, []), "v", MARKS).first()
    assert all(got[m] is None for m in MARKS)
    assert selection.quantiles(table(spark, [None]), "v", MARKS, ["v"]).count() == 1
    with pytest.raises(Exception, match="infinite"):
        selection.quantiles(table(spark, [1.0, float("inf")]), "v", MARKS).collect()


def test_no_task_gets_more_than_buckets(spark):
    """What is shuffled is counts by bucket, however many rows there are and whatever they repeat."""
    df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(3) * 100).alias("v"))
    rows = selection._inside(df, {(0.0, 100.0)})
    counts = rows.groupBy(selection._bucket(F.col("v"), F.col("lo"), F.col("hi"))).count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Sort " not in plan and "Python" not in plan
    assert counts.count() <= selection.BUCKETS


def test_levels_and_statistics_use_them(spark):
    rows = [(k, int(n)) for k, n in enumerate(RNG.integers(0, 60_000, 300))]
    lengths = spark.createDataFrame(rows, "read_pos long, num_samples long")
    s = quality.input_stats(lengths).first()
    n = np.array([x for _, x in rows])
    assert [s.p5, s.p50, s.p95] == np.floor(np.quantile(n, [0.05, 0.5, 0.95])).astype(int).tolist()
    std = RNG.uniform(0, 10, 200).round(1)
    reads = spark.createDataFrame([(float(x), float(2 * x)) for x in std], "std double, mae double")
    edges = np.quantile(std, [0.25, 0.5, 0.75])
    level = np.digitize(std, edges)
    got = {r.quarter: (r.reads, r.pa_std_mean) for r in quality.by_level(reads).collect()}
    assert got == {q + 1: (int((level == q).sum()), pytest.approx(std[level == q].mean())) for q in range(4)}
    assert quality.by_level(reads.where("false")).count() == 0
