"""Exact quantiles by distributed selection.

Values fall into buckets of equal width between their least and greatest; counts by bucket say in which one
a rank lies, and the next round looks at that bucket's own least and greatest value. It ends when those
are equal. A round is one aggregation with at most BUCKETS rows for each interval and task: no value is
sorted or moved, and a value that a third of all rows have is a count like any other. Each round parts an
interval's least from its greatest value, so rounds end; a few are usual, as the widths shrink by BUCKETS.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigtok.session import stored

BUCKETS = 4096
#: Tables of so many intervals may be broadcast.
SMALL = 100_000


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """0 to BUCKETS - 1, rising with v; ``lo`` and ``hi`` never share one."""
    share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _located(values: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """The values that lie in an interval that is still open, with its ends; intervals of a group are disjoint."""
    intervals = open_.select(*by, "lo", "hi").distinct()
    if intervals.count() <= SMALL:
        intervals = F.broadcast(intervals)
    same = reduce(lambda a, b: a & b, (values[c].eqNullSafe(intervals[c]) for c in by))
    return values.join(intervals, same & F.col("v").between(F.col("lo"), F.col("hi"))).select(
        *(values[c] for c in by), "v", "lo", "hi"
    )


def _inside(values: DataFrame, intervals: set[tuple[float, float]]) -> DataFrame:
    """``_located`` without groups, for a few intervals."""
    at = F.lit(None).cast("struct<lo:double,hi:double>")
    for lo, hi in intervals:
        at = F.when(F.col("v").between(lo, hi), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))).otherwise(at)
    return values.select("v", at.alias("at")).where("at is not null").select("v", "at.lo", "at.hi")


def _counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Located values by bucket: how many, how many in the buckets before, the least and the greatest."""
    counts = rows.groupBy(*by, "lo", "hi", _bucket(F.col("v"), F.col("lo"), F.col("hi")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("greatest")
    )
    along = Window.partitionBy(*by, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("c").over(along), F.lit(0)))


def _whole(values: DataFrame, marks: Mapping[str, float]) -> DataFrame:
    """Quantiles of all values: a job for the bounds and one a round, which brings back a row for each rank at most."""
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    places = {name: q * (n - 1) for name, q in marks.items()}
    # rank -> (rank within the interval, its ends)
    ranks = {r: (r, low, high) for at in places.values() for r in (math.floor(at), math.ceil(at))} if n else {}
    while open_ := {r: t for r, t in ranks.items() if t[1] < t[2]}:
        counts = _counts(_inside(values, {(lo, hi) for _, lo, hi in open_.values()}), [])
        holds = (
            (F.col("lo") == lo) & (F.col("hi") == hi) & (F.col("before") <= k) & (k < F.col("before") + F.col("c"))
            for k, lo, hi in open_.values()
        )
        found = counts.where(reduce(lambda a, b: a | b, holds)).collect()
        for r, (k, lo, hi) in open_.items():
            row = next(x for x in found if (x["lo"], x["hi"]) == (lo, hi) and x["before"] <= k < x["before"] + x["c"])
            ranks[r] = k - row["before"], row["least"], row["greatest"]
    row = []
    for at in places.values():
        if n:
            a, b = ranks[math.floor(at)][1], ranks[math.ceil(at)][1]
            row.append(a + (b - a) * (at - math.floor(at)))
        else:
            row.append(None)
    return values.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{name}` double" for name in marks))


def quantiles(df: DataFrame, value: str | Column, marks: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., a column for each of ``marks``): quantiles with linear interpolation between ranks.

    Nulls and NaN don't count; a group, or a table, without values has null quantiles (a group without any
    row has none). Integers count as doubles. Infinite values are errors. ``df`` is read in each round, so give
    a stored table where it is dear.
    """
    groups, by = list(by), [f"group{k}" for k in range(len(by))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    v = F.when(F.abs(v) == float("inf"), F.raise_error(F.lit("quantiles of infinite values")).cast("double")).otherwise(v)
    all_values = df.select(*(F.col(g).alias(k) for g, k in zip(groups, by, strict=True)), F.when(~F.isnan(v), v).alias("v"))
    values = all_values.where("v is not null")
    if not by:
        return _whole(values, marks)
    bounds = all_values.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = [F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for name, q in marks.items()]
    targets = bounds.withColumn("mark", F.explode(F.array(*place))).withColumn("rank", F.explode(F.array(F.floor("mark.at"), F.ceil("mark.at"))))
    targets = targets.select(
        *by, F.col("mark.name").alias("name"), F.col("mark.at").alias("at"), F.col("rank").alias("side"), F.col("rank"), "lo", "hi"
    ).distinct()
    targets = stored(targets, "quantile-targets")
    while (open_ := targets.where("lo < hi")).head(1):
        t, c = open_.alias("t"), _counts(_located(values, open_, by), by).alias("c")
        same = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "lo", "hi"]))
        inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))
        found = t.join(c, same & inside).select(
            *(F.col(f"t.{k}") for k in by), "name", "at", "side", (F.col("rank") - F.col("before")).alias("rank"),
            F.col("least").alias("lo"), F.col("greatest").alias("hi"),
        )
        targets = stored(targets.where("lo = hi or lo is null").unionByName(found), "quantile-targets")

    def end(name: str, side: Column) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("lo")))

    def between(name: str) -> Column:
        low, high = end(name, F.floor("at")), end(name, F.ceil("at"))
        share = F.max(F.when(F.col("name") == name, F.col("at") - F.floor("at")))
        return (low + (high - low) * share).alias(name)

    out = targets.groupBy(*by).agg(*(between(name) for name in marks))
    return out.select(*(F.col(k).alias(g) for g, k in zip(groups, by, strict=True)), *marks)
