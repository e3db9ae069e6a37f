"""Grouping of reads, and dictionary tables by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigtok.functions import scalar as S
from sigtok.operators.arrow import sorted_groups
from sigtok.profile import PROFILE, Profile

GROUP_CHUNKS = GROUP_READS = 4096
#: Entries that a group's dictionary may have, and bytes of all of them.
TABLE_ENTRIES = 32767
TABLE_BYTES = (4 << 20) - (64 << 10)


#: Reads of a file that are looked at together.
SPAN = 1 << 16


def _numbered(reads: DataFrame, span: int) -> DataFrame:
    """``reads`` with ``at``, gapless from 0 in each file by read_pos; one row a range of positions meets in a window."""
    ranged = reads.withColumn("part", F.floor(F.col("read_pos") / span))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n"))
    bases = bases.select("file", "part", F.coalesce(F.sum("n").over(before.partitionBy("file").orderBy("part")), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("file", "part").orderBy("read_pos")) - 1
    return ranged.withColumn("inside", inside).join(bases, ["file", "part"]).withColumn("at", F.col("base") + F.col("inside")).drop("part", "inside", "base")


def _next_starts(counts: np.ndarray, values: list[list[str]], limits: tuple[int, int, int]) -> np.ndarray:
    """For a group that starts at each read, where the next one starts, as far as these reads tell."""
    most_chunks, most_reads, most_bytes = limits
    n = len(counts)
    sums = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(n)
    ends = np.searchsorted(sums, sums[:-1] + most_chunks, side="right") - 1
    ends = np.maximum(at + 1, np.minimum(np.minimum(ends, at + most_reads), n))
    if not values:
        return ends
    # {"v":...} has six characters more than the value, which takes a separator
    sizes = [[len(x.encode()) - 6 + 1 for x in v] for v in values]
    seen: list[dict[str, int]] = [{} for _ in values]
    size, j = 0, 0
    out = np.empty(n, dtype=np.int64)
    for i in range(n):
        # a later start never ends earlier, so the window's end only moves on
        while j < ends[i]:
            new = [v[j] not in s for v, s in zip(values, seen, strict=True)]
            extra = sum(z[j] for z, x in zip(sizes, new, strict=True) if x)
            if j > i and (size + extra > most_bytes or any(len(s) + x > TABLE_ENTRIES for s, x in zip(seen, new, strict=True))):
                break
            if extra > most_bytes:
                raise ValueError("a read's run information is too large for a group")
            size += extra
            for v, s in zip(values, seen, strict=True):
                s[v[j]] = s.get(v[j], 0) + 1
            j += 1
        out[i] = j
        for v, s, z in zip(values, seen, sizes, strict=True):
            s[v[i]] -= 1
            if not s[v[i]]:
                del s[v[i]]
                size -= z[i]
    return out


def admit(
    reads: DataFrame, p: Profile = PROFILE, group_chunks: int = GROUP_CHUNKS, group_reads: int = GROUP_READS,
    table_bytes: int = TABLE_BYTES, dictionaries: list[str] | None = None, span: int = SPAN,
) -> DataFrame:
    """(file, read_pos, num_chunks, group_id): consecutive reads, a group closed before what would overfill it.

    Where a group ends depends on where it began, so a file is one chain of groups. It is followed by ranges of
    ``span`` reads: each range says, for every place where a group may reach into it, where the chain leaves it again
    and after how many groups (a group reaches at most ``group_reads`` on, and a range sees so much of the next one).
    One row a range then meets in a fold, which gives each range its true entry, and the ranges number their groups.
    ``dictionaries`` names columns whose distinct values each group has to hold, with their bytes as
    compact JSON and a separator.
    """
    dictionaries = dictionaries or []
    span, limits = max(span, group_reads), (group_chunks, group_reads, table_bytes)
    slim = reads.select(
        F.col("file") if "file" in reads.columns else F.lit("").alias("file"),
        F.col("read_pos").cast("long").alias("read_pos"),
        S.chunk_count(F.col("num_samples"), p).alias("num_chunks"),
        *(F.to_json(F.struct(F.col(c).alias("v"))).alias(f"v{k}") for k, c in enumerate(dictionaries)),
    )
    columns = ["file", "range", "at", "read_pos", "num_chunks", *(f"v{k}" for k in range(len(dictionaries)))]
    own = _numbered(slim, span).withColumn("range", F.floor(F.col("at") / span)).select(*columns)
    ahead = own.where((F.col("range") > 0) & (F.col("at") % span < group_reads)).withColumn("range", F.col("range") - 1)

    def starts(group: pa.Table) -> np.ndarray:
        values = [group.column(f"v{k}").to_pylist() for k in range(len(dictionaries))]
        return _next_starts(group.column("num_chunks").to_numpy(), values, limits)

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            then, n = starts(group), min(span, group.num_rows)
            leaves, passed = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            for i in range(n - 1, -1, -1):
                t = then[i]
                leaves[i], passed[i] = (t - n, 1) if t >= n else (leaves[t], passed[t] + 1)
            k = min(n, group_reads + 1)
            lists = [pa.array([x[:k].tolist()], pa.list_(pa.int64())) for x in (leaves, passed)]
            yield pa.RecordBatch.from_arrays([*(group.column(c)[:1].combine_chunks() for c in ("file", "range")), *lists], ["file", "range", "leaves", "passed"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, entry, base = None, 0, 0
        for batch in batches:
            rows = []
            for f, where, leaves, passed in zip(*(batch.column(k) for k in range(4)), strict=True):
                if f.as_py() != file:
                    file, entry, base = f.as_py(), 0, 0
                rows.append((file, where.as_py(), entry, base))
                if entry < len(leaves):
                    entry, base = leaves[entry].as_py(), base + passed[entry].as_py()
                else:  # a last, short range that a group reached over
                    entry -= len(leaves)
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "range", "entry", "base"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            then, i = starts(group), int(group.column("entry")[0].as_py())
            begins = []
            while i < len(then):
                begins.append(i)
                i = int(then[i])
            ids = group.column("base")[0].as_py() - 1 + np.searchsorted(np.array(begins, np.int64), np.arange(len(then)), side="right")
            parts = [group.column(c).combine_chunks() for c in ("file", "read_pos", "num_chunks")]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(ids, pa.int64())], ["file", "read_pos", "num_chunks", "group_id"])

    by_range = own.union(ahead).repartition("file", "range").sortWithinPartitions("file", "range", "at")
    links = by_range.mapInArrow(ways, "file string, range long, leaves array<long>, passed array<long>")
    entries = links.repartition("file").sortWithinPartitions("file", "range").mapInArrow(chain, "file string, range long, entry long, base long")
    placed = own.join(entries, ["file", "range"]).select(*columns, "entry", "base")
    placed = placed.repartition("file", "range").sortWithinPartitions("file", "range", "at")
    return placed.mapInArrow(numbers, "file string, read_pos long, num_chunks long, group_id long")


def group_totals(admitted: DataFrame) -> DataFrame:
    """Reads, empty reads, windows, groups and the largest group."""
    groups = admitted.groupBy("file", "group_id").agg(
        F.count(F.lit(1)).alias("r"), F.sum("num_chunks").alias("c"), F.count(F.when(F.col("num_chunks") == 0, 1)).alias("e")
    )
    return groups.agg(
        F.sum("r").alias("reads"),
        F.sum("e").alias("empty_reads"),
        F.sum("c").alias("chunks"),
        F.count(F.lit(1)).alias("groups"),
        F.max("r").alias("max_group_reads"),
        F.max("c").alias("max_group_chunks"),
    )


def dictionary(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, idx): distinct values by first appearance."""
    first = rows.groupBy(group, value).agg(F.min(order).alias("_first"))
    idx = F.row_number().over(Window.partitionBy(group).orderBy("_first")) - 1
    return first.select(group, value, idx.cast("int").alias("idx"))


def resolve(rows: DataFrame, tables: DataFrame, group: str, index: str) -> DataFrame:
    """``rows`` with the values that their indices point to; null where they point nowhere."""
    return rows.join(tables.withColumnRenamed("idx", index), [group, index], "left")


def dangling(rows: DataFrame, tables: DataFrame, group: str, index: str) -> DataFrame:
    """Rows whose index is not in their group's table."""
    return rows.join(tables.select(group, F.col("idx").alias(index)), [group, index], "left_anti")


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: what repeats of a run's information leave."""
    least = rows.groupBy(key).agg(F.min(F.struct(order, *(c for c in rows.columns if c not in (key, order)))).alias("r"))
    return least.select(key, "r.*")


__all__ = ["admit", "dangling", "dictionary", "first_rows", "group_totals", "resolve"]
