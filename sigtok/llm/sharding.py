"""Sharding: indivisible groups into the fewest shards of a fixed capacity by best-fit decreasing.

Groups are taken by falling size; each enters the bin with the tightest remaining capacity that still
holds it. Bins are kept in a balanced search tree by (remaining capacity, number). A group larger than
the even share of bytes has a shard of its own, and the others share the remaining shards evenly.

At cluster size the groups themselves never come to the driver. Groups of one size are alike, so the
plan is made from the counts of groups by size alone and is that of best fit over all groups. Sizes that
differ add up to at most all bytes, so there are at most sqrt(2 * bytes) of them: 245 000 at 30 GB.
Groups are numbered inside their size and look up their run; rows of the at most ``shards * FINE``
largest groups get their shard by a broadcast, so that a hot text isn't shuffled to one task.

Defined results: a null text is an empty group key with 0 bytes of text; equal texts share a shard;
equal rows are numbered in any order among themselves; a null doc_id stays null; a text's length is its bytes, however
many; an empty table gives an empty result; columns
of the input that have other names are ignored.
"""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import documents, ordinals, small, whole_text, write_shared

#: Groups number start to stop - 1 of one size and their bin: (size, start, stop, bin).
Run = tuple[int, int, int, int]
SHARDS = 40
#: Rows of a group of more than 1/FINE of a shard don't shuffle to their group.
FINE = 500
#: Bytes that each row has besides its text.
ROW_BYTES = 16


class CapacityTree:
    """A treap of (remaining capacity, bin): balanced by random priorities of a fixed seed."""

    def __init__(self) -> None:
        self._root: list | None = None
        self._rng = random.Random(7)

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._rng.random(), None, None]), right)

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Takes out the smallest key of at least (size, 0)."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a if b is None else b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_runs(counts: dict[int, int], capacity: int, most: int | None = None) -> list[Run] | None:
    """Best-fit decreasing over units given as counts by size; None if more than ``most`` bins were needed.

    The tightest bin that holds a unit stays the tightest for further units of that size until it is full.
    Units larger than the capacity are refused.
    """
    bins, tree, runs = 0, CapacityTree(), []
    for size, n in sorted(counts.items(), reverse=True):
        if size > capacity:
            raise ValueError(f"a unit of {size} bytes exceeds the capacity {capacity}")
        at = 0
        while at < n:
            found = tree.pop_tightest(size)
            if found is None:
                if most is not None and bins == most:
                    return None
                found = (capacity, bins)
                bins += 1
            taken = min(n - at, found[0] // size) if size else n - at
            runs.append((size, at, at + taken, found[1]))
            tree.add((found[0] - size * taken, found[1]))
            at += taken
    return runs


def fit_runs(counts: dict[int, int], shards: int) -> list[Run]:
    """Packs units given as counts by size into at most ``shards`` bins of near equal sizes.

    A unit larger than the even share of what is left has a bin of its own, and the share is taken anew
    over the other units and bins. Those are packed by best fit with that share as capacity; the slack
    over it doubles until best fit succeeds.
    """
    rest, left, own, runs = dict(counts), sum(size * n for size, n in counts.items()), 0, []
    for size in sorted(counts, reverse=True):
        while rest[size] and size * (shards - own) > left:
            at = counts[size] - rest[size]
            runs.append((size, at, at + 1, own))
            rest[size] -= 1
            left -= size
            own += 1
        if rest[size]:
            break
    rest = {size: n for size, n in rest.items() if n}
    if not rest:
        return runs
    even, slack = -(-left // (shards - own)), 0
    while (found := best_fit_runs(rest, even + slack, shards - own)) is None:
        slack = max(1, even >> 14, slack * 2)
    for size, start, stop, k in found:
        before = counts[size] - rest[size]
        runs.append((size, before + start, before + stop, own + k))
    return runs


def _by_key(units: list[tuple[str, int]], runs: list[Run]) -> dict[str, int]:
    """The bin of each unit; units of one size are numbered by key."""
    keys: dict[int, list[str]] = {}
    for key, size in sorted(units):
        keys.setdefault(size, []).append(key)
    return {key: k for size, start, stop, k in runs for key in keys[size][start:stop]}


def best_fit_decreasing(units: list[tuple[str, int]], capacity: int, most: int | None = None) -> dict[str, int] | None:
    """``best_fit_runs`` of single units: the bin of each. Ties of size go by key."""
    runs = best_fit_runs(Counter(size for _, size in units), capacity, most)
    return None if runs is None else _by_key(units, runs)


def fit_into(units: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """``fit_runs`` of single units: the bin of each. Ties of size go by key."""
    return _by_key(units, fit_runs(Counter(size for _, size in units), shards))


def shard(df: DataFrame, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, group_md5, shard, slot) of each row of ``df``."""
    body = whole_text(text)
    slim = write_shared(
        df.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.md5(body.cast("binary")).alias("group_md5"),
        ),
        "shard-rows",
    )
    total, rows = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    groups = write_shared(slim.groupBy("group_md5").agg(F.sum("size").alias("bytes")), "shard-groups")
    counts = {r["bytes"]: r["count"] for r in groups.groupBy("bytes").count().collect()}
    plan = df.sparkSession.createDataFrame(fit_runs(counts, shards), "bytes long, start long, stop long, shard int")
    numbered = ordinals(groups, "bytes", ["group_md5"], "_n", sum(counts.values()), "group_md5")
    placed = numbered.join(small(plan), "bytes").where("_n >= start and _n < stop").select("group_md5", "bytes", "shard")
    placed = write_shared(placed, "shard-places")
    # by this rule at most shards * FINE groups are large
    is_large = F.col("bytes") >= max(1, total // (shards * FINE))
    large = F.broadcast(placed.where(is_large).select("group_md5", "shard"))
    others = placed.where(~is_large).select("group_md5", "shard")
    in_shards = slim.join(large, "group_md5").unionByName(
        slim.join(large, "group_md5", "left_anti").join(others, "group_md5")
    )
    return ordinals(in_shards, "shard", ["doc_id"], "slot", rows, "doc_id")


def op10_bfd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
