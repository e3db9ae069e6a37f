"""Best-fit packing of token sequences by large-item matching.

Pieces of more than a third of the capacity can stand at most two in a sequence: from the longest on,
each is paired with the longest other one that fits. Shorter pieces then go, longest first, into the
tightest gap that holds them.

Pieces of one length are alike, so the plan is made from the counts by length alone, at most
``capacity`` rows, and comes out as runs "pieces number lo to hi of this length go k to a sequence, from
sequence s and offset o on". Pieces are numbered within their length over the whole table and look up
their run. What comes to the driver and what is broadcast is bounded by the capacity, not by the data.

Defined results: a null text is an empty one and has the end id alone; repeated rows and rows of a null
doc_id are packed each; texts of any length are cut into pieces of the capacity;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import batch_map, documents, ordinals, whole_text, write_shared
from sigtok.llm.tokenfile import id_lists
from sigtok.llm.wordcache import LowerWordUnits, loaded

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 2048
END_ID = 0

Run = tuple[int, int, int, int, int, int]
RUN_SCHEMA = "length int, lo long, hi long, per long, base long, at int"


class _Bins:
    """``count`` sequences filled alike: slots of (length, first piece number, pieces per sequence)."""

    __slots__ = ("count", "gap", "slots")

    def __init__(self, count: int, gap: int, slots: list[tuple[int, int, int]]) -> None:
        self.count, self.gap, self.slots = count, gap, slots

    def split(self, count: int) -> _Bins:
        """Takes the first ``count`` sequences out."""
        taken = _Bins(count, self.gap, list(self.slots))
        self.slots = [(length, first + count * k, k) for length, first, k in self.slots]
        self.count -= count
        return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs of pieces from the counts by length, and how many sequences they fill."""
    left, used = dict(counts), dict.fromkeys(counts, 0)
    done: list[_Bins] = []
    by_gap: dict[int, list[_Bins]] = {}

    def take(length: int, n: int) -> int:
        first = used[length]
        used[length] += n
        left[length] -= n
        return first

    def put(bins: _Bins) -> None:
        if bins.gap:
            by_gap.setdefault(bins.gap, []).append(bins)
        else:
            done.append(bins)

    large = sorted(x for x in counts if 3 * x > capacity)
    for length in reversed(large):
        while left[length]:
            mates = [x for x in large[: bisect.bisect_right(large, min(length, capacity - length))] if left[x]]
            mate = mates[-1] if mates else 0
            if mate == length and left[length] > 1:
                n = left[length] // 2
                put(_Bins(n, capacity - 2 * length, [(length, take(length, 2 * n), 2)]))
            elif mate and mate != length:
                n = min(left[length], left[mate])
                put(_Bins(n, capacity - length - mate, [(length, take(length, n), 1), (mate, take(mate, n), 1)]))
            elif len(mates) > 1:
                mate = mates[-2]
                put(_Bins(1, capacity - length - mate, [(length, take(length, 1), 1), (mate, take(mate, 1), 1)]))
            else:
                n = left[length]
                put(_Bins(n, capacity - length, [(length, take(length, n), 1)]))
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while n := left[length]:
            gap = min((g for g in by_gap if g >= length), default=0)
            if gap:
                bins = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
            else:
                gap = capacity
                bins = _Bins(-(-n // (capacity // length)), capacity, [])
            per = gap // length
            full = min(bins.count, n // per)
            if full:
                filled = bins.split(full) if full < bins.count else bins
                rest = bins if filled is not bins else None
                filled.slots.append((length, take(length, full * per), per))
                filled.gap -= per * length
                put(filled)
            else:
                one = bins.split(1) if bins.count > 1 else bins
                rest = bins if one is not bins else None
                one.slots.append((length, take(length, n), n))
                one.gap -= n * length
                put(one)
            if rest is not None and rest.slots:
                put(rest)
    runs, base = [], 0
    for bins in [*done, *(b for g in sorted(by_gap) for b in by_gap[g])]:
        at = 0
        for length, first, k in bins.slots:
            runs.append((length, first, first + bins.count * k, k, base, at))
            at += k * length
        base += bins.count
    return runs, base


def token_pieces(
    df: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    share: int = 1,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): only documents over the capacity are cut.

    Workers' caches take a ``share``-th of their budgets; that changes no result.
    """
    end = np.asarray([END_ID], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = loaded(LowerWordUnits, vocabulary, share)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids = [], []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = units.encode(body.as_py()) + end
                for n, start in enumerate(range(0, len(whole), 4 * capacity)):
                    piece = whole[start : start + 4 * capacity]
                    rows.append((doc_id, n, start // 4, len(piece) // 4, zlib.crc32(piece)))
                    if with_ids:
                        ids.append(piece)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *([id_lists(ids)] if with_ids else [])], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    body = df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return batch_map(body, run, schema)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    table = spark.createDataFrame(runs, RUN_SCHEMA).withColumnRenamed("length", "_length")
    numbered = ordinals(pieces, "length", ["doc_id", "piece"], "_n", sum(counts.values()), "doc_id")
    n = F.col("_n") - F.col("lo")
    return (
        numbered.join(
            F.broadcast(table),
            (F.col("length") == F.col("_length")) & (F.col("_n") >= F.col("lo")) & (F.col("_n") < F.col("hi")),
        )
        .withColumn("sequence_id", F.expr("base + (_n - lo) div per").cast("long"))
        .withColumn("offset", (F.col("at") + n % F.col("per") * F.col("length")).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of placed pieces that carry ids: at most the capacity in each row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (
        placed.groupBy("sequence_id")
        .agg(parts.alias("parts"))
        .select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))
    )


def pack(df: DataFrame, share: int = 1) -> DataFrame:
    """Where each piece of each document of ``df`` goes; ``share`` as in ``token_pieces``."""
    return place(write_shared(token_pieces(df, share=share), "pieces"))


def op9_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
