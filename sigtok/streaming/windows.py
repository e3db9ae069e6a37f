"""Windows from streams: stateless over streams of whole reads, stateful over streams of samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sigtok.operators.codecs import Codec
from sigtok.plans.pipeline import encode
from sigtok.profile import SMALL, Profile

#: The state store that stateful streams of samples need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long after a read's last sample, by the stream's own time, it waits for more or is remembered.
PATIENCE = "1 hour"
OUTPUT = "read_pos long, seq int, start long, valid int, samples array<smallint>, problem string"


def encode_stream(reads: DataFrame, codec: Codec, p: Profile) -> DataFrame:
    """Tokens of a stream of whole reads: the batch flow, as no window crosses reads."""
    return encode(reads, codec, p)


def stream_reads(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


_Window = Row("read_pos", "seq", "start", "valid", "samples", "problem")
#: What is kept of a read. seq: the next window; first: the position of the first sample of ``held``; n: the read's length
#: where known, -1 where not; timer: when its wait ends, -1 before the first; places: starts and lengths of the runs in ``waiting``.
STATE = "seq int, first long, held binary, n long, done boolean, timer long, places binary, waiting binary"


class SampleWindows(StatefulProcessor):
    """Windows of one read at a time, from samples in any order.

    The state holds what the next window still needs, the run of samples up to the first one missing, and the runs
    that came before their turn; a timer ends the wait. A finished read is remembered until its timer, so that what
    comes after it is known to be late. All of it is one value, as each call for state costs more than a few samples.
    """

    def __init__(self, p: Profile) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.read = handle.getValueState("read", STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        _, pos_, adc_, last_, ms = zip(*rows, strict=True)
        pos = np.array(pos_, np.int64)
        order = np.argsort(pos, kind="stable")
        pos, adc, now = pos[order], np.array(adc_, np.int16)[order], max(ms)
        ends = pos[np.array(last_, bool)[order]]
        seq, first, held, n, done, timer, runs = self._get() or (0, 0, b"", -1, False, -1, [])
        samples = np.frombuffer(held, np.int16)
        out: list[tuple] = []
        if n < 0 and len(ends):
            n = int(ends.min()) + 1
        had = np.concatenate([np.arange(a, a + len(x)) for a, x in runs]) if runs else np.empty(0, np.int64)
        # a sample that was there, or comes a second time, or after the end, is late
        late = (pos < first + len(samples)) | np.isin(pos, had) | np.concatenate([[False], pos[1:] == pos[:-1]])
        late |= (pos >= n) if n >= 0 else False
        late |= done
        if late.any():
            out += [(*r, "late") for r in self._runs(key, pos[late], adc[late])]
        if done:
            self._put(seq, first, samples, n, done, [], now, timer)
            return self._rows(out)
        runs += [(r[2], np.array(r[4], np.int16)) for r in self._runs(key, pos[~late], adc[~late])]
        runs.sort(key=lambda r: r[0])
        ready = 0
        end = first + len(samples)
        while ready < len(runs) and runs[ready][0] == end:
            end += len(runs[ready][1])
            ready += 1
        if ready:
            samples, runs = np.concatenate([samples, *(x for _, x in runs[:ready])]), runs[ready:]
        seq, first, samples = self._cut(key, out, seq, first, samples)
        if n >= 0 and first + len(samples) == n:
            self._tail(key, out, seq, first, samples, n)
            done, samples = True, samples[:0]
            first = n
        self._put(seq, first, samples, n, done, runs, now, timer)
        return self._rows(out)

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        """The wait is over: what is missing, what waited for it, and all state goes."""
        out: list[tuple] = []
        if known := self._get():
            seq, first, held, n, done, _, runs = known
            at = first + len(held) // 2
            if not done:
                missing = (runs[0][0] if runs else max(n, at)) - at
                out.append((key[0], None, at, missing, [], "gap" if missing else "no end"))
                out += [(key[0], None, a, len(x), x.tolist(), "after a gap") for a, x in runs]
        self.read.clear()
        return self._rows(out)

    def _get(self) -> tuple | None:
        """The state, its waiting runs as (start, samples) in order."""
        known = self.read.get()
        if known is None:
            return None
        *rest, places, waiting = known
        samples, runs, at = np.frombuffer(waiting, np.int16), [], 0
        for start, size in np.frombuffer(places, np.int64).reshape(-1, 2).tolist():
            runs.append((start, samples[at : at + size]))
            at += size
        return (*rest, runs)

    def _cut(self, key: tuple, out: list, seq: int, first: int, samples: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Emits full windows; keeps what the next one and a tail, which may reach back a window's length, need."""
        length, hop = self.p.chunk_samples, self.p.hop_samples
        while first + len(samples) - seq * hop >= length:
            at = seq * hop - first
            out.append((key[0], seq, seq * hop, length, samples[at : at + length].tolist(), None))
            seq += 1
        drop = min(max(0, len(samples) - (length + hop)), max(0, seq * hop - first))
        return seq, first + drop, samples[drop:]

    def _tail(self, key: tuple, out: list, seq: int, first: int, samples: np.ndarray, n: int) -> None:
        length, hop = self.p.chunk_samples, self.p.hop_samples
        if n and (seq == 0 or (seq - 1) * hop + length < n):
            at = max(n - length, 0)
            part = samples[at - first :]
            out.append((key[0], seq, at, len(part), part.tolist(), None))

    @staticmethod
    def _runs(key: tuple, pos: np.ndarray, adc: np.ndarray) -> list[tuple]:
        """(read, None, start, length, samples) of each run of positions."""
        cuts = [0, *(np.flatnonzero(np.diff(pos) != 1) + 1).tolist(), len(pos)]
        return [(key[0], None, int(pos[a]), b - a, adc[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]

    def _put(self, seq: int, first: int, samples: np.ndarray, n: int, done: bool, runs: list, now: int, timer: int) -> None:
        if timer < now:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now)
            timer = now
        places = np.array([(a, len(x)) for a, x in runs], np.int64).tobytes()
        waiting = np.concatenate([x for _, x in runs]).astype(np.int16).tobytes() if runs else b""
        self.read.update((seq, first, samples.astype(np.int16).tobytes(), n, done, timer, places, waiting))

    @staticmethod
    def _rows(out: list[tuple]) -> Iterator[Row]:
        return (_Window(*r) for r in out)


def sample_windows(samples: DataFrame, p: Profile = SMALL, patience: str = PATIENCE) -> DataFrame:
    """OUTPUT from a stream of samples (read_pos, pos, adc, last, at), in any order within and between micro-batches.

    A window comes out as soon as the samples up to its end are there; ``last`` marks a read's last sample, with
    which the aligned tail comes out. Rows with a ``problem`` are no windows but the side output: ``late`` samples
    that were there before or lie beyond the end; and when the stream's time ``at`` is ``patience`` past an unfinished
    read's last sample, the ``gap`` it waited for with what came ``after a gap``, or that it has ``no end``. Samples
    older than that Spark drops and counts in the query's progress. Start the query inside ``state_store``.
    """
    timed = samples.withWatermark("at", patience).select("read_pos", "pos", "adc", "last", F.unix_millis("at").alias("ms"))
    return timed.groupBy("read_pos").transformWithState(SampleWindows(p), OUTPUT, "append", "eventTime")
