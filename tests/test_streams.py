"""Windows from streams of samples: any order, restarts, late samples, gaps and missing ends."""

import numpy as np
import pytest

from sigtok.profile import SMALL
from sigtok.streaming import windows as streams
from tests.test_signal import walked

SCHEMA = "read_pos long, pos long, adc smallint, last boolean, at timestamp"
BASE = 1_700_000_000


def signal(read, n):
    return (np.arange(n) * 37 + read * 101) % 3000 - 900


def rows_of(read, n, at=0, ended=True):
    return [(read, p, int(v), ended and p == n - 1, at) for p, v in enumerate(signal(read, n))]


def put(spark, folder, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "read_pos long, pos long, adc int, last boolean, at long")
    df = df.select("read_pos", "pos", F.col("adc").cast("smallint"), "last", F.timestamp_seconds(F.col("at") + BASE).alias("at"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, patience="1 hour"):
    stream = streams.stream_reads(spark, f"{folder}/in", SCHEMA)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with streams.state_store(spark):
        q = streams.sample_windows(stream, SMALL, patience).writeStream.format("parquet").option("path", f"{folder}/out")
        q = q.option("checkpointLocation", f"{folder}/mark").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    return [r for r in spark.read.schema(streams.OUTPUT).parquet(f"{folder}/out").collect()]


def check_windows(rows, lengths):
    got = {}
    for r in rows:
        if r.problem is None:
            got.setdefault(r.read_pos, []).append((r.seq, r.start, r.samples))
    for read, n in lengths.items():
        starts = walked(n, SMALL.chunk_samples, SMALL.hop_samples)
        want = [(k, a, signal(read, n)[a : a + SMALL.chunk_samples].tolist()) for k, a in enumerate(starts)]
        assert sorted(got.pop(read, [])) == want, read
    assert not got


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_any_order_and_a_restart(spark, tmp_path, few_partitions):
    lengths = {1: 1, 2: 63, 3: 64, 4: 65, 5: 300, 6: 1000}
    rows = [r for read, n in lengths.items() for r in rows_of(read, n)]
    order = np.random.default_rng(1).permutation(len(rows))
    parts = [[rows[i] for i in order[k::4]] for k in range(4)]
    for part in parts[:2]:
        put(spark, tmp_path, part)
    first = run(spark, tmp_path)
    for part in parts[2:]:
        put(spark, tmp_path, part)
    both = run(spark, tmp_path)  # from the checkpoint: half of the samples are in its state alone
    assert all(r.problem is None for r in both) and len(both) > len(first)
    check_windows(both, lengths)
    assert len(run(spark, tmp_path)) == len(both)


def test_stream_of_whole_reads_gives_the_batch_tokens(spark, tmp_path, few_partitions):
    from sigtok.operators import codecs
    from sigtok.plans import pipeline
    from tests.test_signal import reads

    table = reads(spark, [signal(k, n) for k, n in enumerate((0, 1, 64, 65, 300, 777))])
    for k in range(3):
        table.where(f"read_pos % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.stream_reads(spark, f"{tmp_path}/in", table.schema)
    found = streams.encode_stream(stream, codecs.MeanQuant(SMALL), SMALL)
    q = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pipeline.encode(table, codecs.MeanQuant(SMALL), SMALL).collect()))


def test_late_samples_gaps_and_missing_ends(spark, tmp_path, few_partitions):
    whole, gap, endless = rows_of(1, 200), rows_of(2, 200), rows_of(3, 130, ended=False)
    put(spark, tmp_path, whole + [r for r in gap if r[1] not in (70, 71, 150)] + endless)
    # the same again, twice over; one beyond the end; all of a read that is done
    put(spark, tmp_path, [(1, 5, 1, False, 1), (1, 6, 2, False, 1), (1, 999, 3, False, 1), (2, 10, 4, False, 1), (2, 100, 5, False, 1), (2, 201, 6, False, 1)])
    # a day on, for another read: the wait for the rest is over
    put(spark, tmp_path, rows_of(4, 10, at=86_400))
    rows = run(spark, tmp_path, "10 seconds")
    side = sorted((r.read_pos, r.problem, r.start, r.valid) for r in rows if r.problem)
    assert side == [
        (1, "late", 5, 2), (1, "late", 999, 1), (2, "after a gap", 72, 78), (2, "after a gap", 151, 49), (2, "gap", 70, 2),
        (2, "late", 10, 1), (2, "late", 100, 1), (2, "late", 201, 1), (3, "no end", 130, 0),
    ]
    kept = {r.start: r.samples for r in rows if r.problem == "after a gap"}
    assert kept[72] == signal(2, 200)[72:150].tolist() and kept[151] == signal(2, 200)[151:].tolist()
    check_windows([r for r in rows if r.read_pos in (1, 4)], {1: 200, 4: 10})
    # of the others, the windows that were whole
    assert [(r.seq, r.start) for r in rows if r.read_pos == 2 and r.problem is None] == [(0, 0)]
    assert sorted((r.seq, r.start) for r in rows if r.read_pos == 3 and r.problem is None) == [(0, 0), (1, 48)]


class Handle:
    """A state of one read, and how often it was called."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def called(self):
        self.calls += 1

    def get(self):
        self.called()
        return self.value

    def update(self, value):
        self.called()
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.called()
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.called()
        self.timers.remove(at)


def test_a_read_takes_few_calls_for_state():
    handle = Handle()
    windows = streams.SampleWindows(SMALL)
    windows.init(handle)
    rows = [(r[0], r[1], r[2], r[3], 1000 * (k // 100)) for k, r in enumerate(rows_of(7, 400))]
    order = np.random.default_rng(4).permutation(len(rows))
    got = []
    for k in range(4):
        handle.calls = 0
        got += list(windows.handleInputRows((7,), iter([rows[i] for i in order[k::4]]), None))
        assert handle.calls <= 4 and len(handle.timers) == 1
    assert handle.timers == {3000}
    check_windows(got, {7: 400})
