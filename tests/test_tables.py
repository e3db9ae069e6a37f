"""Grouping, dictionaries, rules, quality, streams, and the query catalogue against DuckDB."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from sigtok.operators import checks, grouping, quality
from sigtok.plans import catalog
from sigtok.profile import PROFILE, SMALL
from tests.test_signal import lengths, reads

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def folded(counts, group_chunks, group_reads):
    out, group, chunks, n = [], 0, 0, 0
    for k in counts:
        if n and (chunks + k > group_chunks or n >= group_reads):
            group, chunks, n = group + 1, 0, 0
        chunks, n = chunks + k, n + 1
        out.append(group)
    return out


@pytest.mark.parametrize(("chunks", "most"), [(3, 100), (100, 2), (4, 3), (1, 1)])
def test_admission(spark, chunks, most):
    values = [100, 0, 3000, 8192, 20000, 0, 50, 1, 400000, 100] * 3
    rows = grouping.admit(lengths(spark, values), PROFILE, chunks, most).orderBy("read_pos").collect()
    counts = [0 if n == 0 else 1 if n <= 8192 else 1 + math.ceil((n - 8192) / 8048) for n in values]
    assert [r.num_chunks for r in rows] == counts
    assert [r.group_id for r in rows] == folded(counts, chunks, most)


def test_admission_by_file_and_table_size(spark):
    df = lengths(spark, [10] * 12).withColumn("file", F.when(F.col("read_pos") < 6, "a").otherwise("b"))
    df = df.withColumn("tag", F.repeat(F.col("read_pos").cast("string"), 40))
    rows = grouping.admit(df, PROFILE, table_bytes=200, dictionaries=["tag"]).collect()
    assert {r.group_id for r in rows if r.file == "a"} == {0, 1} and min(r.group_id for r in rows if r.file == "b") == 0
    with pytest.raises(Exception, match="too large"):
        grouping.admit(df, PROFILE, table_bytes=20, dictionaries=["tag"]).collect()


def folded_with_tables(rows, group_chunks, group_reads, table_bytes):
    """The fold one read after the other: (chunks, tag) rows, a tag of n characters taking n + 3 bytes."""
    out, group, chunks, n, tags = [], 0, 0, 0, set()
    for k, tag in rows:
        size = sum(len(t) + 3 for t in tags | {tag})
        if n and (chunks + k > group_chunks or n >= group_reads or size > table_bytes):
            group, chunks, n, tags = group + 1, 0, 0, set()
        chunks, n, tags = chunks + k, n + 1, tags | {tag}
        out.append(group)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_admission_over_many_ranges(spark, seed):
    """Ranges of a few reads, files of many ranges and of one read, positions with gaps."""
    rng = np.random.default_rng(seed)
    rows, want = [], {}
    group_chunks, group_reads, table_bytes = [int(x) for x in (rng.integers(1, 12), rng.integers(1, 9), rng.integers(12, 40))]
    for file, n in (("a", 150), ("b", 1), ("c", 37), ("d", 64)):
        at = np.sort(rng.choice(4 * n, n, replace=False))
        chunks = rng.choice([0, 0, 1, 1, 2, 3, 20], n)
        tags = ["x" * int(k) for k in rng.integers(1, 9, n)]
        groups = folded_with_tables(zip(chunks, tags), group_chunks, group_reads, table_bytes)
        for a, k, tag, g in zip(at, chunks, tags, groups):
            rows.append((file, int(a), int(0 if k == 0 else PROFILE.chunk_samples + (k - 1) * PROFILE.hop_samples), tag))
            want[file, int(a)] = (int(k), g)
    df = spark.createDataFrame(rows, "file string, read_pos long, num_samples long, tag string").repartition(3)
    got = grouping.admit(df, PROFILE, group_chunks, group_reads, table_bytes, ["tag"], span=group_reads + seed).collect()
    assert {(r.file, r.read_pos): (r.num_chunks, r.group_id) for r in got} == want
    plain = grouping.admit(df.drop("tag"), PROFILE, group_chunks, group_reads, span=1).collect()
    for file in "abcd":
        mine = sorted((r.read_pos, r.num_chunks, r.group_id) for r in plain if r.file == file)
        assert [g for _, _, g in mine] == folded([k for _, k, _ in mine], group_chunks, group_reads)
    assert grouping.admit(df.where("false")).count() == 0


def test_dictionaries(spark):
    rows = spark.createDataFrame([(0, "b", 1), (0, "a", 2), (0, "b", 3), (1, "c", 4)], "g int, v string, o int")
    table = grouping.dictionary(rows, "g", "v", "o")
    assert sorted(map(tuple, table.collect())) == [(0, "a", 1), (0, "b", 0), (1, "c", 0)]
    refs = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "g int, i int")
    assert [tuple(r) for r in grouping.dangling(refs, table, "g", "i").collect()] == [(0, 2)]
    assert {(r.g, r.i): r.v for r in grouping.resolve(refs, table, "g", "i").collect()} == {(0, 0): "b", (0, 2): None, (1, 0): "c"}


def test_rules(spark):
    inf = float("inf")
    rows = [(0, 1.0, 0.1), (1, float("nan"), 0.1), (2, 0.0, 0.0), (3, 0.0, inf), (4, None, 1.0), (5, 1e39, 0.1)]
    df = spark.createDataFrame(rows, "read_pos long, offset double, scale double")
    assert {r.read_pos for r in checks.violations(df).collect()} == {1, 2, 3, 4, 5}
    assert checks.enforce(df.where("read_pos = 0")).count() == 1
    with pytest.raises(Exception, match="rule calibration is broken"):
        checks.enforce(df).collect()
    assert [tuple(r) for r in checks.nulls(df).collect()] == [(4, "offset")]
    codes = spark.createDataFrame([(0, [0] * 16), (1, [0] * 15), (2, [65536] * 16), (3, [-1] * 16)], "read_pos long, codes array<int>")
    assert {r.read_pos for r in checks.violations(codes, p=SMALL).collect()} == {1, 2, 3}
    y = spark.createDataFrame([(0, [0.0]), (1, [float("nan")]), (2, [inf])], "read_pos long, y array<float>")
    assert {r.read_pos for r in checks.violations(y).collect()} == {1, 2}
    signal = spark.createDataFrame([(0, 2, [1, 2]), (1, 3, [1])], "read_pos long, num_samples long, signal array<smallint>")
    assert {(r.read_pos, r.rule) for r in checks.violations(signal).collect()} == {(1, "signal_length")}


def test_quality_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 900, n) for n in (5, 64, 90, 200, 300, 0)]
    b = [x + rng.integers(-3, 4, len(x)) for x in a]
    pairs = quality.errors(reads(spark, a), reads(spark, [*b[:1], b[1][:-1], *b[2:]]).select("read_pos", "signal"))
    rows = {r.read_pos: r for r in quality.per_read(quality.sample_errors(pairs)).collect()}
    assert set(rows) == {0, 2, 3, 4}
    scale = float(np.float32(0.1755))
    for k, r in rows.items():
        assert math.isclose(r.mae, np.abs((b[k] - a[k]) * scale).mean(), rel_tol=1e-9)
        assert math.isclose(r["std"], (a[k] * scale).std(), rel_tol=1e-9)
    values = spark.createDataFrame([(k, 10, float(m), float(s)) for k, (m, s) in enumerate([(1, 1), (2, 2), (3, 2), (4, 5)])], "read_pos long, num_samples long, mae double, std double")
    edges = np.percentile([1, 2, 2, 5], [25, 50, 75])
    want = {}
    for m, s in ((1, 1), (2, 2), (3, 2), (4, 5)):
        want.setdefault(int(np.digitize(s, edges)) + 1, []).append(m)
    got = {r.quarter: (r.reads, r.mean_read_mae) for r in quality.by_level(values).collect()}
    assert got == {k: (len(v), np.mean(v)) for k, v in want.items()}


def test_token_diff_of_unequal_tables(spark):
    a = spark.createDataFrame([(0, 0, 1.0, 2.0, [1, 2, 3]), (0, 1, 1.0, 2.0, [4, 5, 6])], "read_pos long, seq int, center float, scale float, codes array<int>")
    d = quality.token_diff(a, a.where("seq = 0")).first()
    assert (d.tokens, d.differing_tokens, d.chunks_with_differences, d.centers_scales_identical) == (6, 3, 1, False)
    assert quality.token_diff(a, a).first().differing_tokens == 0


def duck(data):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def comparable(rows):
    return sorted((tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = duck(data).execute(catalog.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    assert comparable(tuple(r[n] for n in names) for r in df.collect()) == comparable(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, data, name):
    rows = catalog.QUERIES[name](spark, data).collect()
    assert rows
    if name == "token_file_roundtrip":
        assert all(v == 0 for k, v in rows[0].asDict().items() if k != "reads")
    if name == "streamed_windows":
        assert rows[0].windows == rows[0].equal > 0


def test_errors_of_reads_work_on_slices_of_large_batches():
    import pyarrow as pa

    from sigtok.operators import quality
    from sigtok.operators.arrow import PIECE_BYTES
    from sigtok.profile import PROFILE

    n, size = 2000, 3000
    at, one = pa.array(range(n), pa.int64()), pa.array([0.5] * n, pa.float32())
    signal = pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * size, size), pa.int32()), pa.array([7] * (n * size), pa.int16()))
    batch = pa.RecordBatch.from_arrays([at, pa.array([size] * n, pa.int64()), one, one, signal, signal], ["read_pos", "num_samples", "offset", "scale", "signal", "back"])
    for out, held in ((list(quality.read_folder(PROFILE)(iter([batch]))), 4 * size), (list(catalog.moved(iter([batch.select(["read_pos", "signal"])]))), 2 * size)):
        assert sum(b.num_rows for b in out) == n and max(b.num_rows for b in out) * held <= PIECE_BYTES


def test_empty_reads_go_through_the_round_trip_once(spark, data):
    plan = catalog.QUERIES["empty_reads"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # texts to reads, and the round trip


def test_validation_report(spark):
    from sigtok.operators import codecs
    from sigtok.plans import pipeline

    rng = np.random.default_rng(4)
    original = reads(spark, [rng.integers(0, 900, n) for n in (0, 5, 64, 90, 300)])
    tables = pipeline.validate(original, pipeline.roundtrip(original, codecs.MeanQuant(SMALL), SMALL), SMALL)
    found = {name: df.collect() for name, df in tables.items()}
    assert found["input"][0].reads == 5 and found["input"][0].samples == 459
    assert sum(r.samples for r in found["by_region"]) == 459
    assert sum(r.reads for r in found["by_length"]) == sum(r.reads for r in found["by_level"]) == 4
    assert found["percentiles"][0].p5 <= found["percentiles"][0].p95 and found["mae_over_std"][0].mae_over_std > 0


def test_views(spark, data):
    from sigtok.plans import views

    names = views.register(spark, data, "test_")
    assert names == {t: f"test_{t}" for t in ("reads", "chunks", "tokens", "codebook")}
    one = spark.sql("SELECT count(*) AS n, count(DISTINCT t.read_pos) AS reads, min(size(t.codes)) AS codes FROM test_tokens t JOIN test_chunks c USING (read_pos, seq)").first()
    reads_ = spark.sql("SELECT sum(num_chunks) AS n, count(*) AS reads FROM test_reads WHERE num_samples > 0").first()
    assert (one.n, one.reads, one.codes) == (reads_.n, reads_.reads, PROFILE.tokens_per_chunk)
    assert spark.sql("SELECT count(*) FROM test_codebook").first()[0] == 64


def test_entry(spark, data):
    rows = driver.entry(spark).collect()
    assert rows and all(r.end <= r.num_samples for r in rows)
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_scan_is_pruned(spark, data):
    plan = catalog.chunk_plan(spark, data)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]
