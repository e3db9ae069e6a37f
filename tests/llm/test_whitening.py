"""op12: exact sums and deviations, covariance and projection against plain numpy over the whole fit list."""

import math
from collections import defaultdict

import numpy as np
import pytest

from sigtok.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def brute(rows):
    """(id, x) of the rows that remain, and the components of the distinct x by numpy in one piece."""
    left = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted(set(map(tuple, (x for _, x in left))))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    m = np.array(distinct, float) - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(m.T @ m / n)
    return left, n, sums, e[::-1], u[:, ::-1]


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(700, 12)) * np.arange(1, 13)
    rows = [(n, v) for n, v in enumerate(base.tolist())]
    rows += [(1000 + n, base[0].tolist()) for n in range(300)]  # a third of all rows are one vector
    rows += [(0, base[1].tolist()), (None, base[2].tolist())]
    rows += [(2000, None), (2001, [None] + [1.0] * 11), (2002, [float("nan")] * 12), (2003, [float("-inf")] + [0.0] * 11)]
    fixed = whitening.fixed_point(table(spark, rows))
    model = whitening.fit(fixed)
    left, n, sums, e, u = brute(rows)
    assert n == 700 and model.centre.n == n
    assert [q * n + r for q, r in zip(model.centre.quotient, model.centre.rest)] == sums
    assert np.allclose(model.eigenvalues, e[:4], rtol=1e-12)
    for k in range(4):
        assert abs(abs(model.vectors[:, k] @ u[:, k]) - 1) < 1e-12
    assert model.identity_error < 1e-9
    got = whitening.components(fixed, model).collect()
    assert len(got) == 4 * len(left)
    found = defaultdict(set)
    for r in got:
        found[r.vec_id].add((r.component, int(r.deviation), round(r.whitened, 9)))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
        assert r.n == n
    signs = [np.sign(model.vectors[:, k] @ u[:, k]) for k in range(4)]
    want = defaultdict(set)
    for i, x in left:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        w = (np.array(x) - np.array([s / n for s in sums])) @ u[:, :4] / np.sqrt(e[:4])
        want[i] |= {(k + 1, deviation, round(w[k] * signs[k], 9)) for k in range(4)}
    assert {i: {x[:2] for x in v} for i, v in found.items()} == {i: {x[:2] for x in v} for i, v in want.items()}
    for i in want:
        for a, b in zip(sorted(found[i]), sorted(want[i])):
            assert a[2] == pytest.approx(b[2], abs=2e-8)


def test_whitened_rows_are_white(spark):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(900, 6)) @ rng.normal(size=(6, 6)) * 5
    fixed = whitening.fixed_point(table(spark, list(enumerate(mixed.tolist()))))
    w = np.array([r.whitened for r in whitening.project(fixed, whitening.fit(fixed, 6)).collect()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(6)).max() < 1e-9


def test_floor_and_zero(spark):
    rows = [(0, [-0.0, 0.00390625, -0.001]), (1, [1.5, -1.5, 3.9999])]
    got = {r.vec_id: r.x for r in whitening.fixed_point(table(spark, rows)).collect()}
    assert got == {0: [0, 1, -1], 1: [384, -384, 1023]}


def test_degenerate_fits(spark):
    one = whitening.fixed_point(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0])]))
    model = whitening.fit(one)
    rows = whitening.components(one, model).collect()
    assert len(rows) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, None, None)}
    line = whitening.fixed_point(table(spark, [(n, [float(n), 2.0 * n, 5.0]) for n in range(5)]))
    rows = whitening.components(line, whitening.fit(line)).collect()
    assert len(rows) == 15  # three dimensions have three components
    for r in rows:
        assert (r.whitened is None) == (r.component > 1)
        assert r.explained == pytest.approx(1.0 if r.component == 1 else 0.0, abs=1e-12)
        assert r.identity_error < 1e-9


def test_sums_beyond_longs_are_exact(spark):
    big = float(1 << 44)
    rows = [(n, [big - n * 2.0**20, -big + n, float(n)]) for n in range(40)]
    fixed = whitening.fixed_point(table(spark, rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(fixed, 1)
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    assert [q * 40 + r for q, r in zip(model.centre.quotient, model.centre.rest)] == sums
    got = {r.vec_id: int(r.deviation) for r in whitening.project(fixed, model).collect()}
    assert got == {i: sum((40 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert max(got.values()) > 2**63


def test_deviations_are_exact_in_both_forms():
    rng = np.random.default_rng(5)
    x = rng.integers(-(2**20), 2**20, size=(50, 7))
    for n in (3, 10**6, 10**12):
        sums = [int(s) for s in rng.integers(-(2**19), 2**19, size=7) * n + rng.integers(0, n, size=7)]
        want = [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums)) for v in x]
        assert whitening.Centre.of(n, sums).deviations(x) == want


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        assert whitening.fit(whitening.fixed_point(table(spark, rows))) is None
    path = str(tmp_path / "embeddings.parquet")
    table(spark, [(1, None)]).write.parquet(path)
    empty = whitening.op12_whitening(spark, str(tmp_path))
    assert empty.count() == 0
    clash = spark.createDataFrame([(n, [float(n), n % 3 * 1.0], n, "a") for n in range(9)], SCHEMA + ", x long, component string")
    clash.write.parquet(str(tmp_path / "more" / "embeddings.parquet"))
    full = whitening.op12_whitening(spark, str(tmp_path / "more"))
    assert full.count() == 18 and full.columns == empty.columns and full.dtypes == empty.dtypes


def test_vectors_that_have_no_result_are_errors(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.fit(whitening.fixed_point(table(spark, [(1, [1.0]), (2, [1.0, 2.0])])))
    with pytest.raises(Exception, match="too large"):
        whitening.fit(whitening.fixed_point(table(spark, [(1, [1e30])])))


def test_query_on_given_table(spark, data):
    got = whitening.op12_whitening(spark, data)
    raw = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    left, n, sums, e, _ = brute(raw)
    rows = got.collect()
    assert len(rows) == 4 * len(left)
    want = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for i, x in left}
    assert all(r.deviation == want[r.vec_id] and r.n == n and r.identity_error < 1e-4 for r in rows)
    first = sum(r.whitened**2 for r in rows if r.component == 1) / len(left)
    assert first == pytest.approx(1, abs=0.2)
