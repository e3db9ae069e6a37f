"""Codecs, quantization, the round trip, and that cuts of batches and partitions don't matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtok.functions import scalar as S
from sigtok.operators import codecs, network, quantize
from sigtok.operators.stitch import cover_guard, stitch
from sigtok.plans import demo, pipeline
from sigtok.profile import PROFILE, SMALL, Profile
from tests.test_signal import reads

LENGTHS = [0, 1, 2, 5, 6143, 8191, 8192, 8193, 9000, 16240, 16300, 16384, 30001]


def signals(seed=0):
    rng = np.random.default_rng(seed)
    return [rng.integers(-4096, 4095, n) for n in LENGTHS]


def test_identity_round_trip_is_exact(spark):
    given = signals()
    back = pipeline.roundtrip(reads(spark, given), codecs.Identity())
    got = {r.read_pos: r.signal for r in back.collect()}
    assert {k: len(v) for k, v in got.items()} == dict(enumerate(LENGTHS))
    assert all(got[k] == s.tolist() for k, s in enumerate(given))


def test_extremes_and_constants_come_back(spark):
    given = [[-32768, 32767, 0], [123] * 100, [-5]]
    for codec in (codecs.Identity(),):
        back = pipeline.roundtrip(reads(spark, given, 0.0, 1.0), codec, SMALL)
        assert {r.read_pos: r.signal for r in back.collect()} == dict(enumerate(given))


def test_cuts_do_not_matter(spark):
    table = reads(spark, [np.random.default_rng(k).integers(0, 900, 50 + 37 * k) for k in range(12)])
    codec = codecs.MeanQuant(SMALL)
    want = None
    for parts, batch, rows in ((1, 64, 500), (5, 3, 2), (3, 1, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = sorted(map(str, pipeline.encode(table.repartition(parts), codec, SMALL, batch).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)


def test_decode_equals_roundtrip(spark):
    table = reads(spark, [np.random.default_rng(k).integers(0, 900, 30 * k) for k in range(9)])
    codec = codecs.MeanQuant(SMALL)
    tokens = pipeline.encode(table, codec, SMALL)
    a = pipeline.decode(tokens, table.drop("signal"), codec, SMALL).select("read_pos", "signal")
    b = pipeline.roundtrip(table, codec, SMALL).select("read_pos", "signal")
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_missing_and_repeated_windows_are_found(spark):
    table = reads(spark, [range(200)])
    codec = codecs.MeanQuant(SMALL)
    from sigtok.operators.windows import chunk_plan

    plan = chunk_plan(table.select("read_pos", "num_samples"), SMALL).select("read_pos", "seq", "start", "valid")
    ready = codecs.decode_windows(
        pipeline.encode(table, codec, SMALL).withColumnRenamed("scale", "half").join(plan, ["read_pos", "seq"]), codec
    )
    with pytest.raises(Exception, match="came twice"):
        stitch(ready.union(ready.where("seq = 1")), table, SMALL).collect()
    assert [r.ok for r in cover_guard(ready.where("seq != 1"), table, SMALL).collect()] == [False]
    with pytest.raises(Exception, match="without a window"):
        stitch(ready.where("seq != 1"), table, SMALL).collect()


def test_vector_quant_and_registry():
    rng = np.random.default_rng(2)
    words = rng.standard_normal((32, 4)).astype(np.float32)
    codec = codecs.VectorQuant(words, SMALL)
    codes = rng.integers(0, 32, (5, 16)).astype(np.int32)
    assert (codec.encode(codec.decode(codes)) == codes).all()
    assert {"identity", "mean-quant"} <= set(codecs.listed())
    with pytest.raises(KeyError):
        codecs.create("none")


def test_search_ties_and_tiles():
    rng = np.random.default_rng(3)
    words = rng.standard_normal((900, 8)).astype(np.float32)
    words[9] = words[700] = words[5]
    z = np.concatenate([words[[5, 9, 700]], rng.standard_normal((60, 8)).astype(np.float32)])
    naive = [int(np.argmin([((a.astype(float) - w.astype(float)) ** 2).sum() for w in words])) for a in z]
    for block in (1, 7, 256, 1000):
        assert quantize.search(z, words, block).tolist() == naive
    assert naive[:3] == [5, 5, 5]


def test_both_searches_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(40)]
    book = spark.createDataFrame([(k, v) for k, v in rows[:16]], "code int, vec array<float>")
    z = spark.createDataFrame(rows, "id long, z array<float>")
    a = {r.id: r.code for r in quantize.nearest(z, book).collect()}
    b = {r.id: r.code for r in quantize.nearest_blocked(z, quantize.codebook_array(book), 5).collect()}
    assert a == b and all(a[k] == k for k in range(16))


def test_blocked_search_of_65536_codewords(spark):
    rng = np.random.default_rng(5)
    words = rng.normal(size=(65_536, 64)).astype(np.float32)
    words[60_000:60_020] = words[100:120]  # ties over blocks go to the lower code
    z = np.concatenate([rng.normal(size=(40, 64)).astype(np.float32), words[60_000:60_020], words[65_530:]])
    d = np.zeros((len(z), len(words)))
    for k in range(64):
        d += (z[:, k, None].astype(np.float64) - words[None, :, k]) ** 2
    latents = spark.createDataFrame([(n, row.tolist()) for n, row in enumerate(z)], "id long, z array<float>")
    got = {r.id: r.code for r in quantize.nearest_blocked(latents, words).collect()}
    assert [got[n] for n in range(len(z))] == d.argmin(axis=1).tolist()
    assert [got[n] for n in range(40, 60)] == list(range(100, 120))


def naive_nearest(z, words):
    """Sums dimension by dimension, the lowest code on ties."""
    out = []
    for row in z.astype(np.float64):
        d = np.zeros(len(words))
        for k in range(len(row)):
            d += (row[k] - words[:, k].astype(np.float64)) ** 2
        out.append(int(np.argmin(d)))
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_pruned_search_equals_every_word(block):
    rng = np.random.default_rng(8)
    base = (rng.standard_normal((150, 6)) * np.exp(rng.normal(0, 2, 150))[:, None]).astype(np.float32)
    words = np.concatenate([base, base[::-1], np.zeros((2, 6), np.float32)])  # every word twice
    z = np.concatenate([(rng.standard_normal((90, 6)) * np.exp(rng.normal(0, 2, 90))[:, None]).astype(np.float32), base[:20], np.zeros((1, 6), np.float32)])
    book = quantize.Book(words, block)
    assert book.search(z).tolist() == naive_nearest(z, words)
    assert len(book.starts) < 2 or book.visited < len(z) * len(book.starts)
    assert book.search(z[:0]).tolist() == []


def test_search_at_the_released_width_visits_few_tiles():
    """65 536 words of lengths over some orders: the result is brute force's, most tiles stay unseen."""
    rng = np.random.default_rng(9)
    n = 65_536
    words = (rng.standard_normal((n, 16)) * np.exp(rng.normal(0, 1, n))[:, None]).astype(np.float32)
    z = (words[rng.integers(0, n, 300)] * rng.uniform(0.97, 1.03, (300, 16))).astype(np.float32)
    book = quantize.Book(words)
    got = book.search(z)
    assert got.tolist() == naive_nearest(z, words)
    assert book.visited < 0.5 * len(z) * len(book.starts)


# ---- the network


def mirrored(x, at):
    """x at any position, walking back and forth between its ends."""
    step, here = (1, 0) if at >= 0 else (-1, 0)
    for _ in range(abs(at)):
        if not 0 <= here + step < len(x):
            step = -step
        here += step
    return x[here]


def test_conv_against_loops():
    rng = np.random.default_rng(5)
    for size, stride, dilation, groups, time in ((3, 1, 1, 1, 10), (4, 2, 1, 1, 11), (3, 1, 4, 1, 9), (7, 1, 1, 6, 12), (3, 1, 1, 2, 8), (7, 1, 1, 1, 2), (5, 3, 2, 3, 7)):
        x = rng.standard_normal((2, time, 6)).astype(np.float32)
        k = rng.standard_normal((size, 6 // groups, 6)).astype(np.float32)
        n = -(-time // stride)
        reach = max(0, (n - 1) * stride + (size - 1) * dilation + 1 - time)
        # too short to mirror: the last value goes on as far as is needed
        longer = np.concatenate([x, np.repeat(x[:, -1:], max(0, reach - reach // 2 + 1 - time), axis=1)], axis=1)
        want = np.zeros((2, n, 6))
        for r in range(2):
            for t in range(n):
                for o in range(6):
                    g = o // (6 // groups) * (6 // groups)
                    for j in range(size):
                        want[r, t, o] += mirrored(longer[r], t * stride + j * dilation - reach // 2)[g : g + 6 // groups] @ k[j, :, o]
        assert np.allclose(network.conv1d(x, k, stride=stride, dilation=dilation, groups=groups), want, atol=1e-4)


def test_lstm_against_loops():
    rng = np.random.default_rng(6)
    x, wx, b, wh = (rng.standard_normal(s).astype(np.float32) for s in ((2, 5, 3), (3, 8), (8,), (2, 8)))
    sig = lambda v: 1 / (1 + np.exp(-v))
    for row in range(2):
        h, c = np.zeros(2), np.zeros(2)
        for t in range(5):
            i, f, g, o = np.split(x[row, t] @ wx + b + h @ wh, 4)
            c = sig(f + 1) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            assert np.allclose(network.lstm(x, wx, b, wh)[row, t], h, atol=1e-5)


def test_overlap_add_and_istft():
    rng = np.random.default_rng(7)
    frames = rng.standard_normal((2, 5, 12))
    for hop in (4, 5, 12):
        want = np.zeros((2, 4 * hop + 12))
        for k in range(5):
            for j in range(12):
                want[:, k * hop + j] += frames[:, k, j]
        assert np.allclose(network.overlap_add(frames, hop), want)
    signal = rng.standard_normal(160).astype(np.float32)
    window = network.hann(16)
    padded = np.pad(signal, 6)
    spectrum = np.stack([np.fft.rfft(padded[k * 4 : k * 4 + 16] * window) for k in range(40)])[None]
    back = network.istft_same(spectrum, 16, 4)[0]
    assert np.allclose(back[8:-8], signal[8:-8], atol=1e-4)


def test_number_formats():
    one = np.float32(1)
    ulp = 2.0**-10
    assert network.to_half(np.array([1 + 0.5 * ulp], np.float32))[0] == np.float16(1 + ulp)
    assert network.to_half(np.array([1 + 0.49 * ulp], np.float32))[0] == one
    for bound in (1e-6, 0.7, 1, 27.1, 1000, 40000):
        assert 2**14 <= bound * network.power_of_two(bound) < 2**15


def test_groups_and_dilations():
    assert [network.group_count(c, 32) for c in (512, 48, 7, 33)] == [32, 24, 7, 11]
    assert [network.dilations(n) for n in (0, 1, 3, 4)] == [(1,), (1,), (1, 2, 4), (1, 2, 4, 8)]


def test_network_rows_are_independent():
    net = network.Network(demo.TINY, network.random_weights(demo.TINY, 1))
    y = np.random.default_rng(8).uniform(-1, 1, (5, 64)).astype(np.float32)
    z = net.latents(y)
    assert z.shape == (5, 16, 8)
    out = net.reconstruct(net.codebook()[quantize.search(z.reshape(-1, 8), net.codebook()).reshape(5, 16)])
    assert out.shape == (5, 64) and np.isfinite(out).all()
    assert np.allclose(net.latents(y[2:3]), z[2:3], atol=1e-5)


def test_weights_are_checked(tmp_path):
    w = network.random_weights(demo.TINY, 1)
    assert network.check_weights(demo.TINY, w) == []
    np.savez(tmp_path / "w.npz", **w)
    assert network.load_weights(str(tmp_path / "w.npz"), demo.TINY).keys() == w.keys()
    broken = {**w, "more": w["quant_conv/kernel"], "quantizer/W": w["quantizer/W"][:1]}
    del broken["decoder/embed/bias"]
    assert network.check_weights(demo.TINY, broken) == ["mismatched quantizer/W", "missing decoder/embed/bias", "unexpected more"]
    np.savez(tmp_path / "b.npz", **broken)
    with pytest.raises(ValueError):
        network.load_weights(str(tmp_path / "b.npz"), demo.TINY)


def test_projection():
    base, w, b = np.eye(3), np.full((3, 3), 2.0), np.ones(3)
    assert (quantize.project(base, w, b) == 3).all()


def test_decoder_output_must_be_finite(spark):
    class Broken(codecs.Identity):
        def decode(self, codes):
            return np.full((len(codes), 64), np.nan, np.float32)

    table = reads(spark, [range(64)])
    with pytest.raises(Exception, match="finite"):
        pipeline.roundtrip(table, Broken(), SMALL).collect()


def test_profile_default_is_released_geometry():
    assert (PROFILE.chunk_samples, PROFILE.hop_samples, PROFILE.tokens_per_chunk) == (8192, 8048, 512)
    assert Profile.of(8192, 144, 512) == PROFILE
    assert S.REGIONS[-1] == "short" and F.lit(1) is not None
