"""Token files: round trips, truncation at every byte, structural faults; atomic output; command line."""

import json
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigtok.__main__ import main
from sigtok.errors import SigtokError, UsageError
from sigtok.operators import codecs
from sigtok.plans import demo, pipeline
from sigtok.profile import SMALL
from sigtok.schema import END_REASONS, RUN_INFO, RUN_INFO_RANGES
from sigtok.shapes import Text, Whole, checked
from sigtok.sources import tokens
from sigtok.sources.output import AtomicFile


def by_name(name, salt=0):
    """A number that the name and the salt decide."""
    return zlib.crc32(f"{name}/{salt}".encode())


def info(k=0):
    """A run info of values by the fields' types; bounds of whole numbers, and texts of one to four bytes a character."""
    row = {}
    for f in RUN_INFO.fields:
        h = by_name(f.name, k)
        if f.name in RUN_INFO_RANGES:
            row[f.name] = RUN_INFO_RANGES[f.name][h % 2]
        elif f.dataType.typeName() == "array":
            row[f.name] = [(f"{f.name}{j % 2}", "xßи𝄞"[: j + h % 3]) for j in range(3 + h % 4)]
        else:
            row[f.name] = f"{f.name}-{k}-" + "aßи𝄞"[: h % 5]
    return row | {"sample_rate": SMALL.sample_rate_hz, "acquisition_id": f"run {k}"}


#: Floats that keep their bits: both zeros, both infinities, NaN, the least and the greatest.
FLOATS = np.array([0, 0x80000000, 0x7F800000, 0xFF800000, 0x7FC00000, 1, 0x7F7FFFFF, 0x3F9D70A4], np.uint32).view(np.float32).tolist()


def row(pos, n, group=0, **more):
    """A stored read; plain fields hold what their width takes, floats go through FLOATS."""
    rng = np.random.default_rng(pos)
    k = tokens.chunk_total(n, SMALL)
    plain = {}
    for name in tokens._PLAIN:
        kind = tokens.META[name]
        plain[name] = FLOATS[by_name(name, pos) % len(FLOATS)] if kind.kind == "f" else by_name(name, pos) % min(2 ** (8 * kind.itemsize), 2**32)
    base = plain | {
        "group_id": group, "read_pos": pos, "read_id": by_name("id", pos).to_bytes(4, "big") * 4, "num_samples": n, "end_reason_forced": pos % 2 == 1,
        "calibration_offset": -float(pos), "calibration_scale": 2.0 ** -(1 + pos % 5), "pore_type": "pore" + "ßи𝄞"[: pos % 4],
        "end_reason": END_REASONS[pos % len(END_REASONS)], "run_info": info(group % 2),
        "centers": rng.standard_normal(k).astype(np.float32).tolist(), "scales": abs(rng.standard_normal(k)).astype(np.float32).tolist(),
        "codes": rng.integers(0, 65536, k * SMALL.tokens_per_chunk).tolist(),
    }
    return base | more


def file_of(groups, read_count=None, end=None, magic=tokens.MAGIC, version=(1, 0), flags=0, header=None):
    parts = [tokens.group_bytes(g, SMALL) for g in groups]
    reads = sum(map(len, groups))
    head = (header or tokens.Header(SMALL, read_count=reads if read_count is None else read_count)).to_json_dict()
    totals = {"group_count": len(groups), "read_count": reads, "chunk_count": sum(c for _, c in parts)} | (end or {})
    return b"".join(
        [tokens.PREAMBLE.pack(magic, *version, flags), tokens._record(1, head), *(d for d, _ in parts), tokens._record(4, totals)]
    )


GROUPS = [[row(0, 0), row(1, 1), row(2, 64), row(3, 200)], [row(4, 90, 1)], [row(5, 5, 2), row(6, 400, 2)]]


def load(path):
    header, parts = tokens.plan_scan(str(path))
    return header, [r for p in parts for r in tokens.iter_group(str(path), p, header.profile)]


def test_round_trip(tmp_path):
    path = tmp_path / "t"
    path.write_bytes(file_of(GROUPS))
    header, rows = load(path)
    assert header.profile == SMALL and header.read_count == 7
    for got, want in zip(rows, [r for g in GROUPS for r in g], strict=True):
        assert got["codes"] == want["codes"] and got["centers"] == want["centers"]
        assert (got["read_pos"], got["group_id"], got["run_info"]) == (want["read_pos"], want["group_id"], want["run_info"])
        for name in tokens._PLAIN:
            a, b = (np.float32(x[name]).tobytes() if isinstance(x[name], float) else x[name] for x in (got, want))
            assert a == b, name
    assert file_of(GROUPS) == file_of(GROUPS)
    assert tokens.payload_bytes(3, SMALL) == 104 + 24 + 6 * 16


def test_every_truncation_fails(tmp_path):
    whole = file_of(GROUPS)
    path = tmp_path / "t"
    for n in [*range(400), *range(400, len(whole), 7), len(whole) - 1]:
        path.write_bytes(whole[:n])
        with pytest.raises(SigtokError):
            load(path)


@pytest.mark.parametrize(
    "broken",
    [
        lambda: file_of(GROUPS) + b"\0",
        lambda: file_of(GROUPS, read_count=8),
        lambda: file_of(GROUPS, read_count=6),
        lambda: file_of(GROUPS, end={"group_count": 2}),
        lambda: file_of(GROUPS, end={"chunk_count": 1}),
        lambda: file_of(GROUPS, end={"read_count": 1}),
        lambda: file_of(GROUPS, version=(2, 0)),
        lambda: file_of(GROUPS, version=(1, 1)),
        lambda: file_of(GROUPS, flags=1),
        lambda: file_of(GROUPS, magic=b"PK\x03\x04....")[:200],
        lambda: file_of(GROUPS, header=replace(tokens.Header(SMALL, read_count=7), format="other")),
        lambda: file_of(GROUPS).replace(struct.pack("<I", 2), struct.pack("<I", 9), 1),
        lambda: b"",
        lambda: b"plain text",
    ],
)
def test_structural_faults(tmp_path, broken):
    path = tmp_path / "t"
    path.write_bytes(broken())
    with pytest.raises(SigtokError):
        load(path)


def spoil(offset, data):
    """A file of one read with bytes of its record replaced."""
    whole = bytearray(file_of([[row(0, 200)]]))
    at = whole.index(row(0, 200)["read_id"])
    whole[at + offset : at + offset + len(data)] = data
    return bytes(whole)


@pytest.mark.parametrize(
    ("offset", "data"),
    [
        (16, struct.pack("<Q", 9999)),
        (16, struct.pack("<Q", 2**40 + 1)),
        (24, struct.pack("<Q", 3)),
        (47, b"\x02"),
        (52, struct.pack("<f", 0.0)),
        (52, struct.pack("<f", float("nan"))),
        (48, struct.pack("<f", float("inf"))),
        (96, struct.pack("<H", 1)),
        (98, struct.pack("<H", 7)),
        (100, struct.pack("<H", 1)),
        (102, struct.pack("<H", 1)),
        (104, struct.pack("<f", float("nan"))),
        (104 + 16, struct.pack("<f", -1.0)),
    ],
)
def test_read_faults(tmp_path, offset, data):
    path = tmp_path / "t"
    path.write_bytes(spoil(offset, data))
    with pytest.raises(SigtokError):
        load(path)


def test_codes_stay_in_the_codebook(tmp_path):
    small = replace(SMALL, codebook_size=100)
    payload = tokens.group_bytes([row(0, 64, codes=[5] * 15 + [100])], SMALL)[0]
    path = tmp_path / "t"
    head = tokens._record(1, tokens.Header(small, read_count=1).to_json_dict())
    end = tokens._record(4, {"group_count": 1, "read_count": 1, "chunk_count": 1})
    path.write_bytes(tokens.PREAMBLE.pack(tokens.MAGIC, 1, 0, 0) + head + payload + end)
    with pytest.raises(SigtokError, match="codebook"):
        load(path)


@pytest.mark.parametrize(
    "payload", [b'{"a":1,"a":2}', b'{"a":NaN}', b'{"a":Infinity}', b"\xff", b"[", b'{"a":' + b"[" * 100_000]
)
def test_strict_json(payload):
    with pytest.raises(SigtokError):
        tokens.loads(payload, "it")


def test_json_values():
    assert tokens.dumps({"b": 1, "a": "é"}) == '{"a":"é","b":1}'.encode()
    for bad in (True, 1.0, "1", -1, 11):
        with pytest.raises(SigtokError):
            checked(bad, Whole(0, 10), "it")
    for bad in (1, "\ud800", "x" * 300):
        with pytest.raises(SigtokError):
            checked(bad, Text(256), "it")
    right = tokens.run_info_json(info())
    assert tokens.run_info_row(checked(right, tokens.RUN_INFO_SHAPE, "it")) == info()
    for key, value in (("sample_rate", 70000), ("adc_min", True), ("context_tags", [["a"]]), ("context_tags", {}), ("software", 3)):
        with pytest.raises(SigtokError):
            checked(right | {key: value}, tokens.RUN_INFO_SHAPE, "it")
    with pytest.raises(SigtokError):
        tokens.parse_group(json.dumps({"read_count": 1, "run_infos": [], "pore_types": ["a"], "end_reasons": ["b"]}).encode(), 0)


def test_identify():
    assert [tokens.identify(b) for b in (tokens.MAGIC, b"PK\x03\x04", b"\x8bPOD\r\n\x1a\n", b"x", b"")] == ["tokens", "zip", "pod5", "unknown", "unknown"]


def test_writer_guards():
    for bad in ({"centers": []}, {"codes": [1]}, {"read_id": b"short"}):
        with pytest.raises(SigtokError):
            tokens.group_bytes([row(0, 64, **bad)], SMALL)


def test_source_reads_groups_in_parallel(spark, tmp_path):
    path = tmp_path / "t"
    path.write_bytes(file_of(GROUPS))
    df = tokens.read_tokens(spark, str(path))
    assert df.rdd.getNumPartitions() == 3
    rows = {r.read_pos: r for r in df.collect()}
    assert rows[6].codes == GROUPS[2][1]["codes"] and rows[0].codes == [] and rows[0].codes == []
    for pairs in ("context_tags", "tracking_id"):
        assert [tuple(x) for x in rows[3].run_info[pairs]] == info(0)[pairs]
    slim = tokens.read_tokens(spark, str(path), with_codes=False)
    assert all(r.codes is None for r in slim.collect())
    assert {r.name for r in tokens.header_frame(spark, str(path)).collect()} == {"format", "model", "profile", "read_count", "producer"}


def test_write_is_atomic_and_ordered(spark, data, tmp_path):
    reads, run_info = demo.full_reads(spark, data)
    codec = codecs.MeanQuant(SMALL)
    stored = pipeline.stored_reads(reads, run_info, pipeline.encode(reads, codec, SMALL), SMALL, group_reads=4)
    path = tmp_path / "t"
    tokens.write_tokens(stored, str(path), SMALL)
    first = path.read_bytes()
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="exists"):
        tokens.write_tokens(stored, str(path), SMALL)
    tokens.write_tokens(stored.repartition(3), str(path), SMALL, force=True)
    assert path.read_bytes() == first
    header, rows = load(path)
    assert [r["read_pos"] for r in rows] == sorted(r["read_pos"] for r in rows) and header.read_count == len(rows)
    broken = stored.withColumn("codes", stored.codes.cast("array<int>")).selectExpr("* except (codes)", "array(1) as codes")
    with pytest.raises(Exception):  # noqa: B017
        tokens.write_tokens(broken, str(path), SMALL, force=True)
    assert path.read_bytes() == first and [p.name for p in tmp_path.iterdir()] == ["t"]


def left(df):
    """(partitions, read positions) of a scan."""
    return df.rdd.getNumPartitions(), sorted(r.read_pos for r in df.select("read_pos").collect())


def test_filters_on_ids_leave_out_groups(spark, tmp_path):
    path = tmp_path / "t"
    path.write_bytes(file_of(GROUPS))
    for df in (tokens.read_tokens(spark, str(path)), tokens.read_windows(spark, str(path))):
        # read 0 has no windows
        first = [0] if "num_chunks" in df.columns else []
        scan = lambda c, df=df: (left(df.where(c))[0], sorted(set(left(df.where(c))[1])))
        assert scan("read_pos >= 4") == (2, [4, 5, 6])
        assert scan("read_pos > 4 and read_pos < 6") == (1, [5])
        assert scan("read_pos = 2") == (1, [2])
        assert scan("read_pos in (0, 3, 6)") == (2, [*first, 3, 6])
        assert scan("group_id = 1") == (1, [4])
        assert scan("group_id <= 1 and read_pos <= 3") == (1, [*first, 1, 2, 3])
        assert scan("read_pos in (1, 5) and group_id in (1, 2)") == (1, [5])
        assert scan("read_pos > 6") == (1, []) and scan("read_pos < 0") == (1, []) and scan("group_id = 7") == (1, [])
        # what isn't a range of ids is left to Spark
        assert scan("not read_pos = 2") == (3, [*first, 1, 3, 4, 5, 6])
        assert scan("read_pos = 2 or group_id = 2") == (3, [2, 5, 6])
        assert scan("read_pos <=> 2")[1] == [2] and scan("num_samples > 90")[1] == [3, 6]
        assert scan("read_pos is null")[1] == []


def test_reads_that_are_not_asked_for_have_no_windows_read(tmp_path):
    path = tmp_path / "t"
    rows = [row(0, 200), row(1, 90)]
    whole = bytearray(file_of([rows]))
    at = whole.index(rows[0]["read_id"]) + tokens.META.itemsize
    whole[at : at + 4] = struct.pack("<f", float("nan"))  # read 0's first center can't be
    path.write_bytes(whole)
    header, parts = tokens.plan_scan(str(path))
    wanted = tokens.Wanted(bounds={"group_id": (0, 9), "read_pos": (1, 1)})
    for rows_of in (lambda w: [r["read_pos"] for r in tokens.iter_group(str(path), parts[0], SMALL, wanted=w)],
                    lambda w: [r for b in tokens.iter_windows(str(path), parts[0], SMALL, w) for r in b.column(1).to_pylist()]):
        assert set(rows_of(wanted)) == {1}
        with pytest.raises(SigtokError, match="finite"):
            rows_of(None)


def test_window_rows_are_bounded_however_long_a_read_is(spark, tmp_path):
    path = tmp_path / "t"
    n = SMALL.hop_samples * 2500 + 17
    groups = [[row(0, n), row(1, 0), row(2, 90)], [row(3, 64, 1)]]
    path.write_bytes(file_of(groups))
    header, parts = tokens.plan_scan(str(path))
    batches = list(tokens.iter_windows(str(path), parts[0], SMALL, rows=1000))
    k = tokens.chunk_total(n, SMALL)
    assert [b.num_rows for b in batches] == [1000, 1000, k - 2000, 2] and max(b.nbytes for b in batches) < 120_000
    got = {(r.read_pos, r.seq): r for r in tokens.read_windows(spark, str(path)).collect()}
    t = SMALL.tokens_per_chunk
    want = [(r, i) for g in groups for r in g for i in range(len(r["centers"]))]
    assert len(got) == len(want)
    for r, i in want:
        g = got[r["read_pos"], i]
        assert (g.group_id, g.num_samples, g.codes) == (r["group_id"], r["num_samples"], r["codes"][i * t : (i + 1) * t])
        assert np.float32(g.center) == np.float32(r["centers"][i]) and np.float32(g.scale) == np.float32(r["scales"][i])
    with pytest.raises(Exception, match="reads or windows"):
        spark.read.format(tokens.FORMAT).option("path", str(path)).option("rows", "samples").load()


def test_atomic_file(tmp_path):
    target = tmp_path / "x"
    with AtomicFile(str(target)) as fh:
        fh.write(b"1")
        assert not target.exists()
    assert target.read_bytes() == b"1"
    with pytest.raises(RuntimeError), AtomicFile(str(target), force=True) as fh:
        raise RuntimeError
    assert target.read_bytes() == b"1" and len(list(tmp_path.iterdir())) == 1
    for bad in (lambda: AtomicFile(str(target)), lambda: AtomicFile(str(tmp_path)), lambda: AtomicFile(str(tmp_path / "no" / "x")), lambda: AtomicFile(str(target), True, (str(target),))):
        with pytest.raises(UsageError):
            bad()


@pytest.mark.parametrize("limit", [0, 1, 2, 4, 7, 9, 10, 11, 100])
def test_subset_copies_the_first_reads(tmp_path, limit):
    path, part = tmp_path / "t", tmp_path / "part"
    path.write_bytes(file_of(GROUPS))
    _, rows = load(path)
    want, chunks = [], 0
    for r in rows:
        if chunks >= limit:
            break
        want.append(r)
        chunks += r["num_chunks"]
    header = tokens.write_subset(str(path), str(part), limit)
    got_header, got = load(part)
    assert got == want or [{k: str(v) for k, v in r.items()} for r in got] == [{k: str(v) for k, v in r.items()} for r in want]
    assert header == got_header and header.read_count == len(want)
    if len(want) == len(rows):
        assert part.read_bytes() == path.read_bytes()
    with pytest.raises(UsageError):
        tokens.write_subset(str(path), str(part), limit)
    with pytest.raises(UsageError, match="input"):
        tokens.write_subset(str(path), str(path), limit, force=True)


def given_reads(spark, data, tmp_path):
    reads, run_info = demo.full_reads(spark, data)
    reads.drop("offset", "scale").write.parquet(f"{tmp_path}/in/reads")
    run_info.write.parquet(f"{tmp_path}/in/run_info")
    return spark.read.parquet(f"{tmp_path}/in/reads"), spark.read.parquet(f"{tmp_path}/in/run_info")


def test_encode_and_decode_files(spark, data, tmp_path):
    reads, run_info = given_reads(spark, data, tmp_path)
    report = pipeline.encode_file(spark, f"{tmp_path}/in", f"{tmp_path}/t", "mean-quant", SMALL).first()
    _, rows = load(tmp_path / "t")
    assert (report.reads, report.samples) == (reads.count(), sum(r["num_samples"] for r in rows))
    assert (report.chunks, report.groups) == (sum(r["num_chunks"] for r in rows), 1 + max(r["group_id"] for r in rows))
    assert report.payload_bytes == sum(tokens.payload_bytes(r["num_chunks"], SMALL) for r in rows) and report.empty_reads == 0
    assert report.ratio == pytest.approx(2 * report.samples / report.payload_bytes, abs=1e-6) and report.seconds > 0
    pipeline.decode_file(spark, f"{tmp_path}/t", f"{tmp_path}/out", p=SMALL)
    back = {r.read_pos: r for r in spark.read.parquet(f"{tmp_path}/out/reads").collect()}
    for r in reads.collect():
        b = back[r.read_pos]
        assert len(b.signal) == r.num_samples and b.read_id == r.read_id and b.acquisition_id == r.acquisition_id and b.pore_type == r.pore_type
    assert spark.read.parquet(f"{tmp_path}/out/run_info").count() == 2


def test_input_is_checked_where_it_is_encoded(spark, data, tmp_path):
    reads, run_info = given_reads(spark, data, tmp_path)
    faults = [
        (reads.withColumn("calibration_scale", F.when(F.col("read_pos") == 3, 0).otherwise(F.col("calibration_scale")).cast("float")), "rule calibration is broken at read_pos 3"),
        (reads.withColumn("end_reason", F.when(F.col("read_pos") == 2, "odd").otherwise(F.col("end_reason"))), "rule end_reason is broken at read_pos 2"),
        (reads.withColumn("signal", F.when(F.col("read_pos") == 4, F.slice("signal", 1, 2)).otherwise(F.col("signal"))), "rule signal_length is broken at read_pos 4"),
        (reads.withColumn("open_pore_level", F.when(F.col("read_pos") == 5, None).otherwise(F.col("open_pore_level"))), "column open_pore_level is null at read_pos 5"),
        (reads.withColumn("num_samples", F.col("num_samples").cast("int")), "reads.num_samples is int, not bigint"),
        (reads.drop("well"), "reads has no column well"),
    ]
    for n, (bad, message) in enumerate(faults):
        bad.write.parquet(f"{tmp_path}/bad{n}/reads")
        run_info.write.parquet(f"{tmp_path}/bad{n}/run_info")
        with pytest.raises(SigtokError, match=message):
            pipeline.encode_file(spark, f"{tmp_path}/bad{n}", f"{tmp_path}/t{n}", "mean-quant", SMALL)
        assert not (tmp_path / f"t{n}").exists()
    infos = [
        (run_info.selectExpr("* except (sample_rate)", "4000 as sample_rate"), "rule sample_rate is broken"),
        (run_info.withColumn("sample_id", F.when(F.col("acquisition_id") == "run-0", None).otherwise(F.col("sample_id"))), "column sample_id is null"),
        (run_info.withColumn("software", F.repeat(F.lit("x"), (1 << 20) + 1)), "rule run_info_texts is broken"),
        (run_info.withColumn("protocol_start_time_ms", F.timestamp_millis(F.lit(5))), "run_info.protocol_start_time_ms is timestamp, not bigint"),
    ]
    for n, (bad, message) in enumerate(infos):
        bad.write.parquet(f"{tmp_path}/info{n}/run_info")
        reads.limit(0).write.parquet(f"{tmp_path}/info{n}/reads")
        with pytest.raises(SigtokError, match=message):
            pipeline.encode_file(spark, f"{tmp_path}/info{n}", f"{tmp_path}/t", "mean-quant", SMALL)


def test_files_are_checked_before_they_are_decoded(spark, tmp_path):
    path, out = tmp_path / "t", str(tmp_path / "out")
    path.write_bytes(file_of(GROUPS))
    with pytest.raises(SigtokError, match="profile differs in chunk_samples, overlap_samples, hop_samples, tokens_per_chunk"):
        pipeline.decode_file(spark, str(path), out)
    path.write_bytes(file_of([[row(0, 64), row(1, 200, end_reason="a new one")]]))
    with pytest.raises(SigtokError, match="end reason that isn't known"):
        pipeline.decode_file(spark, str(path), out, p=SMALL)
    path.write_bytes(file_of(GROUPS, header=replace(tokens.Header(SMALL), read_count=7, model=replace(tokens.Header().model, revision="1" * 40))))
    with pytest.raises(SigtokError, match="written by model"):
        pipeline.decode_file(spark, str(path), out, p=SMALL)
    assert not (tmp_path / "out").exists()


def test_missing_run_info_is_an_error(spark, data):
    reads, run_info = demo.full_reads(spark, data)
    one = run_info.where("acquisition_id = 'run-0'")
    with pytest.raises(Exception, match="no run info run-1"):
        pipeline.stored_reads(reads, one, pipeline.encode(reads, codecs.MeanQuant(SMALL), SMALL), SMALL).collect()


def test_command_line(tmp_path, capsys):
    path = tmp_path / "t"
    path.write_bytes(file_of(GROUPS))
    assert main(["ls"]) == 0 and "mean-quant" in capsys.readouterr().out
    assert main(["info"]) == 0 and "chunk_samples\t8192" in capsys.readouterr().out
    assert main(["info", str(path)]) == 0 and "read_count\t7" in capsys.readouterr().out
    assert main(["encode", "x"]) == 2
    assert main(["encode", "x", "-o", "y", "--batch-size", "0"]) == 2
    assert main(["encode", "x", "-o", "y", "--codec", "none"]) == 2
    (tmp_path / "bad").write_bytes(b"\x8bPOD\r\n\x1a\n")
    assert main(["info", str(tmp_path / "bad")]) == 1 and "POD5" in capsys.readouterr().err
