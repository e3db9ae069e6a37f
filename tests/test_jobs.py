"""The jobs on copies of tables: growing input, runs again, batches again, odd rows, the command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobs import common, quality_report, queries, token_archive
from sigtok.errors import SigtokError
from sigtok.operators import codecs, quality
from sigtok.plans import pipeline
from sigtok.profile import PROFILE
from sigtok.sources.adapters import text_reads
from tests.test_tables import comparable, duck

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, source string"
ODD = [(900, None, "a"), (901, "", "a"), (902, "é𝄞" * 5000, None), (903, "x", "1"), (904, "y" * 8193, "1")]


def add_file(spark, folder, name, rows, mode="append"):
    """One more Parquet file of (doc_id, text, source), with columns that the jobs don't read."""
    df = rows if hasattr(rows, "withColumn") else spark.createDataFrame(rows, DOCS)
    df = df.select("doc_id", "text", "source").withColumn("seq", F.lit(7)).withColumn("batch", F.lit("no"))
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}-{name}")
    os.makedirs(folder, exist_ok=True)
    (part,) = Path(f"{folder}-{name}").glob("part-*.parquet")
    part.rename(f"{folder}/{name}.parquet")


def rows_of(df):
    return comparable(tuple(r) for r in df.collect())


def archived(spark, target):
    return token_archive.read_back(spark, target).drop("batch")


def expected(spark, docs):
    return token_archive.encoded(docs.select("doc_id", "text", "source"), token_archive.Config())


def test_archive_takes_only_what_is_new(spark, data, tmp_path, caplog):
    caplog.set_level("INFO", "sigtok.jobs")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    folder, target, mark = (str(tmp_path / n) for n in ("docs", "archive", "mark"))
    add_file(spark, folder, "one", docs.where("doc_id % 2 = 0"))
    first = token_archive.run(spark, folder, target, mark)
    half = docs.where("doc_id % 2 = 0").count()
    assert (first["batches"], first["reads"]) == (1, half)
    assert rows_of(archived(spark, target)) == rows_of(expected(spark, docs.where("doc_id % 2 = 0")))
    before = {p: p.stat().st_mtime_ns for p in Path(target).rglob("part-*")}

    add_file(spark, folder, "two", docs.where("doc_id % 2 = 1"))
    add_file(spark, folder, "three", ODD)
    os.utime(f"{folder}/three.parquet", (1_000_000, 1_000_000))  # arrives late, with a time of 1970
    second = token_archive.run(spark, folder, target, mark, token_archive.Config(files_per_batch=1))
    assert (second["batches"], second["reads"]) == (2, docs.count() - half + len(ODD))
    everything = docs.select("doc_id", "text", "source").union(spark.createDataFrame(ODD, DOCS))
    assert rows_of(archived(spark, target)) == rows_of(expected(spark, everything))
    # what was there is not written again
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert token_archive.run(spark, folder, target, mark) == {"batches": 0, "reads": 0, "samples": 0, "windows": 0}
    assert rows_of(archived(spark, target)) == rows_of(expected(spark, everything))
    assert f"read {half} reads of {first['samples']} samples" in caplog.text and "0 batches" in caplog.text


def test_archive_keeps_every_read_and_brings_it_back(spark, tmp_path):
    folder, target = str(tmp_path / "docs"), str(tmp_path / "archive")
    add_file(spark, folder, "odd", ODD)
    config = token_archive.Config(codec="mean-quant")
    done = token_archive.run(spark, folder, target, str(tmp_path / "mark"), config)
    assert done == {"batches": 1, "reads": 5, "samples": 18_194, "windows": 5}
    rows = archived(spark, target).orderBy("read_pos", "seq").collect()
    assert [(r.read_pos, r.num_samples, r.seq, r.start, r.valid, r.source) for r in rows] == [
        (900, 0, None, None, 0, "a"), (901, 0, None, None, 0, "a"), (902, 10_000, 0, 0, 8192, None), (902, 10_000, 1, 1808, 8192, None),
        (903, 1, 0, 0, 1, "1"), (904, 8193, 0, 0, 8192, "1"), (904, 8193, 1, 1, 8192, "1"),
    ]
    assert all(len(r.codes) == (0 if r.seq is None else 4 * PROFILE.tokens_per_chunk) for r in rows)
    codes = F.transform(F.sequence(F.lit(0), F.lit(PROFILE.tokens_per_chunk - 1)), lambda i: F.conv(F.substr("codes", i * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    tokens = archived(spark, target).where("seq is not null").select("read_pos", "seq", "center", "scale", codes.alias("codes"))
    reads = text_reads(spark.createDataFrame(ODD, DOCS))
    codec = codecs.MeanQuant()
    back = {r.read_pos: r.signal for r in pipeline.decode(tokens, reads, codec).collect()}
    assert back == {r.read_pos: r.signal for r in pipeline.roundtrip(reads, codec).collect()}
    assert back[900] == [] and len(back[902]) == 10_000


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    target, config = str(tmp_path / "archive"), token_archive.Config()
    other = spark.createDataFrame([(1, "hello there", "a"), (2, "more", "b")], DOCS)
    docs = spark.createDataFrame(ODD, DOCS)
    token_archive.archive(other, 0, target, config)
    once = token_archive.archive(docs, 1, target, config)
    rows = rows_of(token_archive.read_back(spark, target))
    assert token_archive.archive(docs, 1, target, config) == once
    assert rows_of(token_archive.read_back(spark, target)) == rows


def test_archive_of_an_empty_table_and_of_a_single_file(spark, tmp_path):
    folder = str(tmp_path / "docs")
    add_file(spark, folder, "none", [])
    assert token_archive.run(spark, folder, str(tmp_path / "a"), str(tmp_path / "m"))["reads"] == 0
    add_file(spark, folder, "odd", ODD)
    single = token_archive.run(spark, f"{folder}/odd.parquet", str(tmp_path / "b"), str(tmp_path / "n"))
    assert single["reads"] == len(ODD)


def by_hand(rows):
    """Figures of one partition value in numpy, from whole reads."""
    out = {("input", "all", "reads"): len(rows), ("input", "all", "samples"): sum(len(a) for a, _ in rows)}
    lengths = [len(a) for a, _ in rows]
    for name, q in quality_report.MARKS.items():
        out["read_length", "all", name] = np.quantile(lengths, q)
    errors = [np.abs(np.array(b, float) - np.array(a, float)).mean() * float(np.float32(0.1755)) for a, b in rows if len(a)]
    for name, q in quality_report.MARKS.items():
        out["read_mae", "all", name] = np.quantile(errors, q)
    out["overall", "all", "mae_pa"] = sum(e * n for e, n in zip(errors, [n for n in lengths if n])) / sum(lengths)
    return out


def test_a_report_codes_and_compares_in_one_worker_without_a_shuffle(spark, monkeypatch):
    plans = {}
    keep = quality_report.stored
    monkeypatch.setattr(quality_report, "stored", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    quality_report.figures(spark.createDataFrame(ODD, DOCS), quality_report.Config())
    assert plans["report-segments"].count("MapInArrow") == 2 and "Exchange" not in plans["report-segments"]


def test_an_archive_cuts_and_encodes_in_one_worker(spark):
    rows = token_archive.encoded(spark.createDataFrame(ODD, DOCS), token_archive.Config())
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_report_against_whole_reads(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").union(spark.createDataFrame(ODD, DOCS))
    folder, target = str(tmp_path / "docs"), str(tmp_path / "report")
    add_file(spark, folder, "all", docs)
    total = quality_report.run(spark, folder, target)
    assert total["reads"] == docs.count()
    rows = quality_report.read_back(spark, target).collect()
    assert len(rows) == total["figures"]
    got = {(r.source, r.section, r.name, r.figure): r.value for r in rows}
    reads = text_reads(docs, ["source"])
    back = pipeline.roundtrip(reads, codecs.MeanQuant()).select("read_pos", F.col("signal").alias("back"))
    pairs = {}
    for r in reads.join(back, "read_pos").collect():
        pairs.setdefault(r.source, []).append((r.signal, r.back))
    for source in ("1", None, "a", max((s for s in pairs if s), key=lambda s: len(pairs[s]))):
        if source == "a":
            assert got["a", "input", "all", "reads"] == 2 and ("a", "overall", "all", "mae_pa") not in got
            continue
        for key, value in by_hand(pairs[source]).items():
            assert got[(source, *key)] == pytest.approx(value, abs=2e-5), (source, key)
    regions = quality.by_region(quality.segment_errors(pipeline.compared(reads, codecs.MeanQuant()))).collect()
    for r in regions:
        n = sum(x.n for x in rows if (x.section, x.name, x.figure) == ("region", r.region, "mae_pa"))
        assert n == r.samples

    # again: the same; with more input: only partitions that were seen change
    assert quality_report.run(spark, folder, target) == total
    assert comparable(map(tuple, rows)) == rows_of(quality_report.read_back(spark, target))
    add_file(spark, f"{folder}-new", "more", [(5000, "new text of a new source", "new"), (5001, "z" * 100, "1")])
    quality_report.run(spark, f"{folder}-new", target)
    after = {(r.source, r.section, r.name, r.figure): r.value for r in quality_report.read_back(spark, target).collect()}
    assert after["new", "input", "all", "reads"] == 1 and after["1", "input", "all", "samples"] == 100
    assert {k: v for k, v in after.items() if k[0] not in ("1", "new")} == {k: v for k, v in got.items() if k[0] != "1"}


def test_report_of_tables_without_a_result(spark, tmp_path):
    folder = str(tmp_path / "docs")
    add_file(spark, folder, "none", [])
    assert quality_report.run(spark, folder, str(tmp_path / "r")) == {"reads": 0, "samples": 0, "windows": 0, "figures": 0}
    for bad in ([(1, "a", "s"), (1, "b", "s")], [(None, "a", "s")]):
        add_file(spark, f"{folder}-bad", "bad", bad)
        with pytest.raises(SigtokError, match="ids of their own"):
            quality_report.run(spark, f"{folder}-bad", str(tmp_path / "x"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = duck(data).execute(queries.SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in found.fetchall()]
    assert comparable(tuple(r[n] for n in names) for r in df.collect()) == comparable(want)


def test_config_files(tmp_path):
    for kind, name in ((token_archive.Config, "token_archive"), (quality_report.Config, "quality_report")):
        assert common.config_of(kind, str(ROOT / "jobs" / f"{name}.json")) == kind() == common.config_of(kind, None)
    path = tmp_path / "c.json"
    for bad in ({"more": 1}, [], {"files_per_batch": "1"}, {"codec": 1}, {"files_per_batch": True}):
        path.write_text(json.dumps(bad))
        with pytest.raises(SigtokError, match="config"):
            common.config_of(token_archive.Config, str(path))


def test_command_line(spark, tmp_path):
    folder, config = str(tmp_path / "docs"), tmp_path / "c.json"
    add_file(spark, folder, "odd", ODD)
    config.write_text('{"files_per_batch": 1}')
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf spark.checkpoint.dir={tmp_path}/shared pyspark-shell"}
    for args in (["token_archive", folder, str(tmp_path / "a"), str(tmp_path / "m"), "--config", str(config)], ["quality_report", folder, str(tmp_path / "r")]):
        done = subprocess.run([sys.executable, "-m", f"jobs.{args[0]}", *args[1:]], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "INFO" in done.stderr and folder in done.stderr
    assert archived(spark, str(tmp_path / "a")).count() == 7
    assert quality_report.read_back(spark, str(tmp_path / "r")).where("section = 'input'").count() == 12
    bad = subprocess.run([sys.executable, "-m", "jobs.token_archive", folder], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert bad.returncode == 2 and "usage" in bad.stderr


def test_jobs_stand_without_the_corpus_part():
    for path in [*(ROOT / "jobs").glob("*.py"), Path(__file__)]:
        lines = [x for x in path.read_text().splitlines() if x.lstrip().startswith(("import ", "from "))]
        assert not any("llm" in x or "corpus_pipeline" in x for x in lines)
