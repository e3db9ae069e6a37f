"""The pipeline's stages one after another, and the corpus queries over the test tables."""

import random

import pytest

import corpus_pipeline
from sigtok.llm import queries
from tests.llm.conftest import CLASHES, ODD


def prose(rng, n):
    return " ".join("".join(rng.choices("aeinorstl", k=rng.randint(2, 8))) for _ in range(n)) + "."


def test_stages_by_hand(spark, docs):
    rng = random.Random(1)
    clean = [prose(rng, 80) for _ in range(20)]
    passage = prose(rng, 70)
    near = clean[0].split()
    near[3] = "changed"
    texts = [
        *clean,
        f"{clean[1]}\n{passage}",
        f"{prose(rng, 60)}\n{passage}",
        " ".join(near),
        prose(rng, 60) + ' token = "0123456789abcdef01234567"',
        prose(rng, 70).replace(" ", "### "),
        *ODD,
    ]
    table = docs(texts, CLASHES)
    out = [table]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], "").cache())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out[-1].columns == table.columns, name
    quality, lines, near_kept, secrets, packed = ({r.doc_id: r for r in df.collect()} for df in out[1:])
    assert set(quality) == set(range(24))
    assert "\n" in lines[21].text or lines[21].text.count(".") == 1
    assert passage in (lines[20].text + "") and passage not in lines[21].text
    assert lines[21].n_chars == len(lines[21].text)
    assert 22 not in near_kept and 0 in near_kept and 23 in near_kept
    assert secrets[23].text.endswith('[secret]"') and secrets[23].n_chars == len(secrets[23].text)
    assert set(packed) == set(secrets)


def test_empty_table(spark, docs):
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, "")
    assert table.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_pipeline_runs(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
