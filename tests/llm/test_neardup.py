"""op2 and components against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from sigtok.llm import neardup
from sigtok.llm.components import connected
from tests.llm.conftest import CLASHES, ODD


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def components(texts, size, percent=80):
    sets = {n: shingle_set(t, size) for n, t in texts}
    top = {n: n for n in sets}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {n: (len(sets[n]), root(n)) for n in ids}


def family(rng, words, copies, edits):
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (5, 2)])
def test_components_equal_brute_force(docs, size, seed):
    rng = random.Random(seed)
    texts = list(ODD)
    for words, copies, edits in ((120, 20, 6), (60, 15, 3), (200, 10, 12), (40, 12, 2), (12, 6, 1), (80, 25, 8)):
        texts += family(rng, words, copies, edits)
    texts += ["Exact Copy of some text here"] * 40 + ["exact copy of some text here"]
    rng.shuffle(texts)
    numbered = list(enumerate(texts))
    want = components(numbered, size)
    rows = neardup.near_duplicates(docs(numbered, CLASHES), size=size).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == r.component_id)


def test_chain_links_are_not_lost(docs):
    """Each text is near the next alone, so no hub is near them all."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(260)]
    numbered = [(k, " ".join(words[k * 6 : k * 6 + 100])) for k in range(25)]
    want = components(numbered, 2)
    assert len({c for _, c in want.values()}) == 1
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(numbered), size=2).collect()}
    assert set(got.values()) == {0}


def test_large_buckets_go_by_blocks(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(5)
    numbered = list(enumerate(family(rng, 60, 60, 6) + family(rng, 50, 30, 4)))
    want = components(numbered, 2)
    for r in neardup.near_duplicates(docs(numbered), size=2).collect():
        assert r.component_id == want[r.doc_id][1]


@pytest.mark.parametrize("percent", [40, 60])
def test_lower_thresholds_equal_brute_force(docs, percent):
    """Bands follow the threshold, and texts of very different sizes may be linked."""
    rng = random.Random(percent)
    texts = []
    for words, copies, edits in ((60, 8, 12), (90, 8, 25), (30, 6, 5)):
        texts += family(rng, words, copies, edits)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(200))
    texts += [long, " ".join(long.split()[:100]), " ".join(long.split()[60:150])]
    numbered = list(enumerate(texts))
    want = components(numbered, 2, percent)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(numbered), size=2, percent=percent).collect()}
    assert got == {n: c for n, (_, c) in want.items()}


def test_thresholds_without_bands_are_refused():
    assert [neardup.band_rows(p) for p in (100, 80, 60, 40)] == [8, 4, 2, 1]
    with pytest.raises(ValueError, match="percent"):
        neardup.band_rows(5)


def test_outliers_of_a_large_component_cost_no_square(docs, spark):
    """One component of 3000 and 5 others in one bucket: rows grow with the members, not with their square."""
    rows = [(1, k, 0 if k < 3000 else k) for k in range(3005)]
    dealt = neardup._dealt(spark.createDataFrame(rows, "bucket long, id long, comp long"))
    assert dealt.count() == 3005 + 5 * -(-3005 // neardup.BLOCK)
    assert dealt.groupBy("bucket", "i", "j").count().agg({"count": "max"}).first()[0] <= 2 * neardup.BLOCK


def test_stage_keeps_one_of_each(docs):
    rng = random.Random(6)
    texts = family(rng, 100, 5, 1) + ["alone in the world with words"] + [None, "", ""]
    table = docs([*enumerate(texts), (None, texts[0])], CLASHES)
    out = neardup.drop_near_duplicates(table)
    assert out.columns == table.columns
    assert {r.doc_id for r in out.collect()} == {0, 6, 7, 8, 9, None}
    assert neardup.drop_near_duplicates(docs([])).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, 2000 - len(both), dtype=np.uint64)]) for _ in range(2))
            sim = len(both) / (4000 - len(both))
            sa, sb = (np.frombuffer(neardup.signature(neardup.minima(x), 4)[0], np.uint64) for x in (a, b))
            errors.append(neardup.estimates(sa, sb) - sim)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + k, 401 + k) for k in range(70)]
    graph = defaultdict(set)
    for a, b in pairs:
        graph[a].add(b)
        graph[b].add(a)
    want = {}
    for start in sorted(graph):
        if start not in want:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in want:
                    want[n] = start
                    todo += graph[n]
    got = {r.node: r.component for r in connected(spark.createDataFrame(pairs, "u long, v long")).collect()}
    alone = {a for a in graph if graph[a] == {a}}
    assert got == {n: c for n, c in want.items() if n not in alone}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
