"""op6, op8, op9: ids equal the libraries', on odd texts and whole tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigtok.llm import packing, pieces, tokenfile
from sigtok.llm.common import shared_path
from sigtok.llm.wordcache import ByteLevelUnits, LowerWordUnits
from tests.llm.conftest import CLASHES, ODD

ALPHABET = [*"aZéß \n\t .'s!İſﬁ½²一ñ#|", "  ", "\n\n", "   ", "<|endoftext|>", "'ll", "\0", "\x1c", "▁", "🙂", "the", "ing"]


def mixed(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(14))) for _ in range(n)] + [t or "" for t in ODD]


@pytest.mark.parametrize(("kind", "name"), [(ByteLevelUnits, "byte_bpe_50k.json"), (LowerWordUnits, "word_bpe_49k.json")])
def test_units_give_the_librarys_ids(kind, name):
    path = public_tokenizers.path(name)
    own, library = kind(path), Tokenizer.from_file(path)
    for text in mixed(3000):
        assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_prefix_table_gives_the_librarys_ids():
    own = pieces.PieceUnits(pieces.MODEL)
    for text in mixed(3000, 2):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.processor.encode(text), repr(text)


def test_prefix_table_equals_merging():
    own = pieces.PieceUnits(pieces.MODEL)
    rng = random.Random(3)
    for _ in range(500):
        word = "▁" + "".join(rng.choices("abcdeinorstuäé", k=rng.randrange(1, 15)))
        assert own.segment(word) == own.merged(word)


def test_op8(docs):
    got = {r.doc_id: r for r in pieces.digests(docs(ODD, CLASHES)).collect()}
    full = {r.doc_id: r for r in pieces.encode_decode(docs(ODD)).collect()}
    processor = pieces.PieceUnits(pieces.MODEL).processor
    assert len(got) == len(ODD)
    for n, text in enumerate(ODD):
        ids = processor.encode(text or "")
        assert full[n].ids == ids and full[n].decoded == processor.decode(ids)
        assert got[n].n_tokens == len(ids)
        assert got[n].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[n].decoded_sha256 == hashlib.sha256(processor.decode(ids).encode()).hexdigest()
    assert got[6].ids_sha256 == got[18].ids_sha256
    assert pieces.digests(docs([])).count() == 0


def test_op6_round_trip(spark, docs):
    library = Tokenizer.from_file(tokenfile.VOCABULARY)
    path = shared_path(spark, "test-orc")
    table = docs([*ODD, (6, "one two")], CLASHES)
    tokenfile.write_tokens(table, path)
    stored = tokenfile.read_tokens(spark, path)
    by_file = defaultdict(list)
    for r in stored.orderBy("file", "row").collect():
        by_file[r.file].append(r.doc_id)
    assert all(ids == sorted(ids) for ids in by_file.values())
    index = tokenfile.token_index(spark, path).collect()
    start, counts = 0, defaultdict(int)
    for r in sorted(index, key=lambda r: (r.doc_id, r.start)):
        ids = [*library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens) == (start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
        counts[r.doc_id] += 1
    assert counts[6] == 2 and len(counts) == len(ODD)
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in stored.where("doc_id = 7")._jdf.queryExecution().toString()
    assert [len(r.ids) for r in stored.where("doc_id = 0").collect()] == [1]


def scanned(df):
    """Rows that come out of a scan, before Spark filters them."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().get("numOutputRows").get().value()


def test_op6_indexes_leave_out_rows(spark, docs):
    """Row indexes leave groups of 1000 rows, Bloom filters ids that lie between those that are there."""
    path = shared_path(spark, "test-orc-index")
    table = spark.range(0, 40_000, 2, 1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    tokenfile.write_tokens(table, path)
    stored = tokenfile.read_tokens(spark, path).select("doc_id", "ids")
    assert scanned(stored) == 20_000
    assert 0 < scanned(stored.where("doc_id = 20000")) <= 1000
    assert 0 < scanned(stored.where("doc_id between 5000 and 5100")) <= 2000
    absent = [scanned(stored.where(f"doc_id = {k}")) for k in (101, 7001, 20_001, 33_333, 39_999)]
    assert sum(n == 0 for n in absent) >= 4  # a Bloom filter may err now and then
    assert stored.where("doc_id = 7001").count() == 0 and stored.where("doc_id = 7002").count() == 1


def test_op6_empty_table(spark, docs):
    path = shared_path(spark, "test-orc")
    tokenfile.write_tokens(docs([]), path)
    assert tokenfile.token_index(spark, path).count() == 0


def check_layout(rows, capacity):
    spots = defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
    for parts in spots.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(spots)


def test_op9_pieces_and_layout(docs):
    texts = [*ODD, "word " * 5000, "one two"]
    rows = packing.pack(docs(texts, CLASHES)).collect()
    library = Tokenizer.from_file(packing.VOCABULARY)
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append(r)
    for n, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(found[n], key=lambda r: r.piece)] == want
    check_layout(rows, 2048)
    assert packing.pack(docs([])).count() == 0


def test_op9_sequences_hold_the_ids(docs):
    pieces_ = packing.token_pieces(docs(["one two three", "four", None, "five six " * 40]), capacity=32, with_ids=True)
    out = packing.sequences(packing.place(pieces_, 32)).collect()
    assert all(len(r.ids) <= 32 for r in out)
    assert sum(len(r.ids) for r in out) == sum(r.length for r in pieces_.collect())


@pytest.mark.parametrize("seed", range(30))
def test_op9_plan_is_a_packing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 30, 100, 2048])
    counts = {}
    for _ in range(rng.randrange(1, 40)):
        counts[rng.randint(1, capacity)] = rng.randint(1, 50)
    runs, n = packing.plan(dict(counts), capacity)
    fill = defaultdict(list)
    seen = defaultdict(set)
    for length, low, high, per, base, at in runs:
        for k in range(low, high):
            assert k not in seen[length]
            seen[length].add(k)
            fill[base + (k - low) // per].append((at + (k - low) % per * length, length))
    assert {x: len(s) for x, s in seen.items()} == counts
    assert len(fill) == n
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(x * c for x, c in counts.items())
    large = sum(c for x, c in counts.items() if 2 * x > capacity)
    assert n <= max(large, -(-total * 3 // (2 * capacity)) + 1) + 1


def test_op9_large_items_pair_at_most_twice():
    runs, n = packing.plan({700: 4, 1000: 2, 1400: 1}, 2048)
    assert n == 4


def plain_matching(lengths, capacity):
    """The method one piece at a time: large ones pair, longest first, with the longest that fits; the rest go to the tightest gap."""
    large = sorted((x for x in lengths if 3 * x > capacity), reverse=True)
    gaps = []
    while large:
        x = large.pop(0)
        mate = next((y for y in large if x + y <= capacity), 0)
        if mate:
            large.remove(mate)
        gaps.append(capacity - x - mate)
    for x in sorted((x for x in lengths if 3 * x <= capacity), reverse=True):
        gap = min((g for g in gaps if g >= x), default=None)
        if gap is None:
            gap = capacity
        else:
            gaps.remove(gap)
        gaps.append(gap - x)
    return len(gaps)


@pytest.mark.parametrize("seed", range(40))
def test_op9_plan_takes_as_few_sequences_as_the_plain_method(seed):
    rng = random.Random(100 + seed)
    capacity = rng.choice([12, 30, 100, 2048])
    counts = {}
    for _ in range(rng.randrange(1, 30)):
        counts[rng.randint(1, capacity)] = rng.randint(1, 12)
    _, n = packing.plan(dict(counts), capacity)
    plain = plain_matching([x for x, k in counts.items() for _ in range(k)], capacity)
    least = -(-sum(x * k for x, k in counts.items()) // capacity)
    assert least <= n <= plain + 1
