"""op11: ids and decoded texts equal the library's; the prefix table equals merging by its definition."""

import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sigtok.llm import prefixbpe
from sigtok.llm.prefixbpe import NEVER, PrefixTable, WordEndBpe
from tests.llm.conftest import CLASHES, ODD
from tests.llm.test_tokenizers import mixed


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(prefixbpe.VOCABULARY)


@pytest.fixture(scope="module")
def own():
    return WordEndBpe(prefixbpe.VOCABULARY)


def merged(symbols, ranks):
    """Merging by its definition: the pair of the least rank, leftmost first."""
    parts = list(symbols)
    while True:
        pairs = [(ranks[p], n) for n, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        if not pairs:
            return parts
        n = min(pairs)[1]
        parts[n : n + 2] = [parts[n] + parts[n + 1]]


def same(own, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == ids, repr(text)
    assert own.decode(got).decode() == library.decode(ids, skip_special_tokens=False), repr(text)


def test_ids_and_decoding_equal_the_librarys(own, library):
    for text in mixed(4000, 5):
        same(own, library, text)
    rng = random.Random(6)
    for _ in range(4000):
        same(own, library, "".join(rng.choices("abcdeinorstuàéüßÅ0123'!?</w>́‍ 한ΣςĐ", k=rng.randrange(1, 25))))


def test_special_tokens_in_texts_are_ids(own, library):
    for text in ("<|startoftext|>", "a<|endoftext|>b", "<|ENDOFTEXT|>", "<|<|endoftext|>|>", "x <|endoftext|><|startoftext|> y"):
        same(own, library, text)


def test_long_words_are_whole(own, library):
    rng = random.Random(7)
    for text in ("ab" * 60_000, "".join(rng.choices("etaoin", k=60_000)), "!" * 30_000, "한" * 20_000):
        same(own, library, text)


def test_full_caches_change_no_result(library, monkeypatch):
    monkeypatch.setattr(WordEndBpe, "budget", 2000)
    monkeypatch.setattr(PrefixTable, "budget", 2000)
    small = WordEndBpe(prefixbpe.VOCABULARY)
    for text in mixed(800, 8):
        same(small, library, text)
    assert len(small) < 50 and len(small.words) < 50


@pytest.mark.parametrize("seed", range(40))
def test_prefix_table_equals_merging_on_random_vocabularies(seed):
    """Vocabularies of random merges, also bad ones, over two or three letters."""
    rng = random.Random(seed)
    letters = "abc"[: rng.choice([1, 2, 3])]
    vocab = {t: n for n, t in enumerate([*letters, *(x + "</w>" for x in letters)])}
    merges = []
    for _ in range(40):
        left = rng.choice([t for t in vocab if not t.endswith("</w>")])
        right = rng.choice(list(vocab))
        if left + right not in vocab:
            vocab[left + right] = len(vocab)
            merges.append((left, right))
    table = PrefixTable({"vocab": vocab, "merges": [list(m) for m in merges], "end_of_word_suffix": "</w>"})
    ranks = {m: n for n, m in enumerate(merges)}
    names = list(vocab)
    for _ in range(300):
        word = "".join(rng.choices(letters, k=rng.randrange(1, 24)))
        want = merged([*word[:-1], word[-1] + "</w>"], ranks)
        assert [names[i] for i in np.frombuffer(table[word], "<u4")] == want
    plain = [t for t in vocab if not t.endswith("</w>")]
    for a in rng.choices(plain, k=60):
        assert table.own(vocab[a]) == (merged(a, ranks) == [a])
        for b in rng.choices(plain, k=10):
            if table.own(vocab[a]) and table.own(vocab[b]):
                assert (table.seam(vocab[a], vocab[b]) == NEVER) == (merged(a + b, ranks) == [a, b])


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    stated = json.load(open(prefixbpe.VOCABULARY, encoding="utf-8"))
    stated["added_tokens"][0]["lstrip"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(stated))
    with pytest.raises(ValueError, match="added tokens"):
        WordEndBpe(str(path))
    with pytest.raises(ValueError, match="merge 1"):
        PrefixTable({"vocab": {"a": 0, "aa": 1, "a</w>": 2}, "merges": ["a a", "a a"], "end_of_word_suffix": "</w>"})


def test_op11(docs, library):
    texts = [*ODD, "word " * 200_000, "one two"]
    rows = prefixbpe.digests(docs([*enumerate(texts), (None, "one two"), (6, "one two")], CLASHES)).collect()
    assert len(rows) == len(texts) + 2
    by_id = {r.doc_id: r for r in rows}
    full = {r.doc_id: r for r in prefixbpe.encode_decode(docs(texts)).collect()}
    for n, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert full[n].ids == ids and full[n].decoded == decoded
        assert by_id[n].n_tokens == len(ids)
        assert by_id[n].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by_id[n].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert by_id[None].ids_sha256 == by_id[6].ids_sha256 == by_id[18].ids_sha256
    assert prefixbpe.digests(docs([])).count() == 0
