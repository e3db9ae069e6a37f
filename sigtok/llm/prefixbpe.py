"""BPE encoding and decoding by a table of each prefix's last token, for vocabularies with word ends.

Under merges by rank, every prefix of a word has one last token: the one token that ends there, is what
its own characters merge to, and is compatible with the last token of the prefix before it. Two tokens are
compatible if merging their characters never joins them across the seam. The token of each merge being
unique, a token's merges form one tree, and only the tokens on the seam's two sides matter: a pair of
them joins if its rank comes before the merges that take either into its own token.

An automaton finds the tokens that end at each place of a word, the seam test picks the one to store, and
the ids are read backwards from the word's end. Work is linear in a word's length for a given vocabulary,
so a word of a million letters is no special case. Words come from the tokenizer's own normalizer and
pre-tokenizer; a cache bounded in bytes keeps those that come often, and never changes a result.

Decoding writes the token of each id, with spaces between, which is what the library does for a
vocabulary without a decoder.

Defined results: a null or empty text has no ids and decodes to an empty one; texts of any length are
encoded whole; repeated rows and equal texts get equal values, each its own row; a null doc_id stays
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from codecs import charmap_decode
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import arrow_map, documents, whole_text
from sigtok.llm.tokenfile import id_lists
from sigtok.llm.wordcache import Cache, byte_symbols, loaded, packed

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Stands for a word's end; no byte has it as its symbol.
END = "\n"
NEVER = 1 << 62


class PrefixTable(Cache):
    """A word in byte symbols -> id bytes, by its prefix table."""

    budget = 24 << 20
    #: Pairs of tokens whose seam is kept as known; others are tested again.
    max_pairs = 200_000

    def __init__(self, model: dict) -> None:
        import ahocorasick

        super().__init__()
        self.vocab: dict[str, int] = model["vocab"]
        suffix: str = model["end_of_word_suffix"]
        self._parts: dict[int, tuple[int, int]] = {}
        self._rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            made = max(self._made(left), self._made(right))
            if a.endswith(suffix) or whole in self._parts or made >= rank:
                raise ValueError(f"merge {rank} of the vocabulary doesn't make one token of earlier ones")
            self._parts[whole] = left, right
            self._rank[left << 32 | right] = rank
        self.right_side, self.left_side = cache(self._right_side), cache(self._left_side)
        self.own = cache(self._own)
        self._apart: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            word = token.removesuffix(suffix) + END if token.endswith(suffix) else token
            if (len(token) > len(suffix) or word == token) and self.own(i):
                self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()

    def _made(self, token: int) -> int:
        """The rank of the merge that makes a token; -1 for a symbol."""
        return self._rank[self._parts[token][0] << 32 | self._parts[token][1]] if token in self._parts else -1

    def _side(self, token: int, which: int) -> tuple[tuple[int, int], ...]:
        """The tokens along one edge of a token's tree, each with the rank of the merge that takes it up."""
        edge, taken = [(token, NEVER)], NEVER
        while token in self._parts:
            taken = self._made(token)
            token = self._parts[token][which]
            edge.append((token, taken))
        return tuple(edge)

    def _right_side(self, token: int) -> tuple[tuple[int, int], ...]:
        return self._side(token, 1)

    def _left_side(self, token: int) -> tuple[tuple[int, int], ...]:
        return self._side(token, 0)

    def seam(self, a: int, b: int) -> int:
        """The rank at which merging joins something across the seam of two tokens; NEVER if they stay apart.

        Of equal ranks the leftmost merges first: the one within ``a``, then the one across, then ``b``'s.
        """
        first, rank = NEVER, self._rank.get
        for r, r_taken in self.right_side(a):
            for x, x_taken in self.left_side(b):
                m = rank(r << 32 | x)
                if m is not None and m < r_taken and m <= x_taken and m < first:
                    first = m
        return first

    def _own(self, token: int) -> bool:
        """Whether a token's characters merge to that token."""
        if token not in self._parts:
            return True
        a, b = self._parts[token]
        return self.own(a) and self.own(b) and self.seam(a, b) == self._made(token)

    def _stay_apart(self, pair: int) -> bool:
        known = self.seam(pair >> 32, pair & 0xFFFFFFFF) == NEVER
        if len(self._apart) < self.max_pairs:
            self._apart[pair] = known
        return known

    def _make(self, word: str) -> bytes:
        """Last tokens of all prefixes, then the ids backwards from the end."""
        text = word + END
        last: list[int | None] = [None] * (len(text) + 1)
        starts = [0] * (len(text) + 1)
        known, test = self._apart.get, self._stay_apart
        for end, (token, size) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - size
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    pair = before << 32 | token
                    apart = known(pair)
                    if apart is None:
                        apart = test(pair)
                    if not apart:
                        continue
                last[end], starts[end] = token, start
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at = starts[at]
        ids.reverse()
        return packed(ids)


class WordEndBpe(Cache):
    """What stands between two spaces or line ends -> id bytes."""

    budget = 24 << 20
    #: Letters that are one class to the pre-tokenizer, in a form that normalizing keeps, and a run of marks.
    _plain = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self._normalize, self._pieces = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        added = {x["content"]: x["id"] for x in stated["added_tokens"]}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in stated["added_tokens"]):
            raise ValueError("only added tokens that stand for themselves are known")
        if stated["decoder"] is not None:
            raise ValueError("only vocabularies without a decoder are known")
        self._added = {text: packed([i]) for text, i in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(map(re.escape, longest_first)) or '(?!)'})").split
        symbols = byte_symbols()
        self._symbols = "".join(symbols[b] for b in range(256))
        self.words = PrefixTable(stated["model"])
        self._names = [tokenizer.id_to_token(i).encode() for i in range(tokenizer.get_vocab_size())]

    def _make(self, unit: str) -> bytes:
        words, parts = self.words, self._cut(unit)
        if len(parts) == 1 and (found := self._plain(unit)):
            word, tail = found.groups()
            out = words[charmap_decode(word.lower().encode(), "strict", self._symbols)[0]] if word else b""
            return out + words[tail] if tail else out
        ids = (self._added.get(x) or b"".join(words[p] for p, _ in self._pieces(self._normalize(x))) for x in parts if x)
        return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as ``Tokenizer.encode`` without added special tokens gives them."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8, as ``Tokenizer.decode`` with special tokens gives it."""
        return b" ".join(map(self._names.__getitem__, memoryview(ids).cast("I")))


def encode_decode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and what they decode to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = loaded(WordEndBpe, vocabulary)
        ids = [units.encode(t.as_py()) for t in batch.column(1)]
        decoded = pa.array([units.decode(x).decode() for x in ids], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), id_lists(ids), decoded], ["doc_id", "ids", "decoded"])

    return _by_text(df, text, key, run, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` gives; one text's ids at a time."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = loaded(WordEndBpe, vocabulary)
        n, ids_sha, decoded_sha = [], [], []
        for value in batch.column(1):
            ids = units.encode(value.as_py())
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            decoded_sha.append(hashlib.sha256(units.decode(ids)).hexdigest())
        columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _by_text(df, text, key, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _by_text(df: DataFrame, text: str, key: str, run, schema: str) -> DataFrame:
    return arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")), run, schema)


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
