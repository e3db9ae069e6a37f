"""SentencePiece encoding and decoding by a table of each prefix's last token.

In merge-type (BPE) segmentation every prefix of a text has one last token: the one piece that ends
there, is the segmentation of itself, and is compatible with the last token of what stands before it,
which means that the two segment as just that pair. An automaton finds the pieces ending at each place,
compatibility is looked up in a table of pairs, and the ids are read backwards from the end.

No piece holds a space mark after another character, and none a newline, so texts are segmented by
units (a space or newline with what follows), which a bounded cache keeps. Text that the units don't
cover (runs of spaces, a literal space mark, NUL) is cut at the same places by a slower path.

Defined results: a null or empty text has no ids and decodes to an empty one; repeated rows and rows of a null
doc_id stay, each with its own; texts of any length are encoded whole; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import arrow_map, documents, whole_text
from sigtok.llm.tokenfile import id_lists
from sigtok.llm.wordcache import Cache, WholeText, loaded, packed

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
MAX_PAIRS = 1_000_000


class _Pairs(dict):
    """(left, right) -> whether the two segment as just that pair."""

    def __init__(self, merged) -> None:
        self._merged = merged

    def __missing__(self, pair: tuple[str, str]) -> bool:
        known = self._merged(pair[0] + pair[1]) == [*pair]
        if len(self) < MAX_PAIRS:
            self[pair] = known
        return known


class PieceUnits(Cache):
    """unit -> id bytes."""

    _cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        whole = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        self.ids = {p.id_to_piece(i): i for i in whole}
        self.scores = {piece: p.get_score(i) for piece, i in self.ids.items()}
        if any(("\n" in x and x != "\n") or (MARK in x.lstrip(MARK)) for x in self.ids):
            raise ValueError("the model has pieces that cross units")
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.pairs = _Pairs(self.merged)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The segmentation by its definition: the best-scored adjacent pair merges, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def segment(self, text: str) -> list[str]:
        """Tokens of one unit, by the prefix table."""
        last: list[str | None] = [None] * (len(text) + 1)
        pairs, filled = self.pairs, 0
        for end, (piece, size) in self.automaton.iter(text):
            # a character that is no piece, and so ends no match, stands for itself
            while filled < end:
                filled += 1
                last[filled] = last[filled] or text[filled - 1]
            if last[end + 1] is None and (size > end or pairs[last[end + 1 - size], piece]):
                last[end + 1] = piece
        while filled < len(text):
            filled += 1
            last[filled] = last[filled] or text[filled - 1]
        tokens, i = [], len(text)
        while i:
            tokens.append(last[i])
            i -= len(last[i])
        return tokens[::-1]

    def token_ids(self, text: str) -> list[int]:
        out: list[int] = []
        for token in self.segment(text):
            known = self.ids.get(token)
            out.extend([known] if known is not None else [self.byte_ids[b] for b in token.encode()])
        return out

    def _make(self, unit: str) -> bytes:
        if MARK in unit or unit in (" ", "\n") or not unit:
            raise WholeText
        if unit[0] == "\n":
            return packed([self.byte_ids[10] if "\n" not in self.ids else self.ids["\n"], *self.token_ids(unit[1:])])
        return packed(self.token_ids(unit.replace(" ", MARK)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the library's ``encode`` gives them."""
        if not text:
            return b""
        if "\0" not in text:
            try:
                return b"".join(map(self.__getitem__, f" {text}".replace(" ", "\0 ").replace("\n", "\0\n")[1:].split("\0")))
            except WholeText:
                pass
        marked = MARK + text.replace(" ", MARK)
        return b"".join(packed(self.token_ids(part)) for part in self._cut.findall(marked))


def encode_decode(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and what the library makes of them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = loaded(PieceUnits, model)
        ids = [units.encode(t.as_py()) for t in batch.column(1)]
        decoded = units.processor.decode([np.frombuffer(x, "<u4").tolist() for x in ids], num_threads=1)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), id_lists(ids), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
        )

    return _by_text(df, text, key, run, "doc_id long, ids array<int>, decoded string")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode_decode`` gives."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = loaded(PieceUnits, model)
        n, ids_sha, decoded_sha = [], [], []
        for at in range(0, batch.num_rows, 500):
            ids = [memoryview(units.encode(t.as_py())).cast("I").tolist() for t in batch.column(1).slice(at, 500)]
            n += map(len, ids)
            ids_sha += [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]
            decoded = units.processor.decode(ids, num_threads=1)
            decoded_sha += [hashlib.sha256(x.encode()).hexdigest() for x in decoded]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _by_text(df, text, key, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _by_text(df: DataFrame, text: str, key: str, run, schema: str) -> DataFrame:
    return arrow_map(df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")), run, schema)


def op8_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
