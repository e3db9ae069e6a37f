"""Exact encoding of whole texts by their units, with a bounded cache per worker process.

A unit is a separator (one space or newline) with what follows up to the next one. The tokenizers here
never join characters across the left edge of a unit, save in runs of white space, so a text's ids are
the ids of its units in order. Texts where that doesn't hold (runs of separators, other white space,
special tokens, NUL) take the slower whole-text path. A unit's ids are kept as little-endian unsigned
32-bit bytes.

A cache has a budget of bytes. Words that come often come early, so a full cache stays as it is; after RENEW
misses for each entry the input is another one, and the cache starts anew. A worker process serves the
stages of many operators; it keeps the cache of one at a time (``loaded``).
"""

from __future__ import annotations

import codecs
import re
import sys
from array import array

#: Bytes of one cache; an encoder has two, of units and of the pieces that they are made of.
CACHE_BYTES = 64 << 20
#: What an entry takes besides its characters and ids: two objects and two slots of a table.
ENTRY_BYTES = 150
#: Misses of a full cache for each entry until it starts anew.
RENEW = 16
#: Longer keys are not kept.
MAX_KEPT = 64


class WholeText(Exception):
    """The text can't be encoded by units."""


def packed(ids: list[int]) -> bytes:
    if len(ids) == 1:
        return ids[0].to_bytes(4, "little")
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class Cache(dict):
    """key -> value of ``_make(key)``, within a budget of bytes."""

    budget = CACHE_BYTES

    def __init__(self) -> None:
        self._left = self.budget
        self._missed = 0

    def __missing__(self, key):
        got = self._make(key)
        if self._left > 0:
            if len(key) <= MAX_KEPT:
                self._left -= ENTRY_BYTES + len(key) + (len(got) if isinstance(got, bytes) else 0)
                self[key] = got
        else:
            self._missed += 1
            if self._missed > RENEW * len(self):
                self.clear()
                self._left, self._missed = self.budget, 0
        return got

    def _make(self, key):
        raise NotImplementedError


class _Pieces(Cache):
    """A pre-token -> id bytes."""

    def __init__(self, model, budget: int) -> None:
        self.budget = budget
        super().__init__()
        self._tokenize = model.tokenize
        symbols = byte_symbols()
        self._charmap = "".join(symbols[b] for b in range(256))
        self._space = symbols[0x20]

    def _make(self, piece: str) -> bytes:
        # letters and digits of ASCII stand for themselves, a space before them for one symbol
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalnum():
            symbols = word if word is piece else self._space + word
        else:
            symbols = codecs.charmap_decode(piece.encode(), "strict", self._charmap)[0]
        return packed([t.id for t in self._tokenize(symbols)])


class _HfUnits(Cache):
    """unit -> id bytes."""

    piece_budget = CACHE_BYTES
    #: A separator, letters that all classes of the tokenizers call letters, and a run of marks.
    _plain = re.compile(r"([ \n]?)([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]*)([!-&(-/:-@\[-`{-~]*)").fullmatch

    def __init__(self, path: str, share: int = 1) -> None:
        """The caches take a ``share``-th of their budgets."""
        from tokenizers import Tokenizer

        self.budget //= share
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(map(self._plain, self.special)):
            raise ValueError("a special token is letters and marks")
        self.pieces = _Pieces(self.tokenizer.model, self.piece_budget // share)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


class ByteLevelUnits(_HfUnits):
    """For byte-level vocabularies whose pre-tokens may begin with one space."""

    budget, piece_budget = CACHE_BYTES * 3 // 2, CACHE_BYTES // 2
    _odd = re.compile(r"[^\S \n]").search

    def _make(self, unit: str) -> bytes:
        found = self._plain(unit)
        if found is None:
            if self._odd(unit):
                raise WholeText
            return self.whole(unit)
        sep, word, tail = found[1], found[2], found[3]
        pieces = self.pieces
        if not word and not tail:
            if sep:
                raise WholeText
            return b""
        if sep == "\n":
            start = pieces[sep]
            if not tail:
                return start + pieces[word]
            return start + pieces[word] + pieces[tail] if word else start + pieces[tail]
        if not word:
            return pieces[sep + tail]
        if not tail:
            return pieces._make(unit)  # kept as a unit
        out = self.get(sep + word)
        return (pieces[sep + word] if out is None else out) + pieces[tail]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as ``Tokenizer.encode`` without added special tokens gives them."""
        if "\0" not in text and not any(x in text for x in self.special):
            try:
                return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")))
            except WholeText:
                pass
        return self.whole(text)


class LowerWordUnits(_HfUnits):
    """For lower-casing vocabularies that drop white space: units are what stands between separators."""

    budget, piece_budget = CACHE_BYTES * 3 // 4, CACHE_BYTES // 4

    def _make(self, unit: str) -> bytes:
        found = self._plain(unit)
        # no special token is letters and then marks, as _plain has them
        if found is None:
            return self.whole(unit)
        word, tail = found[2], found[3]
        if not tail:
            return self.pieces[word.lower()] if word else b""
        return self.pieces[word.lower()] + self.pieces[tail] if word else self.pieces[tail]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[tuple, Cache] = {}


def loaded(kind: type, *args: str):
    """The worker process's own cache of a kind; that of another kind goes when it comes."""
    key = (kind, *args)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(*args)
    return _loaded[key]
