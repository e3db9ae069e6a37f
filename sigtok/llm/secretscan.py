"""Secret scans: a keyword automaton, expressions anchored at its hits, then embedded checksums.

An Aho-Corasick automaton over all rules' keywords runs once over the lower-cased text. Only where it
hits is a rule's expression matched, anchored there; the hexadecimal kind has no keyword and is found
by its own run of characters. Tokens that embed a checksum (base-62 CRC-32 of the random part, a JSON
header in base64) must pass it, which drops look-alikes.

Matches of a kind are leftmost and don't overlap: what a match covers is consumed even if the match is
then dropped for its length or checksum.

A private key without its END line is covered as far as lines of base64 follow.

Defined results: a null text is an empty one without spans; equal texts give equal spans; repeated
rows and rows of a null doc_id stay, each with its own; texts of any length are scanned whole, in linear time; other
columns are ignored; an empty table gives an empty one. Spans count code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import arrow_map, documents, whole_text

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PLACEHOLDER = "[secret]"


def base62(number: int, width: int) -> str:
    out = ""
    for _ in range(width):
        number, digit = divmod(number, 62)
        out = DIGITS[digit] + out
    return out


def checksummed(found: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of those after the prefix."""
    body = found[0].split("_")[-1]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def json_header(found: re.Match) -> bool:
    head = found[0].split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):  # any text may stand there, nested as deep as it likes
        return False


@dataclass(frozen=True)
class Rule:
    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool]
    #: Where the expression fails, it fails at all further places of this run, so none of them is tried.
    run: re.Pattern | None = None


#: In the order in which spans of one start are listed; the first two and "hex" are the base.
RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
        ),
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
        checksummed,
    ),
    Rule(
        "github_pat",
        ("github_pat_",),
        re.compile(r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?![A-Za-z0-9])"),
        lambda m: True,
    ),
    Rule("npm", ("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), checksummed),
    Rule("slack", ("xox",), re.compile(r"xox[abprs]-[0-9A-Za-z-]{10,}"), lambda m: True),
    Rule("google", ("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda m: True),
    Rule(
        "jwt",
        ("eyj",),
        re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
        json_header,
        re.compile(r"[A-Za-z0-9_-]+"),
    ),
    Rule(
        "pem",
        ("-----begin",),
        # up to the next five hyphens, so that header lines with hyphens are inside; without an end, what looks like a key
        re.compile(
            r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
            r"(?:(?:[^-]+|-(?!----))*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|(?:\s+[A-Za-z0-9+/=]{20,})*+)"
        ),
        lambda m: True,
    ),
)
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
ORDER = {kind: n for n, kind in enumerate((*BASE, *(r.kind for r in RULES if r.kind not in BASE)))}
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Scanner:
    """The automaton of all keywords; one for each worker process."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for n, rule in enumerate(RULES):
            for word in rule.keywords:
                self.automaton.add_word(word, (n, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        lowered = text.lower()
        if len(lowered) != len(text):  # some capitals have longer small forms
            lowered = text.translate(_lower)
        starts: dict[int, list[int]] = {}
        for end, (n, size) in self.automaton.iter(lowered):
            starts.setdefault(n, []).append(end - size + 1)
        found: list[tuple[int, int, str, int]] = []
        for n, places in starts.items():
            rule, free = RULES[n], 0
            for start in sorted(places):
                if start < free:
                    continue
                if m := rule.pattern.match(text, start):
                    free = m.end()
                    if rule.valid(m):
                        found.append((start, ORDER[rule.kind], rule.kind, free))
                elif rule.run and (m := rule.run.match(text, start)):
                    free = m.end()
        # a run of hexadecimal characters is as long as it can be
        found += [(m.start(), ORDER["hex"], "hex", m.end()) for m in HEX.finditer(text)]
        return [(kind, start, end) for start, _, kind, end in sorted(found)]


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, spans): the spans of each whole text, an array of (kind, start, end)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = scanner().spans
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in batch.column(1)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    body = df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return arrow_map(body, run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch that spans cover replaced by PLACEHOLDER."""
    out, at = [], 0
    covered: list[list[int]] = []
    for _, start, end in spans:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for start, end in covered:
        out += [text[at:start], PLACEHOLDER]
        at = end
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets in its text column replaced; null texts stay null."""
    names = df.columns
    at = names.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = scanner().spans
        texts = batch.column(at).to_pylist()
        texts = [t if t is None or not (s := find(t)) else redacted(t, s) for t in texts]
        columns = [pa.array(texts, pa.string()) if n == at else c for n, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(df, run, df.schema)


def op5_keyword_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")

    def text_of(array: Column) -> Column:
        return F.array_join(
            F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return scan(documents(spark, sf_dir)).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"),
        text_of(spans).alias("spans"),
    )
