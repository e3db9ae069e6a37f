"""License scans: sparse TF-IDF cosine to templates, then inheritance down the directory tree.

Units of a text are its lines, its blocks of comment lines and the whole text. Terms are one to three words on end,
so that a number or a word which makes another licence counts in several terms. Templates are statements, whose
vectors and units live in the templates' vocabulary, so that a statement may stand in a longer line; and titles and
tags of a few words, against which all words of a unit count, so that a mention in a sentence is none. Document
frequencies of the known words are counted over all whole texts; a term counts as its rarest word. A unit is scored
only if it has an anchor: the other words are those whose terms together can't bring any template to the
threshold, so units without anchors are passed over without loss.

A whole text is also scored against the licence bodies in ``bodies``, with all its terms in the norm; one
that stands in no body counts as unseen. A text that is a body has that license, whatever its lines say.
There are no bodies of the Creative Commons licenses but CC0, of AGPL and of ISC: such files are named by their
lines. The line that all BSD licenses begin with names BSD-3-Clause where it stands alone.

A document with no license of its own takes that of the nearest directory above it that holds a
licence file. Directories are resolved, not documents: each distinct directory is joined with its
ancestors, the deepest licensed one is kept, and documents look up their own directory.

Defined results: null and empty texts have no license of their own; of equal scores the template listed
first wins, of licence files in one directory the one with the smallest doc_id; documents of no path
inherit nothing; texts of any length are scored whole; repeated rows get equal results, also of one path and
doc_id; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files as resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import arrow_map, batch_map, documents, whole_text, write_shared

_FREE = "you can redistribute it and/or modify it under the terms of the GNU"
_CHOICE = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_CC_VERSIONS = ("3.0", "4.0")

# The Creative Commons licenses' parts and their names.
_CC = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
# Usual wordings of license statements, by SPDX name.
STATEMENTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    *((f"GPL-{v}.0", f"This work is licensed under the GNU General Public License, version {v}.") for v in "32"),
    *((f"GPL-{v}.0", f"This program is free software; {_FREE} General Public License {_CHOICE.format(v)}") for v in "32"),
    ("GPL-3.0", f"This program is free software: {_FREE} General Public License"),
    *((f"LGPL-{v}", f"Licensed under the GNU Lesser General Public License, version {v.removesuffix('.0')}.") for v in ("3.0", "2.1")),
    *((f"LGPL-{v}", f"This library is free software; {_FREE} Lesser General Public License {_CHOICE.format(v.removesuffix('.0'))}") for v in ("3.0", "2.1")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", f"This program is free software: {_FREE} Affero General Public License {_CHOICE.format(3)}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    *((f"CC-{c}-{v}", f"Licensed under CC {c} {v}.") for c, _ in _CC for v in _CC_VERSIONS),
    *((f"CC-{c}-{v}", f"Licensed under the Creative Commons {n} {v} International License, CC {c} {v}.") for c, n in _CC for v in _CC_VERSIONS),
    *((f"CC-{c}-{v}", f"Licensed under the Creative Commons {n} {v} License.") for c, n in _CC for v in _CC_VERSIONS),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("LicenseRef-All-Rights-Reserved", "All rights reserved."),
)
#: Titles of licence texts, and tags.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    *((f"GPL-{v}.0", f"GNU General Public License, version {v}") for v in "32"),
    *((f"LGPL-{v}", f"GNU Lesser General Public License, version {v.removesuffix('.0')}") for v in ("3.0", "2.1")),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    *((f"MPL-{v}", f"Mozilla Public License Version {v}") for v in ("2.0", "1.1")),
    *((f"BSD-{n}-Clause", f"BSD {n}-Clause License") for n in "23"),
    *((f"CC-{c}-{v}", f"Creative Commons {n} {v}") for c, n in _CC for v in _CC_VERSIONS),
    *((f"CC-{c}-{v}", f"CC {c} {v}") for c, _ in _CC for v in _CC_VERSIONS),
    *((x, f"SPDX-License-Identifier: {x}{more}")
      for x, mores in (("MIT", ("",)), ("ISC", ("",)), ("Apache-2.0", ("",)), ("MPL-2.0", ("",)), ("MPL-1.1", ("",)), ("CC0-1.0", ("",)),
                       ("BSD-2-Clause", ("",)), ("BSD-3-Clause", ("",)),
                       *((g, ("", "-only", "-or-later")) for g in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")),
                       *((f"CC-{c}-{v}", ("",)) for c, _ in _CC for v in _CC_VERSIONS))
      for more in mores),
)
THRESHOLD = 0.8
#: The most words of a term.
WORDS = 3
#: What comment lines begin with.
COMMENT = re.compile(rb"[ \t]*(?:#|//|/?\*|--|;|%|<!--|\.\.|rem\b)", re.I)
LICENSE_FILE = re.compile(r"(?i)(licen[sc]e|copying|notice|unlicense)([.-].*)?$")
_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 or b == 10 else 32 for b in range(256)
)

Vector = dict[bytes, float]


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z as a-z."""
    return text.translate(_SPACED).split()


def grams(words: list[bytes]) -> Iterator[bytes]:
    """The words, and what two and three of them on end make."""
    yield from words
    for n in range(2, WORDS + 1):
        for k in range(len(words) - n + 1):
            yield b" ".join(words[k : k + n])


_TEMPLATE_TERMS = [(name, Counter(grams(terms(text.encode())))) for name, text in (*STATEMENTS, *TITLES)]
VOCABULARY = sorted({t for _, counts in _TEMPLATE_TERMS for t in counts})
WORD_VOCABULARY = [t for t in VOCABULARY if b" " not in t]
_BODY_TERMS = sorted(
    (f.name.removesuffix(".txt"), Counter(terms(f.read_bytes())))
    for f in (resources("sigtok.llm") / "bodies").iterdir()
    if f.name.endswith(".txt")
)
BODY_VOCABULARY = sorted({t for _, counts in _BODY_TERMS for t in counts})


def term_documents(df: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many texts each term of the vocabularies stands, and the number of texts."""
    vocabulary = {*WORD_VOCABULARY, *BODY_VOCABULARY}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            n += batch.num_rows
            for value in batch.column(0):
                found.update(vocabulary.intersection(terms(value.as_py())))
        found[b""] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array([t.decode() for t in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"]
        )

    counted = batch_map(df.select(whole_text(text).cast("binary").alias("text")), run, "term string, n long")
    # at most as many rows as the vocabulary has
    counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts, counts.pop("", 0)


class Matcher:
    """Scores units of text against the templates."""

    def __init__(self, counts: dict[str, int], n: int, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.unseen = math.log(1 + n) + 1
        words = {t: math.log((1 + n) / (1 + counts.get(t.decode(), 0))) + 1 for t in WORD_VOCABULARY}
        self.idf = {t: max(words[w] for w in t.split(b" ")) for t in VOCABULARY}
        self.templates = [(name, self._unit(self._weights(c))) for name, c in _TEMPLATE_TERMS]
        self.anchors = self._anchors(words, self.templates)
        #: term -> (template's place, weight)
        self.index: dict[bytes, list[tuple[int, float]]] = {}
        for k, (_, template) in enumerate(self.templates):
            for t, w in template.items():
                self.index.setdefault(t, []).append((k, w))
        self.body_idf = {t: math.log((1 + n) / (1 + counts.get(t.decode(), 0))) + 1 for t in BODY_VOCABULARY}
        self.bodies = [(name, self._whole(c)) for name, c in _BODY_TERMS]
        self.body_anchors = self._anchors(self.body_idf, self.bodies)

    def _anchors(self, idf: Vector, vectors: list[tuple[str, Vector]]) -> set[bytes]:
        """All words but the commonest, as long as the terms of those can't reach the threshold by themselves."""
        of_word: dict[bytes, list[tuple[int, list[bytes], float]]] = {}
        for k, (_, v) in enumerate(vectors):
            for t, w in v.items():
                parts = t.split(b" ")
                for x in set(parts):
                    of_word.setdefault(x, []).append((k, parts, w))
        common: set[bytes] = set()
        reached = [0.0] * len(vectors)
        for word in sorted(idf, key=lambda t: (idf[t], t)):
            common.add(word)
            for k, parts, w in of_word.get(word, ()):
                if common.issuperset(parts):  # a term comes in with the last of its words
                    reached[k] += w * w
            if math.sqrt(max(reached)) >= self.threshold - 1e-6:
                common.discard(word)
                break
        return set(idf) - common

    def _whole(self, counts: Counter) -> Vector:
        """The vector of a whole text; terms of no body are in the norm alone."""
        weights = {t: (1 + math.log(k)) * self.body_idf.get(t, self.unseen) for t, k in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items() if t in self.body_idf}

    def best_body(self, words: list[bytes]) -> tuple[str, float, int] | None:
        """(license, similarity, -1) of the licence body that a whole text is."""
        if self.body_anchors.isdisjoint(words):
            return None
        counts = Counter(words)
        # no text comes nearer to a body than the part of the body that it has
        near = [
            (name, body)
            for name, body in self.bodies
            if sum(body[t] ** 2 for t in body.keys() & counts.keys()) >= (self.threshold - 1e-6) ** 2
        ]
        if not near:
            return None
        vector, found = self._whole(counts), None
        for name, body in near:
            score = round(sum(vector[t] * body[t] for t in sorted(vector.keys() & body.keys())), 6)
            if score >= self.threshold and (found is None or score > found[1]):
                found = (name, score, -1)
        return found

    def _weights(self, counts: Counter) -> Vector:
        return {t: (1 + math.log(k)) * self.idf[t] for t, k in counts.items() if t in self.idf}

    @staticmethod
    def _unit(weights: Vector) -> Vector:
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    def best(self, text: bytes) -> tuple[str, float, int] | None:
        """(license, similarity, line) of a text's body or else best unit; line -1 is the text as a whole."""
        spaced = text.translate(_SPACED)
        words = spaced.split()
        if (found := self.best_body(words)) is not None:
            return found
        if self.anchors.isdisjoint(words):
            return None
        # (score, -place of the template, line); of equal scores the template listed first wins, then the first unit
        best = (-1.0, 0, 0)
        for line, unit in self._units(text, spaced, words):
            if not self.anchors.isdisjoint(unit):
                score, k = self._scored(unit)
                if (score, -k) > best[:2]:
                    best = (score, -k, line)
        score, k, line = best
        return (self.templates[-k][0], score, line) if score >= self.threshold else None

    @staticmethod
    def _units(text: bytes, spaced: bytes, words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(line, words) of each line, each block of comment lines, and the whole text."""
        lines = spaced.split(b"\n")
        for n, line in enumerate(lines):
            yield n, line.split()
        if len(lines) > 1:
            for a, b in comment_blocks(text):
                yield a, b" ".join(lines[a:b]).split()
            yield -1, words

    def _known(self, words: list[bytes]) -> Iterator[bytes]:
        """The terms of templates in a unit; where a term of three words is one, so are its first two."""
        idf = self.idf
        for k, word in enumerate(words):
            if word in idf:
                yield word
                if k + 1 < len(words) and (two := word + b" " + words[k + 1]) in idf:
                    yield two
                    if k + 2 < len(words) and (three := two + b" " + words[k + 2]) in idf:
                        yield three

    def _scored(self, words: list[bytes]) -> tuple[float, int]:
        """The best similarity of a unit to a template, and that template's place."""
        weights = self._weights(Counter(self._known(words)))
        scores: dict[int, float] = {}
        for t in sorted(weights):
            for k, w in self.index[t]:
                scores[k] = scores.get(k, 0.0) + weights[t] * w
        known = sum(weights[t] ** 2 for t in sorted(weights))
        norm = every = math.sqrt(known)
        # titles and tags are held against all words, which can only lower what they have
        if any(k >= len(STATEMENTS) and v >= (self.threshold - 1e-6) * norm for k, v in scores.items()):
            others = Counter(w for w in words if w not in self.idf)
            every = math.sqrt(known + sum(((1 + math.log(n)) * self.unseen) ** 2 for n in others.values()))
            found = ((round(v / (norm if k < len(STATEMENTS) else every), 6), -k) for k, v in scores.items())
        else:
            found = ((round(v / norm, 6), -k) for k, v in scores.items() if k < len(STATEMENTS))
        score, k = max(found, default=(-1.0, 0))
        return score, -k


def comment_blocks(text: bytes) -> list[tuple[int, int]]:
    """(first, end) of the runs of two and more lines that begin as comments do."""
    out, first = [], None
    for n, line in enumerate([*text.split(b"\n"), b""]):
        if COMMENT.match(line):
            first = n if first is None else first
        else:
            if first is not None and n - first > 1:
                out.append((first, n))
            first = None
    return out


def detect(df: DataFrame, text: str = "text", key: str = "doc_id", path: str = "path") -> DataFrame:
    """(doc_id, path, license, similarity, line) of each row of ``df``, null without a license."""
    matcher = Matcher(*term_documents(df, text))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [matcher.best(t.as_py()) or (None, None, None) for t in batch.column(2)]
        names, scores, lines = zip(*rows, strict=True)
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lines, pa.int32())]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "path", "license", "similarity", "line"])

    body = df.select(F.col(key).cast("long").alias("doc_id"), F.col(path).alias("path"), whole_text(text).cast("binary").alias("t"))
    return arrow_map(body, run, "doc_id long, path string, license string, similarity double, line int")


def directory(path: Column) -> Column:
    """The directory of a path, without a slash at its end; '' at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """``found`` with from_dir and the license in effect: its own, else the nearest directory's."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    placed = found.withColumn("dir", directory(F.col("path")))
    files = placed.where(name.rlike(LICENSE_FILE.pattern) & F.col("license").isNotNull())
    licensed = files.groupBy("dir").agg(F.min(F.struct("doc_id", "license")).alias("file"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("file.license").alias("dir_license"))
    dirs = placed.select("dir").where(F.col("dir").isNotNull()).distinct()
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(ups)).alias("up"))
        .select("dir", "up.*")
        .join(licensed, "above")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "above", "dir_license")).alias("up"))
        .select("dir", F.col("up.above").alias("from_dir"), F.col("up.dir_license").alias("dir_license"))
    )
    own = F.col("license").isNotNull()
    return placed.join(nearest, "dir", "left").select(
        *found.columns,
        F.when(~own, F.col("from_dir")).alias("from_dir"),
        F.coalesce("license", "dir_license").alias("effective_license"),
    )


def document_paths(df: DataFrame) -> DataFrame:
    """``df`` with a path: documents have none, so 50 to a directory, the first as its licence file."""
    folder = F.concat_ws("/", "source", F.expr("doc_id div 2500").cast("string"), F.expr("doc_id div 50").cast("string"))
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return df.withColumn("path", F.concat_ws("/", folder, name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inherit(write_shared(detect(document_paths(documents(spark, sf_dir))), "licenses"))
