"""Media columns: baseline JPEG files, their DC-only luminance thumbnails and thumbnail hashes.

The decoder parses markers, takes the Huffman codes of a scan apart and rebuilds one luminance sample
per 8x8 block from the DC coefficients, in numpy. Restart intervals are independent of each other, so
all intervals of a batch of files are decoded in lockstep, one code of each per step. It reads any
baseline file: several components, subsampling, AC coefficients, stuffed bytes, files in sequence.

The encoder stores bytes without loss: a block's DC coefficient is its byte, with a quantiser of 8, so
that the DC-only thumbnail holds exactly the bytes. Rows of 64 blocks are restart intervals. DC size
categories get codes of 12 - category bits (with the value's own bits always 12) and the end of a block
4 bits, so each block takes two bytes. A payload of over MAX_ROWS rows goes on in further files in the
same column, and a comment segment has the payload's true length.

Defined results: a null text is an empty one with one row of zero bytes; equal texts give equal values;
repeated rows and rows of a null doc_id stay, each with its own; a text of any length is stored whole; other
columns are ignored; an empty table gives an empty one. Broken media raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigtok.llm.common import batch_map, documents, whole_text, write_shared

ROW = 64
MAX_ROWS = 8191
#: Bytes of media that are decoded together.
BATCH_BYTES = 2 << 20


def _dc_codes() -> tuple[np.ndarray, bytes]:
    """The two bytes of a block by DC difference + 255, and the DC table's segment."""
    codes, code, length = {}, 0, 4
    for category in range(8, -1, -1):
        codes[category] = code
        code = (code + 1) << 1
        length += 1
    words = np.zeros(511, dtype=">u2")
    for diff in range(-255, 256):
        category = abs(diff).bit_length()
        value = diff if diff >= 0 else diff + (1 << category) - 1
        words[diff + 255] = ((codes[category] << category) | value) << 4
    counts = [0] * 3 + [1] * 9 + [0] * 4
    return words, bytes([0x00, *counts, *range(8, -1, -1)])


BLOCKS, DC_TABLE = _dc_codes()
AC_TABLE = bytes([0x10, 0, 0, 0, 1, *[0] * 12, 0x00])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW) if data else bytes(ROW)


def encode(data: bytes) -> bytes:
    """One or more baseline JPEG files whose thumbnails, in order, are ``padded(data)``."""
    rows = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, ROW).astype(np.int16)
    files = []
    for at in range(0, len(rows), MAX_ROWS):
        part = rows[at : at + MAX_ROWS]
        diff = np.diff(part, axis=1, prepend=np.int16(128))
        scan = np.empty((len(part), 2 * ROW + 2), dtype=np.uint8)
        scan[:, : 2 * ROW] = BLOCKS[diff + 255].view(np.uint8)
        scan[:, -2] = 0xFF
        scan[:, -1] = 0xD0 + np.arange(len(part)) % 8
        files.append(
            b"\xff\xd8"
            + (_segment(0xFE, b"bytes=%d" % len(data)) if not at else b"")
            + _segment(0xDB, bytes([0, *[8] * 64]))
            + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * len(part), 8 * ROW, 1, 1, 0x11, 0))
            + _segment(0xC4, DC_TABLE + AC_TABLE)
            + _segment(0xDD, struct.pack(">H", ROW))
            + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
            + scan.tobytes()[:-2]
            + b"\xff\xd9"
        )
    return b"".join(files)


@dataclass
class Picture:
    """One parsed file: what the scan decoder needs, and its thumbnail when decoded."""

    width: int = 0
    height: int = 0
    #: (component id, horizontal, vertical sampling, quantiser table)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)
    quantisers: dict[int, int] = field(default_factory=dict)
    huffman: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    comment: bytes = b""
    #: (component index, DC table, AC table) of each component in the scan
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    segments: list[bytes] = field(default_factory=list)
    thumbnail: np.ndarray | None = None

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.components) == 1:
            h = v = 1
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes) -> list[Picture]:
    """The files that ``data`` holds one after another."""
    pictures, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError(f"no start of image at byte {at}")
        picture, at = _parse_one(data, at + 2)
        pictures.append(picture)
    return pictures


def _parse_one(data: bytes, at: int) -> tuple[Picture, int]:
    p = Picture()
    while True:
        if at + 4 > len(data) and data[at : at + 2] != b"\xff\xd9" or data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xD9:
            if not p.segments:
                raise ValueError("no scan")
            return p, at + 2
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if at > len(data):
            raise ValueError("a segment ends early")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                p.quantisers[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                p.huffman[body[0] >> 4, body[0] & 15] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            precision, p.height, p.width, n = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("only 8-bit samples are read")
            p.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline files are read")
        elif marker == 0xDD:
            p.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            p.comment = p.comment or body
        elif marker == 0xDA:
            ids = [c[0] for c in p.components]
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if len(chosen) != len(ids):
                raise ValueError("only interleaved scans are read")
            p.scan = [(ids.index(c), t >> 4, t & 15) for c, t in chosen]
            at = _cut_scan(p, data, at)


def _cut_scan(p: Picture, data: bytes, at: int) -> int:
    """Adds the restart intervals from ``at`` on; gives the place of the marker that ends them."""
    start = at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            raise ValueError("a scan ends early")
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            p.segments.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            start = at = at + 2
        else:
            p.segments.append(data[start:at].replace(b"\xff\x00", b"\xff"))
            return at


_tables: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """(code length << 8 | symbol) by the next 16 bits; 0 where no code matches."""
    known = _tables.get(table)
    if known is None:
        known = np.zeros(1 << 16, dtype=np.int64)
        code, k = 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                known[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_tables) < 256:
            _tables[table] = known
    return known


def decode(pictures: list[Picture]) -> None:
    """Sets the thumbnails: one luminance sample per block, from DC coefficients alone."""
    tables: dict[bytes, int] = {}
    lanes: list[tuple[int, ...]] = []
    layouts: dict[tuple, int] = {}
    layout_rows: list[list[tuple[int, int, int, int, int]]] = []
    blobs: list[bytes] = []
    size = out_size = 0
    outs = []
    for p in pictures:
        if not p.components or not p.scan:
            raise ValueError("no frame or scan")
        mx, my = p.mcus
        blocks = []
        for index, dc, ac in p.scan:
            _, h, v, _ = p.components[index]
            h, v = (1, 1) if len(p.scan) == 1 else (h, v)
            try:
                t = [tables.setdefault(p.huffman[kind, n], len(tables)) for kind, n in ((0, dc), (1, ac))]
            except KeyError:
                raise ValueError("a Huffman table is missing") from None
            blocks += [(index, t[0], t[1], x, y) for y in range(v) for x in range(h)]
        layout = layouts.setdefault(tuple(blocks), len(layouts))
        if layout == len(layout_rows):
            layout_rows.append(blocks)
        _, h, v, q = p.components[0]
        h, v = (1, 1) if len(p.scan) == 1 else (h, v)
        step = p.restart or mx * my
        if len(p.segments) != -(-mx * my // step):
            raise ValueError("restart intervals are missing")
        outs.append((out_size, mx * h, my * v, p.quantisers[q]))
        for n, s in enumerate(p.segments):
            first = n * step
            lanes.append((size * 8, (size + len(s)) * 8, layout, first, min(step, mx * my - first), mx, h, v, out_size))
            blobs.append(s)
            size += len(s)
        out_size += mx * h * my * v
    flat = np.frombuffer(b"".join(blobs) + bytes(8), dtype=np.uint8)
    # 32 bits from each byte on
    window = flat[:-3].astype(np.int64)
    for k in (1, 2, 3):
        window = (window << 8) | flat[k : len(flat) - 3 + k]
    lookup = np.stack([_lookup(t) for t in tables]).ravel()
    deepest = max(map(len, layout_rows))
    plan = np.zeros((len(layout_rows), deepest, 5), dtype=np.int64)
    for n, row in enumerate(layout_rows):
        plan[n, : len(row)] = row
    counts = np.array([len(r) for r in layout_rows])
    pos, end, layout, mcu, left, mx, h, v, base = np.array(lanes, dtype=np.int64).T.copy()
    out = np.zeros(out_size, dtype=np.int64)
    predicted = np.zeros((len(lanes), 4), dtype=np.int64)
    block = np.zeros(len(lanes), dtype=np.int64)
    k = np.zeros(len(lanes), dtype=np.int64)
    live = np.arange(len(lanes))

    def peek(at: np.ndarray) -> np.ndarray:
        return (window[at >> 3] >> (16 - (at & 7))) & 0xFFFF

    def code(rows: np.ndarray, column: int, at: np.ndarray) -> np.ndarray:
        found = lookup[(plan[layout[rows], block[rows], column] << 16) | peek(at)]
        if not found.all():
            raise ValueError("a code is in no table")
        return found

    limit = len(flat) * 8 - 32
    while len(live):
        at_dc = k[live] == 0
        rows = live if at_dc.all() else live[at_dc]
        if len(rows):
            at = pos[rows]
            found = code(rows, 1, at)
            at += found >> 8
            bits = found & 255
            value = peek(at) >> (16 - bits)
            value = np.where(value < (1 << bits) >> 1, value - (1 << bits) + 1, value)
            component = plan[layout[rows], block[rows], 0]
            value = predicted[rows, component] + value
            predicted[rows, component] = value
            pos[rows] = at + bits
            k[rows] = 1
            light = component == 0
            r, value = (rows, value) if light.all() else (rows[light], value[light])
            x = mcu[r] % mx[r] * h[r] + plan[layout[r], block[r], 3]
            y = mcu[r] // mx[r] * v[r] + plan[layout[r], block[r], 4]
            out[base[r] + y * (mx[r] * h[r]) + x] = value
        rows = live[~at_dc] if not at_dc.all() else live[:0]
        if len(rows):
            at = pos[rows]
            found = code(rows, 2, at)
            symbol = found & 255
            pos[rows] = at + (found >> 8) + (symbol & 15)
            step = np.where(symbol == 0, 64, np.where(symbol == 0xF0, 16, (symbol >> 4) + 1))
            k[rows] += step
            over = rows[k[rows] >= 64]
            if len(over):
                k[over] = 0
                block[over] += 1
                last = over[block[over] == counts[layout[over]]]
                block[last] = 0
                mcu[last] += 1
                left[last] -= 1
        if (pos[live] > np.minimum(end[live], limit)).any():
            raise ValueError("a scan ends early")
        live = live[left[live] > 0]
    for p, (at, w, rows, q) in zip(pictures, outs, strict=True):
        raw = out[at : at + w * rows].reshape(rows, w)[: -(-p.height // 8), : -(-p.width // 8)]
        p.thumbnail = np.clip((raw * q + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits, which of 8x8 areas are lighter than their mean."""
    rows, cols = thumbnail.shape
    total = np.zeros((rows + 1, cols + 1), dtype=np.int64)
    total[1:, 1:] = thumbnail.cumsum(0, dtype=np.int64).cumsum(1)
    y0, x0 = np.arange(8) * rows // 8, np.arange(8) * cols // 8
    y1, x1 = np.maximum(y0 + 1, -(-np.arange(1, 9) * rows // 8)), np.maximum(x0 + 1, -(-np.arange(1, 9) * cols // 8))
    area = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    mean = area / np.outer(y1 - y0, x1 - x0)
    return np.packbits(mean > mean.mean()).tobytes().hex()


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, media): each whole text's UTF-8 bytes as a binary column of JPEG files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                media = [encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    body = df.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("bytes"))
    return batch_map(body, run, "doc_id long, media binary")


FEATURES = (
    "doc_id long, width long, height long, n_bytes long, payload_bytes long, payload_sha256 string, "
    "tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
)
#: What broken bytes raise in parsing and decoding.
UNREADABLE = (ValueError, LookupError, ArithmeticError, struct.error)


def _read(media_list: list[bytes | None]) -> list[tuple[list[Picture], str | None]]:
    """(decoded files, None) or ([], what is wrong) of each medium; one that is broken spoils no other."""

    def reason(e: Exception) -> str:
        return str(e) or type(e).__name__

    found: list[tuple[list[Picture], str | None]] = []
    for m in media_list:
        try:
            pictures = [] if m is None else parse(m)
            if any(not p.width or not p.height for p in pictures):
                raise ValueError("a picture without samples")
            found.append((pictures, None if pictures else "no medium"))
        except UNREADABLE as e:
            found.append(([], reason(e)))
    try:
        decode([p for pictures, _ in found for p in pictures])
    except UNREADABLE:  # one of them is broken: each by itself then
        for k, (pictures, _) in enumerate(found):
            try:
                decode(pictures)
            except UNREADABLE as e:
                found[k] = ([], reason(e))
    return found


def features(media: DataFrame) -> DataFrame:
    """What the stored media hold: dimensions, the thumbnail's bytes in digest, and its hash.

    A null or empty medium, and one that isn't whole baseline JPEG with one interleaved scan, gives nulls
    but for its own bytes, and says why in ``error``, which is null elsewhere.
    """

    def digest(media_list: list[bytes | None]) -> list[tuple]:
        rows = []
        for m, (pictures, error) in zip(media_list, _read(media_list), strict=True):
            own = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
            if error:
                rows.append((*(None,) * 6, *own, None, error))
                continue
            thumbs = [p.thumbnail for p in pictures]
            payload = b"".join(t.tobytes() for t in thumbs)
            width, height = pictures[0].width, sum(p.height for p in pictures)
            note = pictures[0].comment
            n = int(note[6:]) if note.startswith(b"bytes=") else len(payload)
            shape = thumbs[0] if len(thumbs) == 1 or len({t.shape[1] for t in thumbs}) > 1 else np.concatenate(thumbs)
            rows.append(
                (width, height, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]),
                 *own, f"{width}x{height}:{average_hash(shape)}", None)
            )
        return rows

    names = [f.split()[0] for f in FEATURES.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in FEATURES.split(", ")[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                held, size, first = [], 0, at
                while at < batch.num_rows and (not held or size < BATCH_BYTES):
                    held.append(batch.column(1)[at].as_py())
                    size += len(held[-1] or b"")
                    at += 1
                rows = digest(held)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *columns], names)

    return batch_map(media.select("doc_id", "media"), run, FEATURES)


def op3_jpeg_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(write_shared(store(documents(spark, sf_dir)), "media"))
