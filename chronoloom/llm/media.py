"""Signature sniffing of media columns: magic bytes, structure, declared types, embedded media."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batch, map_batches

#: Magic bytes -> kind, and how far into the file they stand.
MAGICS = {
    b"RIFF": ("riff", 0), b"\x89PNG\r\n\x1a\n": ("png", 0), b"GIF87a": ("gif", 0), b"GIF89a": ("gif", 0), b"\xff\xd8\xff": ("jpeg", 0),
    b"%PDF-": ("pdf", 0), b"PK\x03\x04": ("zip", 0), b"\x1f\x8b\x08": ("gzip", 0), b"OggS": ("ogg", 0), b"fLaC": ("flac", 0), b"ftyp": ("mp4", 4), b"BM": ("bmp", 0),
}
TYPES = {"wav": "audio/wav", "webp": "image/webp", "avi": "video/x-msvideo", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "ogg": "audio/ogg", "flac": "audio/flac", "mp4": "video/mp4", "bmp": "image/bmp"}
UNKNOWN = "application/octet-stream"


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic in MAGICS:
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


class Scan:
    """Validators over one value; what was searched for in vain isn't searched for again."""

    def __init__(self, data: bytes) -> None:
        self.data, self.marks = data, {}
        #: Where media of each kind may begin, by the automaton's one pass over the value.
        self.places = sorted((at + 1 - len(m) - MAGICS[m][1], MAGICS[m][0]) for at, m in _automaton().iter(data.decode("latin-1")))

    def after(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or -1; all places are looked up once."""
        if mark not in self.marks:
            places, i = [], self.data.find(mark)
            while i >= 0:
                places.append(i)
                i = self.data.find(mark, i + 1)
            self.marks[mark] = places
        places = self.marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def check(self, kind: str, at: int) -> tuple[str, int, int, int] | None:
        """(kind, length, body offset, body length) of well-formed media at this place, else None."""
        try:
            found = getattr(self, "_" + kind)(at)
        except (struct.error, IndexError):
            return None
        return found if found and at + found[1] <= len(self.data) else None

    def _riff(self, at: int):
        d = self.data
        size, form = struct.unpack_from("<I4s", d, at + 4)
        kind, end = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form), at + 8 + size
        if not kind or end > len(d):
            return None
        i, chunks = at + 12, {}
        while i + 8 <= end:
            name, n = struct.unpack_from("<4sI", d, i)
            if i + 8 + n > end:
                return None
            chunks.setdefault(name, (i + 8, n))
            i += 8 + n + (n & 1)
        if i < end or not chunks:
            return None
        if kind == "wav":
            if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
                return None
            _, channels, rate, per_s, align, bits = struct.unpack_from("<HHIIHH", d, chunks[b"fmt "][0])
            if not channels or align != channels * bits // 8 or per_s != rate * align or not align or chunks[b"data"][1] % align:
                return None
            body = chunks[b"data"]
            return kind, 8 + size, body[0] - at, body[1]
        return kind, 8 + size, 12, size - 4

    def _png(self, at: int):
        d, i, first = self.data, at + 8, True
        while True:
            n, name = struct.unpack_from(">I4s", d, i)
            end = i + 12 + n
            if end > len(d) or (first and (name != b"IHDR" or n != 13)) or struct.unpack_from(">I", d, end - 4)[0] != zlib.crc32(d[i + 4 : end - 4]):
                return None
            first, i = False, end
            if name == b"IEND":
                return "png", i - at, 8, i - at - 8

    def _gif(self, at: int):
        d = self.data
        flags = d[at + 10]
        i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

        def blocks(i: int) -> int:
            while d[i]:
                i += d[i] + 1
            return i + 1

        while d[i] != 0x3B:
            if d[i] == 0x21:
                i = blocks(i + 2)
            elif d[i] == 0x2C:
                flags = d[i + 9]
                i = blocks(i + 11 + (3 << ((flags & 7) + 1) if flags & 128 else 0))
            else:
                return None
        return "gif", i + 1 - at, 13, i - at - 13

    def _jpeg(self, at: int):
        d, i, frame = self.data, at + 2, False
        while True:
            if d[i] != 0xFF:
                return None
            while d[i + 1] == 0xFF:  # fill bytes may stand before any marker
                i += 1
            mark = d[i + 1]
            n = struct.unpack_from(">H", d, i + 2)[0]
            if n < 2 or mark < 0xC0 or mark in (0xD8, 0xD9) or 0xD0 <= mark <= 0xD7:
                return None
            frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
            i += 2 + n
            if mark == 0xDA:
                end = self.after(b"\xff\xd9", i)
                return None if end < 0 or not frame else ("jpeg", end + 2 - at, 2, end - at - 2)

    def _pdf(self, at: int):
        d, end = self.data, self.after(b"%%EOF", at)
        if end < 0 or not (d[at + 5 : at + 6].isdigit() and d[at + 6 : at + 7] == b"." and d[at + 7 : at + 8].isdigit()):
            return None
        return "pdf", end + 5 - at, 0, end + 5 - at

    def _zip(self, at: int):
        end = self.after(b"PK\x05\x06", at)
        while end >= 0:  # stored content may hold such marks itself: the record whose numbers agree counts
            if end + 22 > len(self.data):
                return None
            count, size, offset, comment = struct.unpack_from("<HIIH", self.data, end + 10)
            if at + offset + size == end and self._directory(at + offset, end, count) and end + 22 + comment <= len(self.data):
                return "zip", end + 22 + comment - at, 0, end + 22 + comment - at
            end = self.after(b"PK\x05\x06", end + 1)
        return None

    def _directory(self, i: int, end: int, count: int) -> bool:
        for _ in range(count):
            if i + 46 > end or self.data[i : i + 4] != b"PK\x01\x02":
                return False
            i += 46 + sum(struct.unpack_from("<HHH", self.data, i + 28))
        return i == end

    def _gzip(self, at: int):
        if self.data[at + 3] & 0xE0:
            return None
        reader, i = zlib.decompressobj(31), at
        try:
            while not reader.eof:
                part = reader.unconsumed_tail or self.data[i : i + 65536]
                i += 0 if reader.unconsumed_tail else len(part)
                if not part:
                    return None
                reader.decompress(part, 1 << 20)
        except zlib.error:
            return None
        n = i - len(reader.unused_data) - at
        return "gzip", n, 0, n

    def _ogg(self, at: int):
        d, i = self.data, at
        if not d[at + 5] & 2:  # a page from inside a stream
            return None
        while d[i : i + 4] == b"OggS":
            if d[i + 4]:
                return None
            n = d[i + 26]
            i += 27 + n + sum(d[i + 27 : i + 27 + n])
        return ("ogg", i - at, 0, i - at) if i > at else None

    def _flac(self, at: int):
        """Metadata blocks to the last one, then frames; a stream says nothing of its end, so it goes to the next
        embedded signature whose structure holds, or to the end of the value."""
        d, i, first, last = self.data, at + 4, True, False
        while not last:
            head = struct.unpack_from(">I", d, i)[0]
            kind, n, last = head >> 24 & 0x7F, head & 0xFFFFFF, bool(head >> 31)
            if first != (kind == 0) or (first and n != 34) or kind == 127 or i + 4 + n > len(d):
                return None
            first, i = False, i + 4 + n
        if i < len(d) and (i + 2 > len(d) or d[i] != 0xFF or d[i + 1] & 0xFC != 0xF8):
            return None
        end = len(d)
        for place, kind in self.places:
            if place > i and kind != "flac" and place < end and self.check(kind, place):
                end = place
                break
        return "flac", end - at, i - at, end - i

    def _mp4(self, at: int):
        d, i, n = self.data, at, 0
        while i + 8 <= len(d):
            size, name = struct.unpack_from(">I4s", d, i)
            if i + size > len(d) and name in (b"ftyp", b"moov", b"mdat", b"moof", b"meta", b"free", b"skip"):
                return None  # cut off
            if size < 8 or i + size > len(d) or not name.isalnum():
                break
            i, n = i + size, n + 1
        return ("mp4", i - at, 0, i - at) if n > 1 else None

    def _bmp(self, at: int):
        size, _, offset, header = struct.unpack_from("<IIII", self.data, at + 2)
        return ("bmp", size, offset, size - offset) if header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size else None


def sniff(data: bytes) -> tuple[tuple[str, int, int, int] | None, list[tuple[str, int, int]]]:
    """What the value itself is, and the media carved from inside: (kind, offset, length), leftmost first, not nested.

    One pass of the automaton finds every magic; only places whose structure and lengths hold count.
    """
    scan, own, inside, end = Scan(data), None, [], 0
    for at, kind in scan.places:
        if at < 0 or at < end or at == 0 and own:
            continue
        if found := scan.check(kind, at):
            if at == 0:
                own = found
            else:
                inside.append((found[0], at, found[1]))
                end = at + found[1]
    return own, inside


WAV_RATE = 16_000


def wav(samples: bytes) -> bytes:
    """Unsigned 8-bit mono samples as a RIFF WAVE value."""
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + (n & 1), b"WAVE", b"fmt ", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8, b"data", n) + samples + bytes(n & 1)


BLOCK = 576
STORED = "doc_id long, n_bytes long, declared string, media binary"
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("media", pa.binary())])


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [x or b"" for x in b.column(1).to_pylist()]
        yield batch(_STORED, {"doc_id": b.column(0), "n_bytes": [len(x) for x in raw], "declared": [UNKNOWN] * len(raw), "media": [wav(x + b"\xff" * (-len(x) % BLOCK if x else BLOCK)) for x in raw]})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, filled with 255 to a positive multiple of 576, as a WAVE value of unknown type."""
    return map_batches(_texts(docs), _store, STORED)


FOUND = "{key} long, n_bytes long, declared string, detected string, corrected boolean, media_bytes long, media_sha256 string, body_bytes long, body_sha256 string, tail_crc32 long, sample_mean double, embedded array<struct<kind:string,offset:long,length:long>>"
_EMBEDDED = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def _inspect(key: str):
    schema = pa.schema([(key, pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("detected", pa.string()), ("corrected", pa.bool_()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("body_bytes", pa.int64()), ("body_sha256", pa.string()), ("tail_crc32", pa.int64()), ("sample_mean", pa.float64()), ("embedded", _EMBEDDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {f.name: [] for f in schema}
            for k, n, declared, data in zip(*(c.to_pylist() for c in b.columns)):
                data = data or b""
                own, inside = sniff(data)
                detected = TYPES[own[0]] if own else UNKNOWN
                body = data[own[2] : own[2] + own[3]] if own else data
                said = (declared or "").split(";")[0].strip().lower()
                row = (k, n, declared, detected, own is not None and said != detected, len(data), hashlib.sha256(data).hexdigest(), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), float(np.frombuffer(body, np.uint8).mean()) if body else None, [{"kind": a, "offset": o, "length": m} for a, o, m in inside])
                for c, v in zip(columns.values(), row):
                    c.append(v)
            yield batch(schema, columns)

    return run


def inspect(media: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Sniff ``media(key, n_bytes, declared, media)``: detected type, digests of the value and of its body, embedded media.

    ``corrected`` says that the declared type (any case, parameters after ``;`` ignored; null counts as wrong)
    differs from the detected one. Nothing recognised: detected is application/octet-stream, the body is the whole
    value, the declared type stands. Null or empty value: the same, with no bytes. Null keys, repeated rows: kept,
    each on its own. Other columns are ignored.
    """
    rows = media.select(F.col(key).cast("long"), F.col("n_bytes").cast("long"), F.col("declared").cast("string"), "media")
    return map_batches(rows, _inspect(key), FOUND.format(key=key))
