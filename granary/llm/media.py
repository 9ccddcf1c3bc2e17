"""Media columns: signature sniffing of binary values.

Aho-Corasick locates the magic bytes of all formats in one pass over a value. Each hit
goes to its format's validator, which follows the structure from there and returns
the length of a sound medium, or nothing. What starts at the first byte gives the
true type, whatever was declared; what starts later is embedded and can be carved out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import id_and_text, map_rows, sha256_hex, utf8

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
GZIP_STEP = 1 << 16
#: Payloads of texts are padded to a multiple of this many samples.
ROW = 576


def _be(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "big")


def _le(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


class Places:
    """Where marks stand in a value, and what was learned about it: each is worked out once, however many hits ask."""

    def __init__(self, data: bytes):
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self._zips: dict[int, int] | None = None
        self.gif_ends: dict[int, int | None] = {}
        self.segment_ends: dict[int, int | None] = {}
        self.page_ends: dict[int, int | None] = {}
        self.block_ends: dict[int, int] = {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self._marks:
            self._marks[mark] = [found.start() for found in re.finditer(re.escape(mark), self.data)]
        return self._marks[mark]

    def first(self, mark: bytes, start: int) -> int:
        """The first one from ``start`` on, -1 without any."""
        places = self.of(mark)
        n = bisect_left(places, start)
        return places[n] if n < len(places) else -1

    def last(self, mark: bytes, start: int, stop: int) -> int:
        """The last one from ``start`` on and before ``stop``, -1 without any."""
        places = self.of(mark)
        n = bisect_left(places, stop)
        return places[n - 1] if n and places[n - 1] >= start else -1

    def zip_end(self, at: int) -> int | None:
        """End of the archive that begins here: an end record tells where its directory and its archive begin."""
        if self._zips is None:
            self._zips = {}
            for end in self.of(b"PK\x05\x06"):
                size, offset, comment = (_le(self.data, end + k, n) for k, n in ((12, 4), (16, 4), (20, 2)))
                directory, stop = end - size, end + 22 + comment
                sound = stop <= len(self.data) and (not size or self.data[directory : directory + 4] == b"PK\x01\x02")
                if sound and 0 <= directory - offset:
                    self._zips[directory - offset] = stop
        return self._zips.get(at)


def png_chunks(data: bytes, at: int) -> Iterator[tuple[bytes, bytes, int]]:
    """(kind, body, end) of the chunks of a PNG that begins at ``at``, as long as their checksums hold."""
    at += 8
    while at + 12 <= len(data):
        size = _be(data, at, 4)
        end = at + 12 + size
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != _be(data, end - 4, 4):
            return
        yield data[at + 4 : at + 8], data[at + 8 : end - 4], end
        at = end


def _png(data: bytes, at: int, places: Places) -> int | None:
    for n, (kind, body, end) in enumerate(png_chunks(data, at)):
        if (n == 0) != (kind == b"IHDR") or n == 0 and len(body) != 13:
            return None
        if kind == b"IEND":
            return end - at
    return None


def _gif(data: bytes, at: int, places: Places) -> int | None:
    if len(data) < at + 13:
        return None
    here = at + 13 + (3 << ((data[at + 10] & 7) + 1) if data[at + 10] & 0x80 else 0)
    ends, walked, end = places.gif_ends, [], None

    def blocks(i: int) -> int:
        passed = []
        while i < len(data) and data[i] and i not in places.block_ends:
            passed.append(i)
            i += data[i] + 1
        stop = places.block_ends.get(i, i + 1)
        places.block_ends.update(dict.fromkeys(passed, stop))
        return stop

    while here < len(data):
        if here in ends:
            end = ends[here]
            break
        walked.append(here)
        if data[here] == 0x3B:
            end = here + 1
            break
        if data[here] == 0x21:
            here = blocks(here + 2)
        elif data[here] == 0x2C and here + 10 < len(data):
            flags = data[here + 9]
            here = blocks(here + 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0))
        else:
            break
    ends.update(dict.fromkeys(walked, end))
    return end - at if end else None


def _jpeg(data: bytes, at: int, places: Places) -> int | None:
    # where a file ends whose next segment begins at a place is the same for all files that come there
    here, ends, walked, end = at + 2, places.segment_ends, [], None
    while here + 4 <= len(data) and data[here] == 0xFF:
        if here in ends:
            end = ends[here]
            break
        walked.append(here)
        marker = data[here + 1]
        here += 2 + _be(data, here + 2, 2)
        if marker == 0xDA:
            mark = places.first(b"\xff\xd9", here)
            end = mark + 2 if mark >= 0 else None
            break
        if not 0xC0 <= marker <= 0xFE:
            break
    ends.update(dict.fromkeys(walked, end))
    return end - at if end else None


def _riff(data: bytes, at: int, places: Places) -> int | None:
    size = _le(data, at + 4, 4) + 8
    if size < 20 or at + size > len(data) or data[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return None
    here = at + 12
    while here + 8 <= at + size:
        here += 8 + (_le(data, here + 4, 4) + 1 & ~1)
    return size if here == at + size else None


def _bmp(data: bytes, at: int, places: Places) -> int | None:
    size, offset, header = _le(data, at + 2, 4), _le(data, at + 10, 4), _le(data, at + 14, 4)
    sound = header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size and not _le(data, at + 6, 4)
    return size if sound and at + size <= len(data) else None


def _pdf(data: bytes, at: int, places: Places) -> int | None:
    """Up to the last end mark before another PDF begins: each save in place adds one."""
    if not data[at + 5 : at + 6].isdigit():
        return None
    other = places.first(b"%PDF-", at + 1)
    end = places.last(b"%%EOF", at, other if other >= 0 else len(data))
    return end + 5 - at if end >= 0 and places.last(b"startxref", at, end) >= 0 else None


def _zip(data: bytes, at: int, places: Places) -> int | None:
    end = places.zip_end(at)
    return end - at if end else None


def _gzip(data: bytes, at: int, places: Places) -> int | None:
    stream, here, rest = zlib.decompressobj(31), at, b""
    try:
        while not stream.eof and (rest or here < len(data)):
            if not rest:
                rest, here = data[here : here + GZIP_STEP], here + GZIP_STEP
            stream.decompress(rest, 1 << 20)
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return min(here, len(data)) - len(stream.unused_data) - at if stream.eof else None


def _ogg(data: bytes, at: int, places: Places) -> int | None:
    here, ends, walked, end = at, places.page_ends, [], None
    while data[here : here + 4] == b"OggS" and here + 27 <= len(data):
        if here in ends:
            end = ends[here]
            break
        walked.append(here)
        table = data[here + 27 : here + 27 + data[here + 26]]
        last = data[here + 5] & 4
        here += 27 + data[here + 26] + sum(table)
        if here > len(data):
            break
        if last:
            end = here
            break
    ends.update(dict.fromkeys(walked, end))
    return end - at if end else None


#: Magic bytes, type and validator (fixed values of the formats).
FORMATS = [
    (PNG_MAGIC, "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"RIFF", "audio/wav", _riff),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
]
_RIFF_TYPES = {b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), n)
    found.make_automaton()
    return found


def carve(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every sound medium, in order; what lies inside of one is part of it."""
    found: list[tuple[int, int, str]] = []
    free, places = 0, Places(data)
    for end, n in _automaton().iter(data.decode("latin-1")):
        magic, kind, validate = FORMATS[n]
        at = end + 1 - len(magic)
        if at >= free and (length := validate(data, at, places)):
            found.append((at, length, _RIFF_TYPES.get(data[at + 8 : at + 12], kind) if magic == b"RIFF" else kind))
            free = at + length
    return found


def sniff(data: bytes | None, declared: str | None) -> tuple[str | None, bool, list[tuple[int, int, str]]]:
    """(true type, was the declared one wrong, embedded media)."""
    media = carve(data or b"")
    own = media[0] if media and media[0][0] == 0 else None
    kind = own[2] if own else declared
    return kind, kind != declared, media[1:] if own else media


def sniff_media(df: DataFrame, key: str, data: str, declared: str) -> DataFrame:
    """True type and embedded media of a binary column.

    Returns key, media_type, corrected, offsets, lengths and types of embedded media. A
    null or empty value keeps its declared type. Other columns are left out.
    """

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for name, blob, said in batch:
            kind, wrong, inside = sniff(blob, said)
            yield name, kind, wrong, [x[0] for x in inside], [x[1] for x in inside], [x[2] for x in inside]

    picked = df.select(F.col(key).cast("long").alias("key"), F.col(data).cast("binary"), F.col(declared).cast("string"))
    schema = "key long, media_type string, corrected boolean, offsets array<long>, lengths array<long>, types array<string>"
    return map_rows(picked, rows, schema)


def to_png(samples: bytes, width: int) -> bytes:
    """8-bit grey PNG whose pixels are the samples, row by row."""
    height = len(samples) // width
    rows = np.zeros((height, width + 1), np.uint8)  # every row starts with filter type 0
    rows[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, width)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    header = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return PNG_MAGIC + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int, int]:
    """Samples, width and height of an unfiltered 8-bit grey PNG."""
    if not data.startswith(PNG_MAGIC) or _png(data, 0, Places(data)) != len(data):
        raise ValueError("not a sound PNG")
    chunks = list(png_chunks(data, 0))
    header = chunks[0][1]
    width, height = _be(header, 0, 4), _be(header, 4, 4)
    rows = np.frombuffer(zlib.decompress(b"".join(body for kind, body, _ in chunks if kind == b"IDAT")), np.uint8)
    rows = rows.reshape(height, width + 1)
    if header[8:] != bytes([8, 0, 0, 0, 0]) or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey PNG")
    return rows[:, 1:].tobytes(), width, height


def text_payload(text: str) -> bytes:
    data = utf8(text)
    return data + b"\xff" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """Store each whole text as the samples of an 8-bit grey PNG, read it back and describe it.

    The stored form is declared as octets; sniffing finds its true type and only then is it
    decoded. Returns doc_id, n_bytes (UTF-8, unpadded), payload_bytes, payload_sha256 and
    tail_crc32 (last 32 bytes) of what was read back, media_bytes and media_sha256 of the
    stored form, and a feature: type, size, media found within the payload, mean and
    entropy of the samples. Equal texts have equal values; a null text is the empty one.
    """

    def rows(batch: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in batch:
            n_bytes = len(utf8(text))
            stored = to_png(text_payload(text), ROW)
            kind, _, _ = sniff(stored, "application/octet-stream")
            payload, width, height = from_png(stored)
            counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = counts[counts > 0] / len(payload)
            entropy = float(-(share * np.log2(share)).sum()) + 0.0
            mean = float(counts @ np.arange(256)) / len(payload)
            inside = carve(payload)
            kinds = ",".join(f"{x[2]}@{x[0]}+{x[1]}" for x in inside)
            feature = f"{kind} {width}x{height} embedded={len(inside)}[{kinds}] mean={mean:.4f} entropy={entropy:.4f}"
            yield (
                doc_id, n_bytes, len(payload), sha256_hex(payload), zlib.crc32(payload[-32:]),
                len(stored), sha256_hex(stored), feature,
            )

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return map_rows(id_and_text(docs), rows, schema)
