"""Gzip in blocks: members of up to 64 kB of text that say how long they are (the public BGZF layout), so a file can be entered anywhere."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession

from alignloom.storage import opened

#: Text of a member; compressed bytes of a task that lists members; text between two entries of an index.
BLOCK, LISTED, STEP = 65_280, 16 << 20, 1 << 20
#: Fixed values of the layout: a member's first bytes, the extra field that holds its length less one, the last member.
_HEAD, _EXTRA = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00"
_LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_MOST = 1 << 16


class Writer:
    """A stream that writes members."""

    def __init__(self, out):
        self._out, self._held = out, bytearray()

    def write(self, data: bytes) -> None:
        self._held += data
        while len(self._held) >= BLOCK:
            self._member(bytes(self._held[:BLOCK]))
            del self._held[:BLOCK]

    def _member(self, text: bytes) -> None:
        for level in (1, 0):  # what does not shrink is stored
            packer = zlib.compressobj(level, zlib.DEFLATED, -15)
            body = packer.compress(text) + packer.flush()
            if len(body) + 26 <= _MOST:
                break
        self._out.write(_HEAD + b"\0\0\0\0\0\xff" + _EXTRA + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text)))

    def close(self) -> None:
        if self._held:
            self._member(bytes(self._held))
        self._out.write(_LAST)
        self._out.close()


def length_at(data: bytes, at: int) -> int:
    """The bytes of the member that begins there; 0 if none of this layout does."""
    return struct.unpack_from("<H", data, at + 16)[0] + 1 if data[at : at + 4] == _HEAD and data[at + 10 : at + 16] == _EXTRA and at + 18 <= len(data) else 0


def members(raw, low: int, high: int) -> Iterator[tuple[int, int]]:
    """(place, bytes of text) of the members that begin in a range of a file: the first is the first place from which members follow each other."""
    raw.seek(low)
    data = raw.read(high - low + 3 * _MOST)
    at = -1
    while 0 <= (at := data.find(_HEAD, at + 1)) < high - low:
        n = length_at(data, at)
        after = length_at(data, at + n) if n else 0
        if n and (after or at + n == len(data)):
            break
    while 0 <= at < high - low and at < len(data):
        n = length_at(data, at)
        if not n or at + n > len(data):
            raise ValueError(f"a member of the block gzip file is damaged at byte {low + at}")
        yield low + at, struct.unpack_from("<I", data, at + n - 4)[0]
        at += n


@dataclass(frozen=True)
class Index:
    """Offsets in the text and the members' places there, some for each STEP; size: the text's bytes."""

    offsets: tuple[int, ...]
    places: tuple[int, ...]
    size: int


_KNOWN: dict[tuple[str, int], Index] = {}


def index(spark: SparkSession, path: str, size: int) -> Index:
    """The index of a file of that size, listed by tasks that each look at a range of its bytes."""
    if (path, size) in _KNOWN:
        return _KNOWN[path, size]
    lows = list(range(0, max(size, 1), LISTED))
    shape = pa.schema([("i", pa.int64()), ("places", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(path)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                places, sizes = [], []
                with system.open_input_file(inner) as raw:
                    for place, n in members(raw, lows[i], min(lows[i] + LISTED, size)):
                        if places and sizes[-1] < STEP:
                            sizes[-1] += n
                        else:
                            places.append(place)
                            sizes.append(n)
                yield pa.RecordBatch.from_pylist([{"i": i, "places": places, "sizes": sizes}], schema=shape)

    rows = spark.range(0, len(lows), 1, len(lows)).mapInArrow(run, "i bigint, places array<bigint>, sizes array<bigint>").collect()
    offsets, places, at = [], [], 0
    for r in sorted(rows, key=lambda r: r["i"]):
        for place, n in zip(r["places"], r["sizes"]):
            offsets.append(at)
            places.append(place)
            at += n
    _KNOWN[path, size] = Index(tuple(offsets), tuple(places), at)
    return _KNOWN[path, size]


class Reader:
    """The text of a file of members as a stream that can be entered anywhere."""

    def __init__(self, raw, known: Index):
        self._raw, self._known, self._at, self._held = raw, known, 0, b""
        self._next = 0  # the place of the next member

    def seek(self, offset: int) -> None:
        k = max(bisect_right(self._known.offsets, offset) - 1, 0)
        at = self._known.offsets[k] if self._known.offsets else 0
        self._next, self._held, self._at = (self._known.places[k] if self._known.places else 0), b"", at
        self._skip(offset - at)

    def _skip(self, n: int) -> None:
        while n > 0 and (part := self.read(min(n, STEP))):
            n -= len(part)

    def read(self, n: int = -1) -> bytes:
        parts, need = [self._held], (1 << 62 if n < 0 else n) - len(self._held)
        while need > 0:
            self._raw.seek(self._next)
            head = self._raw.read(18)
            size = length_at(head, 0)
            if not size:
                break
            body = self._raw.read(size - 18)
            self._next += size
            parts.append(zlib.decompress(body[:-8], -15))
            if struct.unpack("<II", body[-8:]) != (zlib.crc32(parts[-1]), len(parts[-1])):
                raise ValueError("a member of the block gzip file is damaged")
            need -= len(parts[-1])
        data = b"".join(parts)
        out, self._held = (data, b"") if n < 0 else (data[:n], data[n:])
        self._at += len(out)
        return out
