"""FASTA by byte ranges: each range's headers and bases are found by vectors, and what a range begins in follows from those before it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.storage import opened

RANGE_BYTES = 16 << 20
#: White space among bytes as characters of Latin-1, as Python's str.split() sees it.
_SPACE = np.isin(np.arange(256), [ord(c) for c in map(chr, range(256)) if c.isspace()])


@dataclass
class Part:
    """The lines of a range: bases that go on with the line open before it, bases up to the first header after that, headers, bases after the last one, its name, and whether a header line is open at the end if none, or if one, is open before."""

    open_bases: int
    head: int
    headers: int
    tail: int
    name: str
    after: tuple[bool, bool]


@dataclass
class State:
    """What a range begins in: a record's number (-1: none yet), name and bases so far, and whether a header line is open."""

    record: int = -1
    name: str = ""
    size: int = 0
    in_header: bool = False

    def past(self, part: Part) -> State:
        """The state after a range."""
        in_header = part.after[self.in_header]
        if part.headers:
            return State(self.record + part.headers, part.name, part.tail, in_header)
        return State(self.record, self.name, self.size + part.head + (0 if self.in_header else part.open_bases), in_header)


def _looked_at(raw, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, list[str]]:
    """Of the bytes from low to high: themselves, which of them are bases (in lines that begin here or, wrongly so, before), where headers begin, where the first line that begins here begins, and the headers' names."""
    raw.seek(max(low - 1, 0))
    body = raw.read(high - max(low - 1, 0))
    fresh = low == 0 or body[:1] == b"\n"
    data = np.frombuffer(body, np.uint8)[1 if low else 0 :]
    newline = np.flatnonzero(data == 10)
    starts = np.concatenate(([0] if fresh else [], newline + 1)).astype(np.int64)
    starts = starts[starts < len(data)]
    head = starts[data[starts] == 62]
    after = np.searchsorted(newline, head)
    ends = np.where(after < len(newline), newline[np.minimum(after, len(newline) - 1)] if len(newline) else 0, len(data))
    edge = np.zeros(len(data) + 1, np.int32)
    edge[head] += 1
    edge[ends] -= 1
    base = ~_SPACE[data] & (np.cumsum(edge[:-1]) == 0)
    names = []
    for a, b in zip(head.tolist(), ends.tolist()):
        line = data[a + 1 : b].tobytes()
        if b == len(data):  # the range cuts its line
            raw.seek(high)
            while more := raw.read(1 << 12):
                line += more.split(b"\n")[0]
                if b"\n" in more:
                    break
        words = line.decode("latin-1").split()
        if not words:
            raise ValueError("FASTA record without a name")
        names.append(words[0])
    return data, base, head, int(starts[0]) if len(starts) else len(data), names


def part_of(raw, low: int, high: int) -> Part:
    data, base, head, fresh, names = _looked_at(raw, low, high)
    counts = np.concatenate(([0], np.cumsum(base)))
    first, last = (int(head[0]), int(head[-1])) if len(head) else (len(data), len(data))
    newline = bool((data == 10).any())
    cut = len(head) > 0 and not (data[last:] == 10).any()  # the last header's line goes on
    return Part(int(counts[fresh]), int(counts[first] - counts[fresh]), len(head), int(counts[-1] - counts[last]), names[-1] if names else "", (cut, cut if newline or len(head) else True))


def pieces(raw, low: int, high: int, state: State, last: bool, chunk: int) -> Iterator[tuple[int, str, int, int, str, bool]]:
    """(record, name, bin, place in it, bases, whether the bin is whole) of the range's bases; a record without a base here gives an empty piece, to which bin 0 of a later range belongs. last: the file ends here."""
    data, base, head, fresh, names = _looked_at(raw, low, high)
    if state.in_header:
        base[:fresh] = False
    seq = data[base]
    counts = np.concatenate(([0], np.cumsum(base)))
    cuts = [0, *counts[head].tolist(), len(seq)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        record, name, size = (state.record, state.name, state.size) if k == 0 else (state.record + k, names[k - 1], 0)
        ended = k + 1 < len(cuts) - 1 or last
        if a == b:
            if k:
                yield record, name, 0, 0, "", ended
            continue
        if record < 0:
            raise ValueError("FASTA data before the first header")
        while a < b:
            at = size % chunk
            n = min(chunk - at, b - a)
            yield record, name, size // chunk, at, seq[a : a + n].tobytes().decode("latin-1"), at == 0 and (n == chunk or ended) and (k > 0 or size > 0)
            a, size = a + n, size + n


def read(spark: SparkSession, paths: list[tuple[int, str]], chunk: int, range_bytes: int | None = None) -> DataFrame:
    """(file_no, record, name, bin, seq) of plain FASTA files (file_no, path): tasks read ranges of bytes, and bins that a cut divides are put together.

    A first pass gives each range's Part, a few numbers and a name, of which the states
    that ranges begin in are composed here.
    """
    ranges = []
    for file_no, path in paths:
        system, inner = opened(path)
        size = system.get_file_info(inner).size
        step = range_bytes or RANGE_BYTES
        ranges += [(file_no, path, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
    numbered = spark.range(0, len(ranges), 1, max(1, len(ranges)))
    shape = pa.schema([("i", pa.int64()), *[(c, pa.int64()) for c in ("open_bases", "head", "headers", "tail")], ("name", pa.string()), ("after", pa.list_(pa.bool_()))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                _, path, low, high = ranges[i]
                system, inner = opened(path)
                with system.open_input_file(inner) as raw:
                    yield pa.RecordBatch.from_pylist([{"i": i, **vars(part_of(raw, low, high))}], schema=shape)

    found = numbered.mapInArrow(parts, "i bigint, open_bases bigint, head bigint, headers bigint, tail bigint, name string, after array<boolean>").collect()
    states, state = [], State()
    for k, r in enumerate(sorted(found, key=lambda r: r["i"])):
        if k == 0 or ranges[k][0] != ranges[k - 1][0]:
            state = State()
        states.append(state)
        state = state.past(Part(r["open_bases"], r["head"], r["headers"], r["tail"], r["name"], tuple(r["after"])))
        if state.record < 0 and (state.size or k + 1 == len(ranges) or ranges[k + 1][0] != ranges[k][0]):
            raise ValueError("FASTA data before the first header" if state.size else "FASTA without records")
    out = pa.schema([("file_no", pa.int32()), ("record", pa.int32()), ("name", pa.string()), ("bin", pa.int64()), ("at", pa.int64()), ("seq", pa.string()), ("whole", pa.bool_())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                file_no, path, low, high = ranges[i]
                system, inner = opened(path)
                with system.open_input_file(inner) as raw:
                    rows = list(pieces(raw, low, high, states[i], i + 1 == len(ranges) or ranges[i + 1][0] != file_no, chunk))
                for at in range(0, len(rows), 64):
                    some = rows[at : at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[file_no] * len(some), *zip(*some)], out)], schema=out)

    made = numbered.mapInArrow(cut, "file_no int, record int, name string, bin bigint, at bigint, seq string, whole boolean")
    key = ["file_no", "record", "name", "bin"]
    ordered = F.array_sort(F.collect_list(F.struct("at", "seq")))  # a bin has few pieces: one for each range that it crosses
    joined = made.filter("not whole").groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["seq"]), "").alias("seq"))
    return made.filter("whole").select(*key, "seq").unionAll(joined)
