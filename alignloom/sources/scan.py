"""Chain text by columns: lines, words and numbers of a window of bytes are found by vectors, no loop runs over lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from alignloom.schema import MAX_U32, MAX_U64

#: Bytes that are read at a time; rows of a batch.
WINDOW, BATCH_ROWS = 4 << 20, 16_384
#: Bytes that are read beyond a range for the record that it cuts.
SLACK = 1 << 12
_SPACE, _DIGITS, _INTEGER = re.compile(rb"[ \t\n\f\r]+"), re.compile(rb"[0-9]+\Z"), re.compile(rb"-?[0-9]+\Z")
_NUMBERS = {"r_size": 3, "r_start": 5, "r_end": 6, "q_size": 8, "q_start": 10, "q_end": 11}  # the words of a header
_TEXTS = {"r_name": 2, "r_strand": 4, "q_name": 7, "q_strand": 9}

Headers = dict[str, np.ndarray | pa.Array]


class Fault(ValueError):
    pass


def _dark(data: np.ndarray) -> np.ndarray:
    """Which bytes are no white space: neither 9, 10, 12, 13 nor 32 (a table of 256 entries would cost an index of eight bytes for each)."""
    return ((data - np.uint8(9) > 4) | (data == 11)) & (data != 32)


def words(line: bytes) -> list[bytes]:
    """Runs of other bytes than ASCII white space (a vertical tab is none)."""
    return [w for w in _SPACE.split(line) if w]


def _unsigned(token: bytes, most: int, what: str) -> None:
    if not _DIGITS.match(token):
        raise Fault(f"{what} is not a number")
    if int(token) > most:
        raise Fault(f"{what} exceeds {'u32' if most == MAX_U32 else 'u64'}")


def header_fault(line: bytes, need_id: bool) -> str:
    """What is wrong with a header line that the vectors found faulty."""
    w = words(line)
    try:
        if not w or w[0] != b"chain":
            raise Fault("expected a chain header")
        if len(w) < 12:
            raise Fault("chain header is missing fields")
        if need_id and len(w) < 13:
            raise Fault("id missing")
        if any(w[at] not in (b"+", b"-") for at in (4, 9)):
            raise Fault("strand is neither + nor -")
        for at, what in ((2, "reference"), (7, "query")):
            for k, field in ((1, "size"), (3, "start"), (4, "end")):
                _unsigned(w[at + k], MAX_U32, f"{what} {field}")
        if not _INTEGER.match(w[1]) or not -(1 << 63) < int(w[1]) < 1 << 63:
            raise Fault("score is not a 64-bit number")
        _unsigned(w[12], MAX_U64, "id")
    except Fault as fault:
        return str(fault)
    raise AssertionError(line)


def block_fault(line: bytes) -> str:
    """What is wrong with a block line that the vectors found faulty."""
    w = words(line)
    try:
        if len(w) == 2:
            raise Fault("block line missing dq value")
        for x in w[:3]:
            _unsigned(x, MAX_U32, "block value")
    except Fault as fault:
        return str(fault)
    raise AssertionError(line)


@dataclass
class Lines:
    """The lines of a window: where they start and end (without newline), the next line's start, where words start and end, each line's first word and number of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    past: np.ndarray
    word: np.ndarray
    word_end: np.ndarray
    first: np.ndarray
    n_words: np.ndarray
    blank: np.ndarray
    note: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def lines_of(data: np.ndarray, last: bool, with_words: bool = True) -> Lines:
    """The lines of data, which begins with one; one without a newline only if it is the last of all. Without words, only whether a line has any is known."""
    newline = np.flatnonzero(data == 10)
    starts, past = np.concatenate(([0], newline + 1)), newline + 1
    ends = newline
    if last and starts[-1] < len(data):
        ends, past = np.append(newline, len(data)), np.append(past, len(data))
    starts = starts[: len(ends)]
    note = data[np.minimum(starts, max(len(data) - 1, 0))] == 35 if len(data) else np.zeros(0, bool)
    if not with_words:
        blank, none = ends == starts, np.zeros(0, np.int64)
        led = np.flatnonzero(~blank)
        led = led[~_dark(data[starts[led]])]
        if len(led):  # only lines that begin with white space are looked through
            seen = np.concatenate(([0], np.cumsum(_dark(data))))
            blank[led] = seen[ends[led]] == seen[starts[led]]
        return Lines(data, starts, ends, past, none, none, none, none, blank, note)
    dark = _dark(data)
    edge = np.diff(dark.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    word, word_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(word, starts)
    n_words = np.diff(np.append(first, np.searchsorted(word, past[-1] if len(past) else 0)))
    return Lines(data, starts, ends, past, word, word_end, first, n_words, n_words == 0, note)


def inside_after(lines: Lines, inside: bool) -> np.ndarray:
    """For each line whether a record is open after it: a blank line ends one, a line that is no note begins or goes on with one, a note changes nothing."""
    decisive = np.maximum.accumulate(np.where(lines.note, -1, np.arange(len(lines))))
    return np.where(decisive < 0, inside, ~lines.blank[decisive])


def numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned values of digit strings, and which are none or exceed 64 bits; digits are folded place by place."""
    length = end - start
    value, bad = np.zeros(len(start), np.uint64), length <= 0
    at = np.flatnonzero(length <= 18)
    place, k = np.uint64(1), 0
    while len(at := at[length[at] > k]):
        digit = data[end[at] - 1 - k] - np.uint8(48)
        bad[at] |= digit > 9
        value[at] += digit * place
        place, k = place * np.uint64(10), k + 1
    for i in np.flatnonzero(length > 18).tolist():  # 64-bit values of more digits and leading zeros
        token = data[start[i] : end[i]].tobytes()
        ok = _DIGITS.match(token) is not None and int(token) <= MAX_U64
        value[i], bad[i] = int(token) if ok else 0, not ok
    return value, bad


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Stretches of data as strings, each byte a character of Latin-1."""
    length = end - start
    offsets = np.concatenate(([0], np.cumsum(length)))
    body = data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
    if len(body) and body.max() > 127:
        return pa.array([data[a:b].tobytes().decode("latin-1") for a, b in zip(start.tolist(), end.tolist())], pa.string())
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body))


def schema() -> pa.Schema:
    block = pa.struct([(f, pa.int64()) for f in ("size", "gap_reference", "gap_query")])
    long, text = pa.int64(), pa.string()
    sides = [(f"{p}_{f}", t) for p in "rq" for f, t in (("name", text), ("size", long), ("strand", text), ("start", long), ("end", long))]
    return pa.schema([
        ("kind", text), ("offset", long), ("score", long), *sides, ("id", pa.decimal128(20, 0)), ("id_explicit", pa.bool_()), ("blocks", pa.list_(block)),
        ("length", long), ("line", text), ("error", text), ("error_offset", long),
    ])


def _table(n: int, columns: dict[str, pa.Array]) -> pa.Table:
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema()], schema=schema())


def headers(lines: Lines, at: np.ndarray, need_id: bool) -> tuple[Headers, np.ndarray]:
    """The columns of the header lines `at`, and which are faulty; further words are passed over."""
    data, n = lines.data, lines.n_words[at]
    faulty = n < 12 + need_id
    word = lambda k: lines.first[at] + np.minimum(k, np.maximum(n - 1, 0))  # noqa: E731  (a faulty header has fewer)
    span = lambda k: (lines.word[word(k)], lines.word_end[word(k)])
    start, end = span(0)
    tag = np.ones(len(at), bool) & (end - start == 5)
    for k, c in enumerate(b"chain"):
        tag &= data[np.minimum(start + k, len(data) - 1)] == c
    faulty |= ~tag
    out: Headers = {}
    for name, k in _TEXTS.items():
        start, end = span(k)
        out[name] = strings(data, start, end)
        if name.endswith("strand"):
            faulty |= (end - start != 1) | ((data[start] != 43) & (data[start] != 45))
    for name, k in _NUMBERS.items():
        value, bad = numbers(data, *span(k))
        faulty |= bad | (value > MAX_U32)
        out[name] = value.astype(np.int64)
    start, end = span(1)
    minus = data[start] == 45
    value, bad = numbers(data, start + minus, end)
    faulty |= bad | (value > np.uint64((1 << 63) - 1))
    out["score"] = np.where(minus, -1, 1) * np.where(value > np.uint64((1 << 63) - 1), 0, value).astype(np.int64)
    explicit = n > 12
    value, bad = numbers(data, *span(12))
    faulty |= explicit & bad
    return out | {"id": np.where(explicit, value, 0).astype(np.uint64), "id_explicit": explicit}, faulty


@dataclass(frozen=True)
class Options:
    """metadata: whether notes are allowed. need_id: whether a header must have an id. wanted: of chains whose headers it rejects (an array of booleans for their columns), block lines are passed over unread and `blocks` is null."""

    metadata: bool = True
    need_id: bool = False
    wanted: Callable[[Headers], np.ndarray] | None = None


def items(lines: Lines, base: int, options: Options, number: int | None, texts: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[pa.Table, int | None, bool]:
    """Notes and chains of lines that begin outside any record, in order; the next number; whether a fault ended them.

    base: the offset of the lines' first byte. number: what the first header without an
    id gets, later ones the next numbers. A fault is given as an item with an error.
    texts: where texts that are read as one begin, blank lines between them, and their
    bytes; then a fault ends the items of its own text only.
    """
    after = inside_after(lines, False)
    inside = np.concatenate(([False], after[:-1]))
    place = np.arange(len(lines))
    head, note = np.flatnonzero(~inside & ~lines.blank & ~lines.note), np.flatnonzero(~inside & lines.note)
    found, faulty = headers(lines, head, options.need_id)
    faults = [(head[faulty], lambda i: header_fault(lines.text(i), options.need_id))]
    if not options.metadata:
        faults.append((note, lambda i: "metadata line"))
    read = np.ones(len(head), bool) if options.wanted is None else np.asarray(options.wanted(found), bool)
    blanks = np.flatnonzero(lines.blank)
    close = np.searchsorted(blanks, head)
    last = np.where(close < len(blanks), blanks[np.minimum(close, len(blanks) - 1)] if len(blanks) else 0, len(lines) - 1)  # the line that ends each record
    if texts is not None:
        text_of = lambda at: np.searchsorted(texts[0], lines.starts[at] + base, side="right") - 1
        own = np.searchsorted(lines.starts + base, texts[0] + texts[1]) - 1  # a text's last line
        last = np.minimum(last, own[text_of(head)])
    body = place[inside & ~lines.blank]
    record = np.searchsorted(head, body, side="right") - 1
    body, record = body[read[record]], record[read[record]]
    n = lines.n_words[body]
    values = np.zeros((3, len(body)), np.int64)
    bad = n == 2
    for k in range(3):
        at = np.flatnonzero(n >= 3) if k else np.arange(len(body))
        word = lines.first[body[at]] + k
        value, wrong = numbers(lines.data, lines.word[word], lines.word_end[word])
        bad[at] |= wrong | (value > MAX_U32)
        values[k, at] = value.astype(np.int64)
    faults.append((body[bad], lambda i: block_fault(lines.text(i))))
    sizes = np.bincount(record, minlength=len(head)) if len(head) else np.zeros(0, np.int64)
    faults.append((last[read & (sizes == 0)], lambda i: "chain without any alignment blocks"))
    if texts is None:
        first = min((int(i[0]) for i, _ in faults if len(i)), default=len(lines))
        kept = np.arange(len(head)) < (int(np.searchsorted(last, first)) if first < len(lines) else len(head))
        wrong = [first] if first < len(lines) else []
        before = lambda at: at < first
    else:
        every = np.unique(np.concatenate([i for i, _ in faults]))
        owner, at = np.unique(text_of(every), return_index=True)
        firsts = np.full(len(texts[0]), len(lines))
        firsts[owner] = wrong = every[at]
        kept, wrong = last < firsts[text_of(head)], wrong.tolist()
        before = lambda at: at < firsts[text_of(at)]
    whole = int(kept.sum())
    pick = lambda v: v[:whole] if texts is None else v.filter(pa.array(kept)) if isinstance(v, pa.Array) else v[kept]
    if number is not None:
        missing = ~found["id_explicit"]
        ids = np.where(missing, np.uint64(number) + np.cumsum(missing).astype(np.uint64) - np.uint64(1), found["id"])
        number += int(missing.sum())
        ids = pa.array(pick(ids)).cast(pa.decimal128(20, 0))
    else:
        ids = pa.array(pick(found["id"]), mask=~pick(found["id_explicit"])).cast(pa.decimal128(20, 0))
    ends = np.cumsum(pick(np.where(read, sizes, 0)))
    some = slice(int(ends[-1]) if whole else 0) if texts is None else kept[record]
    pairs = pa.StructArray.from_arrays([pa.array(v[some]) for v in values], names=["size", "gap_reference", "gap_query"])
    unread = np.append(~pick(read), False)
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32), mask=unread)
    columns = {c: pick(v if isinstance(v, pa.Array) else pa.array(v)) for c, v in found.items()}
    begin = lines.starts[pick(head)]
    columns |= {"id": ids, "kind": pa.array(np.full(whole, "chain", object), pa.string()), "offset": pa.array(begin + base), "length": pa.array(lines.past[pick(last)] - begin), "blocks": pa.ListArray.from_arrays(offsets, pairs)}
    tables = [_table(whole, columns)]
    note = note[before(note)] if options.metadata else note[:0]
    if len(note):
        end = lines.ends[note] - (lines.data[lines.ends[note] - 1] == 13)
        tables.append(_table(len(note), {"kind": pa.array(["meta"] * len(note)), "offset": pa.array(lines.starts[note] + base), "length": pa.array(lines.past[note] - lines.starts[note]), "line": strings(lines.data, lines.starts[note], end)}))
    if wrong:
        said: dict[int, str] = {}
        for i, say in faults:
            said |= {x: say(x) for x in i[np.isin(i, wrong)].tolist() if x not in said}
        at = pa.array(lines.starts[wrong] + base)
        tables.append(_table(len(wrong), {"kind": pa.array(["error"] * len(wrong)), "offset": at, "error": pa.array([said[x] for x in wrong]), "error_offset": at}))
    out = tables[0] if len(tables) == 1 else pa.concat_tables(tables).combine_chunks()
    if len(tables) > 1:
        out = out.take(pa.array(np.argsort(out.column("offset").to_numpy(), kind="stable")))
    return out, number, bool(wrong) and texts is None


def _ahead(at: int, stop: int | None, window: int) -> int:
    """The bytes to read from there: a window, less where stop is near, since all that is read is divided into lines."""
    return window if stop is None else min(window, max(stop - at, 0) + SLACK)


def windows(stream, at: int, stop: int | None, inside: bool, with_words: bool = True, window: int | None = None) -> Iterator[tuple[Lines, int]]:
    """(lines, offset of the first) of whole records, in order, as they are read: those that begin before stop.

    at: the stream's offset, where a line begins. inside: it lies in a record that
    belongs to what precedes it, so all up to a blank line is passed over. What is held
    is a window and the record that it cuts.
    """
    held, window = b"", window or WINDOW
    while True:
        piece = stream.read(max(_ahead(at + len(held), stop, window), len(held)))
        data = np.frombuffer(held + piece, np.uint8)
        lines, last = lines_of(data, not piece, with_words), not piece
        low, n = 0, len(lines)
        if inside:
            blank = np.flatnonzero(lines.blank)
            low = int(blank[0]) + 1 if len(blank) else n
            inside = not len(blank)
            if stop is not None and low and at + lines.starts[low - 1] >= stop:
                return
        if low < n:
            lines = _part(lines, low, n)
            after = inside_after(lines, False)
            closed = np.flatnonzero(~after)
            n = len(lines) if last else int(closed[-1]) + 1 if len(closed) else 0
            if stop is not None:  # the first line from stop on that no record is open before
                over = np.flatnonzero((lines.starts + at >= stop) & ~np.concatenate(([False], after[:-1])))
                if len(over):
                    n, last = min(n, int(over[0])), True
            if n:
                yield _part(lines, 0, n), at
            done = int(lines.past[n - 1]) if n else int(lines.starts[0])
        else:
            done = int(lines.past[n - 1]) if n else 0
        if last:
            return
        held, at = data[done:].tobytes(), at + done


def _part(lines: Lines, low: int, high: int) -> Lines:
    if low == 0 and high == len(lines):
        return lines
    some = slice(low, high)
    worded = lines.first[some], lines.n_words[some]
    return Lines(lines.data, lines.starts[some], lines.ends[some], lines.past[some], lines.word, lines.word_end, *worded, lines.blank[some], lines.note[some])


def parsed(stream, at: int, stop: int | None = None, inside: bool = False, options: Options = Options(), number: int | None = None, window: int | None = None, batch_rows: int | None = BATCH_ROWS, texts: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the stream's notes and chains, in order, as windows() gives their lines; a fault is the last item (texts: see items())."""
    for lines, base in windows(stream, at, stop, inside, window=window):
        out, number, ended = items(lines, base, options, number, texts)
        yield from out.to_batches(batch_rows)
        if ended:
            return


def records(lines: Lines, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of the records of lines that begin outside any, the blank line that ends each included."""
    after = inside_after(lines, False)
    head = np.flatnonzero(~np.concatenate(([False], after[:-1])) & after)
    blanks = np.append(np.flatnonzero(lines.blank), len(lines) - 1)
    last = blanks[np.minimum(np.searchsorted(blanks[:-1], head), len(blanks) - 1)]
    return lines.starts[head] + base, lines.past[last] - lines.starts[head]


def without_id(lines: Lines) -> int:
    """How many headers of lines that begin outside any record have no id; only the headers' words are found."""
    after = inside_after(lines, False)
    head = np.flatnonzero(~np.concatenate(([False], after[:-1])) & after)
    dark = _dark(lines.data)
    dark[1:] &= ~dark[:-1]  # where words start
    word = np.flatnonzero(dark)
    return int((np.searchsorted(word, lines.ends[head]) - np.searchsorted(word, lines.starts[head]) < 13).sum())


@dataclass
class Scan:
    """What the lines that begin in a range do to a scan of records, for either state before them (outside: 0, in a record: 1): the state after them, the first fault or None, and how many records begin; and where the first and the last record begin, -1 if none does."""

    after: list[int]
    fault: list[tuple[int, str] | None]
    starts: list[int]
    first: list[int]


def scanned(stream, at: int, stop: int | None, metadata: bool = True, window: int | None = None) -> tuple[Scan, np.ndarray, np.ndarray]:
    """The scan of the lines that begin from `at` (a line's start) up to stop; offsets where records begin if none is open before, and which of them begin also if one is.

    Outside a record a line must be blank, a note, or begin with `chain `; in one it
    must neither be a note nor begin with `chain `. States differ only up to the first
    line that is no note: after it the state is known.
    """
    kinds, offsets = [], []
    held, window = b"", window or WINDOW
    here = at
    while True:
        piece = stream.read(max(_ahead(here + len(held), stop, window), len(held)))
        data = np.frombuffer(held + piece, np.uint8)
        lines = lines_of(data, not piece, with_words=False)
        n = len(lines) if stop is None else int(np.searchsorted(lines.starts + here, stop))
        if n:
            named = np.flatnonzero(lines.ends[:n] - lines.starts[:n] >= 6)
            for k, c in enumerate(b"chain "):
                named = named[data[lines.starts[named] + k] == c]
            tag = np.zeros(n, bool)
            tag[named] = True
            kinds.append(np.where(lines.blank[:n], 0, np.where(lines.note[:n], 1, np.where(tag, 2, 3))).astype(np.int8))
            offsets.append(lines.starts[:n] + here)
        if not piece or n < len(lines):
            break
        done = int(lines.past[-1]) if n else 0
        held, here = data[done:].tobytes(), here + done
    kind = np.concatenate(kinds) if kinds else np.zeros(0, np.int8)
    offset = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    decisive = np.maximum.accumulate(np.where(kind == 1, -1, np.arange(len(kind))))
    out, begun = Scan([], [], [], []), []
    for entry in (0, 1):
        after = np.where(decisive < 0, entry, kind[decisive] > 1) if len(kind) else np.zeros(0, np.int64)
        before = np.concatenate(([entry], after[:-1])).astype(bool)
        wrong = np.flatnonzero(np.where(before, (kind == 1) | (kind == 2), (kind == 3) | ((kind == 1) & (not metadata)))) if len(kind) else []
        says = {(0, 3): "expected a chain header or metadata line", (0, 1): "metadata line", (1, 1): "metadata line inside chain record", (1, 2): "missing blank line between chain records"}
        out.fault.append((int(offset[wrong[0]]), says[int(before[wrong[0]]), int(kind[wrong[0]])]) if len(wrong) else None)
        out.after.append(int(after[-1]) if len(kind) else entry)
        begun.append(offset[(kind == 2) & ~before] if len(kind) else offset)
        out.starts.append(len(begun[-1]))
        out.first.append(int(begun[-1][0]) if len(begun[-1]) else -1)
    return out, *begun
