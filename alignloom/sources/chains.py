"""Chain text as rows: byte ranges of files are parsed by tasks of their own."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.operators.ordering import generated_ids
from alignloom.schema import ITEMS
from alignloom.sources import blocked, scan
from alignloom.storage import fresh, opened

#: A range's bytes where none are named: 0, so that they follow from the files' size; then at least and at most so many.
RANGE_BYTES, LEAST_BYTES, MOST_BYTES = 0, 4 << 20, 64 << 20
#: Ranges that files are cut into at most, unless they would exceed MOST_BYTES, as each task is sent the list of them; tasks where the cores are unknown.
MOST_RANGES, TASKS = 1024, 64
_LENGTHS = pa.schema([("file_no", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("ordinal", pa.int64()), ("start", pa.int64()), ("reach", pa.int64())])


def line_at(raw, low: int, window: int = 1 << 16) -> int:
    """Where the first line begins that begins at low (1 or more) or after."""
    raw.seek(low - 1)
    start = low - 1
    while piece := raw.read(window):
        cut = piece.find(b"\n")
        start += len(piece) if cut < 0 else cut + 1
        if cut >= 0:
            break
    return start


def is_folder(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def begins_inside(raw, low: int, window: int = 1 << 16) -> tuple[int, bool]:
    """Of a byte stream, the first line that begins at low or after, and whether it lies in a record that begins before it.

    Looks back from there to the nearest blank line (a record may follow) through
    metadata lines, which tell nothing: any other line is part of a record.
    """
    start = line_at(raw, low, window)
    held, at = b"", start
    while True:
        step = min(window, at)
        at -= step
        raw.seek(at)
        held = raw.read(step) + held
        before = held.split(b"\n")[:-1]  # held ends with the newline before start, or the stream ends at start without one
        if held and not held.endswith(b"\n"):
            before = held.split(b"\n")
        whole = before if at == 0 else before[1:]  # the first may be cut
        for line in reversed(whole):
            if not scan.words(line):
                return start, False
            if not line.startswith(b"#"):
                return start, True
        if at == 0:
            return start, False
        window *= 2


def parse_bytes(data: bytes, number: int | None = None, **options) -> list[dict]:
    """The notes and chains of text in memory, and the fault that ends them, without columns that are null; gzip is recognised."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    rows = [r for batch in scan.parsed(io.BytesIO(data), 0, options=scan.Options(**options), number=number) for r in batch.to_pylist()]
    return [{k: v for k, v in r.items() if v is not None} for r in rows]


def from_bytes(spark: SparkSession, data: bytes, piece: int = 4 << 20) -> DataFrame:
    """The chains of text in memory (gzip is recognised): it is written to the shared folder once and read from there."""
    path = fresh(spark, "bytes")
    system, inner = opened(path)
    with system.open_output_stream(inner, compression=None) as out:
        out.write(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    return read(spark, path, range_bytes=piece)


def ranges_of(paths: str | list[str], range_bytes: int = RANGE_BYTES) -> list[tuple[int, str, bool | blocked.Index, int, int]]:
    """(file_no, path, packing, low, high): byte ranges of texts. packing: False, True for gzip, which is one range as its format cannot be entered elsewhere, or the index of gzip in blocks, which can (listing them needs a session). Ranges of large files are longer than range_bytes where there would be more than MOST_RANGES."""
    out, named = [], [paths] if isinstance(paths, str) else paths
    sizes = [system.get_file_info(inner).size for system, inner in map(opened, named)]
    if None in sizes:
        raise FileNotFoundError(named[sizes.index(None)])
    session = SparkSession.getActiveSession()
    if not range_bytes:  # four ranges for each core, as far as they are neither tiny nor huge
        cores = 1 if session is None else session.sparkContext.defaultParallelism
        range_bytes = MOST_BYTES if session is None else min(max(sum(sizes) // (4 * cores), LEAST_BYTES), MOST_BYTES)
    files = []
    for file_no, (path, size) in enumerate(zip(named, sizes)):
        system, inner = opened(path)
        place = path if ":" in path else inner
        with system.open_input_file(inner) as stream:
            head = stream.read(18)
        packed: bool | blocked.Index = path.endswith(".gz") or head[:2] == b"\x1f\x8b"
        if packed and blocked.length_at(head, 0) and session is not None:
            packed = blocked.index(session, place, size)
            size = packed.size
        files.append((file_no, place, packed, size))
    text = sum(size for _, _, packed, size in files if packed is not True)
    range_bytes = max(range_bytes, min(-(-text // MOST_RANGES), MOST_BYTES))
    for file_no, place, packed, size in files:
        step = max(size, 1) if packed is True else range_bytes
        out += [(file_no, place, packed, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
    return out


def _opened(path: str, packed: bool | blocked.Index, low: int, stack: ExitStack) -> tuple[io.BufferedIOBase, int, bool]:
    """(stream, offset, inside) at the first line that begins in a range."""
    stream = _stream(path, packed, stack)
    start, inside = begins_inside(stream, low) if low else (0, False)
    stream.seek(start)
    return stream, start, inside


def _stream(path: str, packed: bool | blocked.Index, stack: ExitStack):
    """A file's text."""
    system, inner = opened(path)
    raw = stack.enter_context(system.open_input_file(inner))
    return gzip.GzipFile(fileobj=raw) if packed is True else blocked.Reader(raw, packed) if packed else raw


def over_ranges(spark: SparkSession, ranges: list[tuple], of: Callable[[int, ExitStack], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What `of` gives for each range, in order; a task has some neighbouring ranges, few bytes or one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with ExitStack() as stack:
                    yield from of(i, stack)

    return spark.range(0, len(ranges), 1, tasks_for(ranges, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, ddl)


def tasks_for(ranges: list[tuple], least: int = TASKS) -> int:
    """How many tasks share the ranges: `least`, or more so that none has much more than MOST_BYTES, or one for each range."""
    text = sum(high - low for *_, low, high in ranges)
    return min(len(ranges), max(least, -(-text // MOST_BYTES)))


def items_of(span: tuple, options: scan.Options, number: int | None, stack: ExitStack, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The items of the records that begin in a range of ranges_of(); whole: a batch for each window, as options.wanted sees it."""
    file_no, path, packed, low, high = span
    stream, start, inside = _opened(path, packed, low, stack)
    for part in scan.parsed(stream, start, None if packed is True else high, inside, options, number, batch_rows=None if whole else scan.BATCH_ROWS):
        files = pa.array(np.full(part.num_rows, file_no, np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0), files, *part.columns[1:]], names=["kind", "file_no", *part.schema.names[1:]])


def read_items(spark: SparkSession, paths: str | list[str], metadata: bool = True, need_id: bool = False, range_bytes: int = RANGE_BYTES, wanted: Callable[[scan.Headers], np.ndarray] | None = None, numbers: list[int] | None = None) -> DataFrame:
    """All items of the files in one DataFrame; file_no and offset give their order, which partitions and their rows have too.

    A task parses the records that begin in its range, whatever the cut, as a reading
    of the whole file would (after a fault, a later range may still give items;
    `checked` fails). Tasks open files by their URI. wanted: see scan.Options; numbers:
    of each range, the number that its first header without an id gets.
    """
    ranges, options = ranges_of(paths, range_bytes), scan.Options(metadata, need_id, wanted)
    return over_ranges(spark, ranges, lambda i, stack: items_of(ranges[i], options, None if numbers is None else numbers[i], stack), ITEMS)


def numbering(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> list[int]:
    """For each range the number of its first header without an id: 1, 2, ... through the files. Only the words of headers are counted."""
    ranges = ranges_of(paths, range_bytes)

    def of(i: int, stack: ExitStack) -> Iterator[pa.RecordBatch]:
        _, path, packed, low, high = ranges[i]
        stream, start, inside = _opened(path, packed, low, stack)
        n = sum(scan.without_id(lines) for lines, _ in scan.windows(stream, start, None if packed is True else high, inside, with_words=False))
        yield pa.RecordBatch.from_pydict({"i": [i], "n": [n]})

    found = {r["i"]: r["n"] for r in over_ranges(spark, ranges, of, "i bigint, n bigint").collect()}
    return [1, *accumulate((found[i] for i in range(len(ranges))), initial=1)][1:]


def numbered_items(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The items of the files, those without an id numbered in file order."""
    return read_items(spark, paths, range_bytes=range_bytes, numbers=numbering(spark, paths, range_bytes))


def checked(found: DataFrame) -> DataFrame:
    """The items; a faulty one fails the job."""
    message = F.concat(F.col("error"), F.lit(" at offset "), F.col("error_offset").cast("string"))
    return found.filter(F.when(F.col("error").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))


def chains(found: DataFrame, generate: bool = True) -> DataFrame:
    """The chains among items; those without an id are numbered in file order."""
    rows = checked(found).filter("kind = 'chain'").drop("kind", "length", "line", "error", "error_offset")
    return generated_ids(rows) if generate else rows


def read(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES, **options) -> DataFrame:
    """The chains of the files, in file order, those without an id numbered as they are read."""
    return chains(read_items(spark, paths, range_bytes=range_bytes, numbers=numbering(spark, paths, range_bytes), **options), False)


def metadata(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'meta'").select("file_no", "offset", "line")


def path_list(text: str) -> list[str]:
    """A path for each line that is not blank."""
    out = [line.strip() for line in text.splitlines() if line.strip()]
    if not out:
        raise ValueError("the list names no path")
    return out


def entries(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES, metadata: bool = True) -> list[tuple[bool, int, int | None]]:
    """For each range: whether a record is open before its first line, the number of records that begin before it through the files, and where the next record after it begins (None: none in the file).

    A scan of records is an automaton of two states. Each task gives what its range does
    to either (scan.Scan); these are composed here, a few numbers a range, in order. The
    first fault that the true states meet is an error.
    """
    ranges = ranges_of(paths, range_bytes)
    pairs = "array<bigint>"
    shape = pa.schema([("i", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("after", "starts", "first", "fault_at")], ("fault", pa.list_(pa.string()))])

    def of(i: int, stack: ExitStack) -> Iterator[pa.RecordBatch]:
        _, path, packed, low, high = ranges[i]
        stream = _stream(path, packed, stack)
        at = line_at(stream, low) if low else 0
        stream.seek(at)
        found = scan.scanned(stream, at, None if packed is True else high, metadata)[0]
        row = {"i": i, "after": found.after, "starts": found.starts, "first": found.first, "fault_at": [f[0] if f else -1 for f in found.fault], "fault": [f[1] if f else None for f in found.fault]}
        yield pa.RecordBatch.from_pylist([row], schema=shape)

    rows = over_ranges(spark, ranges, of, f"i bigint, after {pairs}, starts {pairs}, first {pairs}, fault_at {pairs}, fault array<string>").collect()
    out, state, count, before = [], 0, 0, None
    for row, (file_no, path, *_) in zip(sorted(rows, key=lambda r: r["i"]), ranges):
        state, before = state if file_no == before else 0, file_no
        if row["fault"][state] is not None:
            raise ValueError(f"{row['fault'][state]} at byte {row['fault_at'][state]} of {path}")
        out.append((bool(state), count, row["first"][state]))
        state, count = row["after"][state], count + row["starts"][state]
    ahead: dict[int, int] = {}
    for i in range(len(ranges) - 1, -1, -1):
        inside, count, first = out[i]
        out[i] = (inside, count, ahead.get(ranges[i][0]))
        if first >= 0:
            ahead[ranges[i][0]] = first
    return out


def spans(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES, metadata: bool = True) -> DataFrame:
    """(file_no, offset, length, ordinal, start, reach) of every record, in order: its bytes, the blank line after it included, and its number from 0 through the files.

    start and reach: the bytes from the record to the next one; a file's first has all
    before it too, and the last one's reach is null. No rows are shuffled, sorted or
    joined: a range's numbers and its neighbours' places follow from entries(), which
    also refuses text that is no sequence of records.
    """
    known, ranges = entries(spark, paths, range_bytes, metadata), ranges_of(paths, range_bytes)

    def of(i: int, stack: ExitStack) -> Iterator[pa.RecordBatch]:
        file_no, path, packed, low, high = ranges[i]
        inside, count, ahead = known[i]
        stream = _stream(path, packed, stack)
        at = line_at(stream, low) if low else 0
        stream.seek(at)
        found = [scan.records(lines, base) for lines, base in scan.windows(stream, at, None if packed is True else high, inside, with_words=False)]
        offset, length = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        ordinal = count + np.arange(len(offset))
        begin = offset.copy()
        if len(begin) and (i == 0 or ranges[i - 1][0] != file_no or count == _first_of_file(known, ranges, file_no)):
            begin[0] = 0
        last = np.append(offset[1:], -1 if ahead is None else ahead)[: len(offset)]
        reach = pa.array(last - begin, mask=last < 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(offset), file_no, np.int32)), pa.array(offset), pa.array(length), pa.array(ordinal), pa.array(begin), reach], schema=_LENGTHS)

    return over_ranges(spark, ranges, of, "file_no int, offset bigint, length bigint, ordinal bigint, start bigint, reach bigint")


def raw(spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(ordinal, record) of every record: its bytes, the blank line after it included, as the range's task reads them."""
    found = spans(spark, paths, range_bytes)
    named = [paths] if isinstance(paths, str) else list(paths)
    shape = pa.schema([("ordinal", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                files = part.column(0).to_numpy()
                for file_no in np.unique(files).tolist():
                    some = part.filter(pa.array(files == file_no))
                    offset, length = (some.column(k).to_numpy() for k in (1, 2))
                    low = int(offset[0])
                    body = read_range(named[file_no], low, int(offset[-1] + length[-1]) - low)
                    pieces = [body[a - low : a - low + n] for a, n in zip(offset.tolist(), length.tolist())]
                    yield pa.RecordBatch.from_arrays([some.column(3), pa.array(pieces, pa.binary())], schema=shape)

    return found.select("file_no", "offset", "length", "ordinal").mapInArrow(run, "ordinal bigint, record binary")


def together(bodies: list[bytes], options: scan.Options) -> tuple[pa.Table, np.ndarray]:
    """The items of some texts, read as one with blank lines between them, and whose each is; a fault ends its own text only."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 2)))
    found = pa.Table.from_batches(scan.parsed(io.BytesIO(b"\n\n".join(bodies)), 0, options=options, texts=(begin[:-1], sizes)), scan.schema())
    of = np.searchsorted(begin, found["offset"].to_numpy(), side="right") - 1
    failed = np.flatnonzero(np.asarray(found["error"].is_valid()))
    first = np.full(len(bodies), found.num_rows)
    np.minimum.at(first, of[failed], failed)
    kept = np.arange(found.num_rows) <= first[of]  # a text of several windows may go on behind its fault
    found, of = found.filter(pa.array(kept)), of[kept]
    offset, length, fault = (found[c].to_pandas().to_numpy() for c in ("offset", "length", "error_offset"))
    own = np.minimum(offset + length, begin[of] + sizes[of]) - offset  # without the lines between
    for name, values in (("offset", offset - begin[of]), ("length", own), ("error_offset", fault - begin[of])):
        whole = pa.array(values, pa.int64(), from_pandas=True) if values.dtype != np.float64 else pa.array(np.nan_to_num(values).astype(np.int64), mask=np.isnan(values))
        found = found.set_column(found.schema.get_field_index(name), name, whole)
    return found, of


def of_texts(rows: DataFrame, key: str, text: str, **options) -> DataFrame:
    """`of` (the row's key) and the items (see read_items) of each row's text, in which offsets count; a null text has none, and a fault ends its own text only."""
    kind, how = rows.schema[key].dataType.simpleString(), scan.Options(**options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [(body or "").encode() for body in batch.column(1).to_pylist()]
            ends = np.cumsum([len(b) for b in bodies])
            at = 0
            while at < len(bodies):  # texts of a window's bytes, or one longer
                low = int(ends[at - 1]) if at else 0
                after = max(at + 1, int(np.searchsorted(ends, low + scan.WINDOW, side="right")))
                table, of = together(bodies[at:after], how)
                out = table.add_column(0, "of", batch.column(0).take(pa.array(at + of))).combine_chunks()
                yield from out.to_batches(scan.BATCH_ROWS)
                at = after

    ddl = ", ".join(c for c in ITEMS.split(", ") if not c.startswith("file_no"))
    return rows.select(key, text).mapInArrow(run, f"of {kind}, {ddl}")


def _first_of_file(known: list[tuple], ranges: list[tuple], file_no: int) -> int:
    """The number of records before a file."""
    return next(count for (_, count, _), span in zip(known, ranges) if span[0] == file_no)


def no_blocks(headers: scan.Headers) -> np.ndarray:
    return np.zeros(len(headers["score"]), bool)


def chain_bytes(spark: SparkSession, paths: str | list[str], index: DataFrame, ordinal: int) -> bytes | None:
    """The bytes of the record of that ordinal in an index by spans(); None beyond the last. Only they are read."""
    found = index.filter(F.col("ordinal") == ordinal).first()
    if found is None:
        return None
    path = ([paths] if isinstance(paths, str) else paths)[found["file_no"]]
    return bytes(read_range(path, found["offset"], found["length"]))


def read_range(path: str, offset: int, length: int) -> bytes:
    """Those bytes of a file's text; a gzip file is read up to them."""
    with ExitStack() as stack:
        stream = text_stream(path, stack)
        stream.seek(offset)
        return stream.read(length)


def text_stream(path: str, stack: ExitStack) -> io.BufferedIOBase:
    """A file's text, gzip recognised; its listed blocks are not looked at."""
    system, inner = opened(path)
    raw = stack.enter_context(system.open_input_file(inner))
    packed = path.endswith(".gz") or raw.read(2) == b"\x1f\x8b"
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if packed else raw
