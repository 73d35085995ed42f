"""Sequences from FASTA and 2bit files, as rows and in chunks."""

from __future__ import annotations

import gzip
import io
import re
import struct
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.sources import fasta
from alignloom.storage import opened

#: Bases of a chunk.
CHUNK = 1 << 16
#: Fixed value of the public 2bit format.
TWOBIT = 0x1A412743


def sniff(data: bytes) -> str:
    """gzip, 2bit or fasta, by a file's first bytes."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] in (struct.pack("<I", TWOBIT), struct.pack(">I", TWOBIT)):
        return "2bit"
    if data[:1] == b">":
        return "fasta"
    raise ValueError("neither gzip, 2bit nor FASTA")


def from_fasta(stream) -> Iterator[tuple[int, str, int, str]]:
    """(record, name, chunk number, bases) of a binary stream: a name is its header's first word; lines are joined, whatever their lengths, and leave in chunks."""
    record, name, held, size, number = -1, None, [], 0, 0
    for raw in stream:
        line = raw.decode("latin-1").rstrip("\n").removesuffix("\r")
        if line.startswith(">"):
            if name is not None and (held or not number):
                yield record, name, number, "".join(held)
            words = line[1:].split()
            if not words:
                raise ValueError("FASTA record without a name")
            record, name, held, size, number = record + 1, words[0], [], 0, 0
        elif part := "".join(line.split()):
            if name is None:
                raise ValueError("FASTA data before the first header")
            held.append(part)
            size += len(part)
            if size >= CHUNK:
                whole = "".join(held)
                for at in range(0, size - size % CHUNK, CHUNK):
                    yield record, name, number, whole[at : at + CHUNK]
                    number += 1
                held, size = [whole[size - size % CHUNK :]] if size % CHUNK else [], size % CHUNK
    if name is None:
        raise ValueError("FASTA without records")
    if held or not number:
        yield record, name, number, "".join(held)


def twobit_index(stream) -> tuple[str, list[tuple[str, int]]]:
    """The byte order of a 2bit stream and (name, offset) of its records; nothing else is read."""
    head = stream.read(16)
    order = "<" if struct.unpack_from("<I", head)[0] == TWOBIT else ">"
    magic, version, count, _ = struct.unpack_from(f"{order}4I", head)
    if magic != TWOBIT or version != 0:
        raise ValueError("not a 2bit file of version 0")
    out = []
    for _ in range(count):
        name = stream.read(stream.read(1)[0]).decode("latin-1")
        out.append((name, struct.unpack(f"{order}I", stream.read(4))[0]))
    return order, out


def from_twobit(stream, order: str, offset: int, bins: list[int] | None = None) -> Iterator[tuple[int, str]]:
    """(chunk number, bases) of the record at an offset: N blocks as N, mask blocks in lower case; a chunk is read at a time. bins: the only chunks that are read; those beyond the record are left out."""
    stream.seek(offset)
    number = lambda: struct.unpack(f"{order}I", stream.read(4))[0]
    size, ranges, at = number(), [], offset + 4
    for _ in range(2):
        n = number()
        ranges.append(np.frombuffer(stream.read(8 * n), f"{order}u4").reshape(2, n).astype(np.int64))
        at += 4 + 8 * n
    at += 4  # a reserved number
    letters, shifts = np.frombuffer(b"TCAG", np.uint8), np.array([6, 4, 2, 0], np.uint8)
    for low in range(0, max(size, 1), CHUNK) if bins is None else (CHUNK * k for k in bins if CHUNK * k < max(size, 1)):
        n = min(CHUNK, size - low)
        stream.seek(at + low // 4)
        packed = np.frombuffer(stream.read(-(-n // 4)), np.uint8)
        bases = letters[(packed[:, None] >> shifts) & 3].reshape(-1)[:n].copy()
        starts, lengths = ranges[0]
        for i in _crossing(starts, lengths, low, n):
            bases[max(starts[i] - low, 0) : starts[i] + lengths[i] - low] = ord("N")
        starts, lengths = ranges[1]
        for i in _crossing(starts, lengths, low, n):
            bases[max(starts[i] - low, 0) : starts[i] + lengths[i] - low] |= 0x20
        yield low // CHUNK, bases.tobytes().decode("latin-1")


def _crossing(starts: np.ndarray, lengths: np.ndarray, low: int, n: int) -> range:
    """Which of the ascending, disjoint ranges meet the n places from low."""
    return range(int(np.searchsorted(starts + lengths, low, "right")), int(np.searchsorted(starts, low + n)))


def to_twobit(records: dict[str, str]) -> bytes:
    """A 2bit file of the records, little-endian."""
    runs = lambda text, test: [(m.start(), m.end() - m.start()) for m in re.finditer(test, text)]
    head, bodies, at = struct.pack("<4I", TWOBIT, 0, len(records), 0), [], 16 + sum(5 + len(n) for n in records)
    code = {"T": 0, "C": 1, "A": 2, "G": 3}
    for name, text in records.items():
        body = struct.pack("<I", len(text))
        for found in (runs(text, "[nN]+"), runs(text, "[a-z]+")):
            body += struct.pack("<I", len(found)) + b"".join(struct.pack(f"<{len(found)}I", *x) for x in zip(*found))
        values = [code.get(c, 0) for c in text.upper()] + [0] * (-len(text) % 4)
        body += struct.pack("<I", 0) + bytes(a << 6 | b << 4 | c << 2 | d for a, b, c, d in zip(*[iter(values)] * 4))
        head += bytes([len(name)]) + name.encode("latin-1") + struct.pack("<I", at)
        at += len(body)
        bodies.append(body)
    return head + b"".join(bodies)


#: Chunks of a record that a task of load_bins() takes.
STRETCH = 256
#: Up to so many names are handed to the 2bit decoder; beyond, whole files are decoded and a join leaves the named.
MOST_NAMES = 100_000


def _plan(paths: list[str], names: set[str] | None) -> list[tuple[int, str, str, int, str | None, int]]:
    """(file_no, path, kind or byte order, record, name, offset): a FASTA file is one row (plain fasta if it is not packed), a 2bit file one for each (named) record."""
    out = []
    for file_no, path in enumerate(paths):
        system, inner = opened(path)
        if system.get_file_info(inner).size is None:
            raise FileNotFoundError(path)
        with system.open_input_file(inner) as raw:
            head = raw.read(4)
            kind = sniff(head)
            kind = "plain fasta" if kind == "fasta" else kind
            if kind == "gzip":
                raw.seek(0)
                kind = "fasta" if sniff(gzip.GzipFile(fileobj=raw).read(4)) == "fasta" else "packed 2bit"
            if kind == "2bit":
                raw.seek(0)
                order, records = twobit_index(raw)
                out += [(file_no, path, order, i, n, at) for i, (n, at) in enumerate(records) if names is None or n in names]
            else:
                out.append((file_no, path, kind, 0, None, 0))
    return out


def load(spark: SparkSession, path: str | list[str], side: str, names: DataFrame | None = None, range_bytes: int | None = None) -> DataFrame:
    """(side, name, bin, seq) of the files' sequences, in chunks; names (a DataFrame of `name`) restricts them.

    Files are told apart by their first bytes, whatever they are called. FASTA is read by
    byte ranges (a gzip file is streamed by one task); each record of a 2bit file is a
    task's own, and of named ones no other is read. The same name twice: the last file's, and in a file the last
    record's, sequence counts.
    """
    wanted = None if names is None else names.select("name").distinct()
    few = None if wanted is None else [r["name"] for r in wanted.limit(MOST_NAMES + 1).collect()]
    known = set(few) if few is not None and len(few) <= MOST_NAMES else None
    plan = _plan([path] if isinstance(path, str) else path, known)
    schema = pa.schema([("file_no", pa.int32()), ("record", pa.int32()), ("name", pa.string()), ("bin", pa.int64()), ("seq", pa.string())])

    def chunks(row: dict) -> Iterator[tuple]:
        system, inner = opened(row["path"])
        with system.open_input_file(inner) as raw:
            if row["kind"] in "<>":
                for number, text in from_twobit(raw, row["kind"], row["offset"]):
                    yield row["record"], row["name"], number, text
                return
            packed = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            stream = gzip.GzipFile(fileobj=raw) if packed else io.BufferedReader(raw, 1 << 20)
            if row["kind"] == "fasta":
                yield from from_fasta(stream)
                return
            plain = io.BytesIO(stream.read())  # a compressed 2bit file has no way in but whole
            order, records = twobit_index(plain)
            for i, (name, at) in enumerate(records):
                if known is None or name in known:
                    for number, text in from_twobit(plain, order, at):
                        yield i, name, number, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = chunks(row)
                while some := list(islice(found, 64)):
                    columns = [[row["file_no"]] * len(some), *zip(*some)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ranged = [(file_no, p) for file_no, p, kind, *_ in plan if kind == "plain fasta"]
    plan = [row for row in plan if row[2] != "plain fasta"]
    table = spark.createDataFrame(plan, "file_no int, path string, kind string, record int, name string, offset bigint")
    rows = table.repartition(max(1, min(len(plan), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "file_no int, record int, name string, bin bigint, seq string")
    if ranged:
        rows = rows.unionByName(fasta.read(spark, ranged, CHUNK, range_bytes))
    if wanted is not None:
        rows = rows.join(wanted, "name", "left_semi")
    last = rows.groupBy("name").agg(F.max(F.struct("file_no", "record")).alias("last"))
    kept = rows.join(last, "name").filter(F.struct("file_no", "record") == F.col("last"))
    return kept.select(F.lit(side).alias("side"), "name", "bin", "seq")


def load_bins(spark: SparkSession, path: str | list[str], side: str, needed: DataFrame, range_bytes: int | None = None) -> DataFrame:
    """load() of the chunks that needed (name, bin) has, and no others.

    Of 2bit files only those chunks' bytes are read: the wanted chunks meet the records
    of their names and are dealt to tasks by stretches of a record, so a long record is
    shared. Of other files all is read and the rest left out.
    """
    paths = [path] if isinstance(path, str) else list(path)
    wanted = needed.select("name", "bin").distinct()
    plan = _plan(paths, None)
    if any(kind not in "<>" for _, _, kind, *_ in plan):
        rows = load(spark, paths, side, wanted.select("name").distinct(), range_bytes)
        return rows.join(wanted, ["name", "bin"], "left_semi").select("side", "name", "bin", "seq")
    last = {name: row for row in plan for name in [row[4]]}  # the last file's, and in a file the last record's, counts
    table = spark.createDataFrame([(n, p, kind, at) for n, (_, p, kind, _, _, at) in last.items()], "name string, path string, kind string, offset bigint")
    met = wanted.join(table, "name").withColumn("stretch", F.expr(f"bin div {STRETCH}"))
    schema = pa.schema([("name", pa.string()), ("bin", pa.int64()), ("seq", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for (name, path, order, offset), some in groupby(rows, key=lambda r: (r["name"], r["path"], r["kind"], r["offset"])):
                system, inner = opened(path)
                with system.open_input_file(inner) as raw:
                    found = from_twobit(raw, order, offset, [r["bin"] for r in some])
                    while part := list(islice(found, 64)):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([k for k, _ in part], pa.int64()), pa.array([x for _, x in part])], schema=schema)

    laid = met.repartition("name", "stretch").sortWithinPartitions("name", "bin").select("name", "path", "kind", "offset", "bin")
    return laid.mapInArrow(run, "name string, bin bigint, seq string").select(F.lit(side).alias("side"), "name", "bin", "seq")


def chunked(sequences: DataFrame) -> DataFrame:
    """(side, name, bin, seq) of whole sequences (side, name, seq)."""
    bins = F.sequence(F.lit(0).cast("long"), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / CHUNK))
    return sequences.select("side", "name", "seq", F.explode(bins).alias("bin")).select("side", "name", "bin", F.substring(F.col("seq"), (F.col("bin") * CHUNK + 1).cast("int"), F.lit(CHUNK)).alias("seq"))


def fetch(sequences: DataFrame, side: str, name: str, start: int, length: int) -> str:
    """A stretch of one sequence; an absent name or a stretch beyond it is an error."""
    rows = sequences.filter((F.col("side") == side) & (F.col("name") == name) & F.col("bin").between(start // CHUNK, max(start + length - 1, start) // CHUNK)).orderBy("bin").collect()
    if not rows:
        raise KeyError(f"missing sequence {name}")
    text = "".join(r["seq"] for r in rows)[start - rows[0]["bin"] * CHUNK :][:length]
    if len(text) != length:
        raise ValueError(f"{name} ends before {start + length}")
    return text


def lengths(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("side", "name").agg(F.sum(F.length("seq")).cast("long").alias("length"))


def score_matrix(text: str) -> tuple[int, ...]:
    """The 16 scores, rows A, C, G, T, of a substitution matrix file.

    Comments (#) and settings (name=value, or name = value) may precede it; a line with
    the letters A C G T heads it; each of the next four lines holds four scores, with or
    without the row's letter.
    """
    lines = iter([w for w in (line.split("#")[0].split() for line in text.splitlines()) if w])
    head = next((w for w in lines if "=" not in "".join(w[:2])), None)
    if head is None:
        raise ValueError("the matrix file holds no matrix")
    if [w[:1] for w in head[:4]] != list("ACGT"):
        raise ValueError(f"the matrix is headed by {' '.join(head)}, not by A C G T")
    out: list[int] = []
    for letter in "ACGT":
        row = next(lines, None)
        if row is None:
            raise ValueError(f"the matrix ends before row {letter}")
        scores = row[len(row) == 5 :][:4]
        if len(scores) != 4:
            raise ValueError(f"row {letter} of the matrix has {len(scores)} scores")
        out += map(int, scores)
    return tuple(out)
