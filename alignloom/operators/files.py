"""Byte-faithful outputs: files put together from byte ranges of other files."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.operators import split
from alignloom.sources import blocked, chains
from alignloom.storage import fresh, opened

STEP, RANGE_BYTES = 8 << 20, 256 << 20


def guarded(inputs: list[str], output: str, overwrite: bool = False) -> None:
    """Refuses an output that is one of the inputs or that exists already (unless overwrite)."""
    place = lambda p: opened(p)[1].rstrip("/")
    system, inner = opened(output)
    if place(output) in map(place, inputs):
        raise ValueError("output and input are the same path")
    if not overwrite and system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(output)


def assemble(pieces: DataFrame, folder: str, gzipped: bool = False, stored: bool = False) -> DataFrame:
    """(name, bytes) of the files written to the folder: each the pieces (name, seq, path, offset, length, tail) in order of seq.

    A piece is a byte range of the text at path (of a gzip file, of what it holds),
    then the bytes of tail. One task writes a file, under a name of its own until it
    is whole, so lost tasks may be run again. gzipped: in blocks, which can be read by
    several tasks. stored: pieces are bytes of the files as they lie there.
    """
    schema = pa.schema([("name", pa.string()), ("bytes", pa.int64())])

    def ranges(path: str, offset: int, length: int, held: dict) -> Iterator[bytes]:
        system, inner = opened(path)
        if held.get("path") != path or held["at"] > offset:
            raw = system.open_input_file(inner)
            packed = not stored and raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            held.update(path=path, at=0, stream=gzip.GzipFile(fileobj=raw) if packed else raw)
        held["stream"].seek(offset)
        held["at"] = offset + length
        while length and (part := held["stream"].read(min(STEP, length))):
            length -= len(part)
            yield part
        if length:
            raise ValueError(f"{path} is shorter than its index says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        now, out, place, written, held = None, None, "", 0, {}

        def ended():
            out.close()
            system.move(place, f"{inner}/{now}")
            return pa.RecordBatch.from_pylist([{"name": now, "bytes": written}], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != now:
                    if now is not None:
                        yield ended()
                    now, written, place = row["name"], 0, f"{inner}/_{uuid.uuid4().hex}"
                    stream = system.open_output_stream(place, compression=None)
                    out = blocked.Writer(stream) if gzipped else stream
                for part in ranges(row["path"], row["offset"], row["length"], held):
                    out.write(part)
                    written += len(part)
                out.write(row["tail"] or b"")
                written += len(row["tail"] or b"")
        if now is not None:
            yield ended()

    system, inner = opened(folder)
    system.create_dir(inner)
    rows = pieces.select("name", "seq", "path", "offset", "length", F.col("tail").cast("binary"))
    tasks = 4 * pieces.sparkSession.sparkContext.defaultParallelism  # named, as few small rows may stand for many bytes
    return rows.repartition(tasks, "name").sortWithinPartitions("name", "seq").mapInArrow(run, "name string, bytes bigint")


def regions(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """(ordinal, file_no, offset, start, length): of each chain the bytes from its header to the next one's; a file's first has all before it too."""
    sizes = spark.createDataFrame([(i, _size(p)) for i, p in enumerate(paths)], "file_no int, size bigint")
    met = chains.spans(spark, paths, **options).join(F.broadcast(sizes), "file_no")  # one row a file
    return met.select("ordinal", "file_no", "offset", "start", F.coalesce("reach", F.col("size") - F.col("start")).alias("length"))


def _size(path: str) -> int:
    """The bytes of a file's text; a gzip file is read through."""
    system, inner = opened(path)
    with system.open_input_file(inner) as raw:
        if raw.read(2) != b"\x1f\x8b":
            return system.get_file_info(inner).size
        raw.seek(0)
        stream, size = gzip.GzipFile(fileobj=raw), 0
        while part := stream.read(STEP):
            size += len(part)
        return size


def _path_of(paths: list[str]) -> Column:
    return F.element_at(F.lit(list(paths)), F.col("file_no") + 1)


def split_files(spark: SparkSession, paths: list[str], folder: str, gzipped: bool = False, **how) -> DataFrame:
    """(name, bytes) of part.00001.<base>.chain[.gz], ...: the input's bytes, dealt as split() says; see there for `how`.

    Text before the first chain belongs to it, text after a chain to that chain, so
    metadata lines stay where they were. The folder must not exist.
    """
    guarded(paths, folder)
    owned = split.split(regions(spark, paths), **how)
    if not how.get("randomize"):  # a part's chains of one file lie there one after the other, so they are one piece, put together before any shuffle
        owned = owned.groupBy("part", "file_no").agg(F.min("ordinal").alias("ordinal"), F.min("start").alias("start"), F.sum("length").alias("length"))
    parts = owned.agg(F.max("part")).first()[0] + 1  # none is empty
    width, base = max(5, len(str(parts))), split.base_name(paths[0])
    name = F.concat(F.lit("part."), F.lpad((F.col("part") + 1).cast("string"), width, "0"), F.lit(f".{base}.chain{'.gz' if gzipped else ''}"))
    pieces = owned.select(name.alias("name"), F.col("ordinal").alias("seq"), _path_of(paths).alias("path"), F.col("start").alias("offset"), "length", F.lit(None).cast("binary").alias("tail"))
    return assemble(pieces, folder, gzipped)


def _tail(path: str) -> bytes:
    """What must follow the file's text so that a blank line ends it."""
    size = _size(path)
    last = chains.read_range(path, max(size - 2, 0), min(size, 2))
    return b"" if last == b"\n\n" else b"\n" if last.endswith(b"\n") else b"\n\n"


def merge_files(spark: SparkSession, paths: list[str], folder: str, gzipped: bool = False) -> DataFrame:
    """(name, bytes) of files whose texts, by name, are the inputs' bytes one after the other, newlines added only so that a blank line parts two of them.

    Nothing is parsed. Each input becomes one file, so that none begins within a record.
    Of large plain files, stretches are packed by tasks of their own, then put together.
    """
    guarded(paths, folder)
    rows, texts, sizes = [], [], [_size(p) for p in paths]
    full = [i for i, s in enumerate(sizes) if s]
    for n, i in enumerate(full, 1):
        tail = b"" if i == full[-1] else _tail(paths[i])
        system, inner = opened(paths[i])
        step = RANGE_BYTES if gzipped and system.get_file_info(inner).size == sizes[i] else sizes[i]
        name = f"part.{n:05d}.{split.base_name(paths[i])}.chain{'.gz' if gzipped else ''}"
        texts.append((name, sizes[i] + len(tail)))
        for seq, at in enumerate(range(0, sizes[i], step)):
            rows.append((name, seq, paths[i], at, min(step, sizes[i] - at), tail if at + step >= sizes[i] else None))
    shape = "name string, seq int, path string, offset bigint, length bigint, tail binary"
    if len(rows) == len(full):
        return assemble(spark.createDataFrame(rows, shape), folder, gzipped)
    packed = fresh(spark, "packed")
    member = lambda r: f"{r[0]}.{r[1]:06d}"
    assemble(spark.createDataFrame([(member(r), 0, *r[2:]) for r in rows], shape), packed, True).collect()
    system = opened(packed)[0]
    places = [f"{packed}/{member(r)}" for r in rows]
    joined = [(r[0], r[1], p, 0, system.get_file_info(opened(p)[1]).size, None) for r, p in zip(rows, places)]
    made = assemble(spark.createDataFrame(joined, shape), folder, stored=True)
    return made.select("name").join(F.broadcast(spark.createDataFrame(texts, "name string, bytes bigint")), "name")
