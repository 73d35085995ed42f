"""Token-id files: independent zstandard frames, then a seek table with a checksum per frame.

Layout of a file (the public seekable zstandard format): data frames; a skippable
frame with the index of documents; a skippable frame with the seek table. A data
frame holds whole documents: their number, then of each doc_id (and whether it is
null) and its number of ids, then all ids, 2 bytes each where the vocabulary allows
it, else 4, little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.llm import storage, tokens
from alignloom.llm.common import checkpointed, hidden, released

#: Fixed values of the public format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A5C, 0x8F92EAB1, 0x80

FRAME_BYTES, FILE_BYTES = 1 << 20, 256 << 20
_HEAD, _DOC, _ENTRY, _FOOT, _PLACE = "<IB", "<?qQ", "<III", "<IBI", "<?q?qQ"


class Writer:
    """Writes documents in the order given; frames end at FRAME_BYTES of ids or the file's end."""

    def __init__(self, stream, wide: bool = False):
        self._stream, self._wide = stream, wide
        self._zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self._held: list[tuple[int | None, bytes]] = []
        self._held_bytes, self._entries, self._places = 0, [], []
        self.docs = self.ids = self.written = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        body = ids.astype("<u4" if self._wide else "<u2").tobytes()
        self._held.append((doc_id, body))
        self._held_bytes += len(body)
        self.docs, self.ids = self.docs + 1, self.ids + len(ids)
        if self._held_bytes >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        if not self._held:
            return
        each = 4 if self._wide else 2
        plain = b"".join([struct.pack(_HEAD, len(self._held), each), *(struct.pack(_DOC, d is None, d or 0, len(b) // each) for d, b in self._held), *(b for _, b in self._held)])
        frame = self._zstd.compress(plain)
        self._stream.write(frame)
        self._entries.append(struct.pack(_ENTRY, len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        (first, _), (last, _) = self._held[0], self._held[-1]
        self._places.append(struct.pack(_PLACE, first is None, first or 0, last is None, last or 0, len(self._held)))
        self.written += len(frame)
        self._held, self._held_bytes = [], 0

    def close(self) -> None:
        self._end_frame()
        index = b"".join(self._places)
        table = b"".join(self._entries) + struct.pack(_FOOT, len(self._entries), CHECKSUMS, SEEKABLE_MAGIC)
        for magic, body in ((SKIPPABLE_INDEX, index), (SKIPPABLE_SEEK, table)):
            self._stream.write(struct.pack("<II", magic, len(body)) + body)


class Reader:
    """Reads the seek table and index of a file, then only the frames asked for."""

    def __init__(self, stream):
        self._stream = stream
        size = stream.seek(0, 2)
        stream.seek(size - struct.calcsize(_FOOT))
        count, flags, magic = struct.unpack(_FOOT, stream.read(struct.calcsize(_FOOT)))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the file's end")
        length = count * struct.calcsize(_ENTRY) + struct.calcsize(_FOOT)
        stream.seek(size - length - 8)
        if struct.unpack("<II", stream.read(8)) != (SKIPPABLE_SEEK, length):
            raise ValueError("the seek table's frame is damaged")
        self.entries = list(struct.iter_unpack(_ENTRY, stream.read(count * struct.calcsize(_ENTRY))))
        indexed = count * struct.calcsize(_PLACE)
        stream.seek(size - length - 8 - indexed - 8)
        if struct.unpack("<II", stream.read(8)) != (SKIPPABLE_INDEX, indexed):
            raise ValueError("the index of documents is damaged")
        self.places = list(struct.iter_unpack(_PLACE, stream.read(indexed)))
        self.starts = [0, *np.cumsum([e[0] for e in self.entries], dtype=np.int64).tolist()]

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of frame k's documents, after its checksum has been verified."""
        packed_size, plain_size, checksum = self.entries[k]
        self._stream.seek(self.starts[k])
        plain = zstandard.ZstdDecompressor().decompress(self._stream.read(packed_size), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not have the length and checksum of the seek table")
        count, each = struct.unpack_from(_HEAD, plain)
        at = struct.calcsize(_HEAD) + count * struct.calcsize(_DOC)
        for i in range(count):
            null, doc_id, length = struct.unpack_from(_DOC, plain, struct.calcsize(_HEAD) + i * struct.calcsize(_DOC))
            yield None if null else doc_id, np.frombuffer(plain, f"<u{each}", length, at)
            at += length * each

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents of the wanted ids in this file; only frames whose range of ids holds one are decompressed."""
        ordered = np.array(sorted(wanted), dtype=np.int64)
        for k, (_, first, last_null, last, _) in enumerate(self.places):
            low = np.iinfo(np.int64).min if self.places[k][0] else first
            if not last_null and np.searchsorted(ordered, low) < np.searchsorted(ordered, last, "right"):
                yield from ((d, ids) for d, ids in self.frame(k) if d in wanted)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents, in ascending doc_id order (null first), and returns (part, file_no, path, n_docs, n_ids) per file.

    Texts are dealt by ranges of doc_id (rows of one doc_id by their texts' hash, then
    by where they were read, so one doc_id can spread over tasks), and sorted and
    encoded there as they stream by; a task holds a frame at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        wide = encoder._tokenizer.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        part, file_no, out = TaskContext.get().partitionId(), 0, []

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, tokens.SLICE_DOCS):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, tokens.SLICE_DOCS).columns)
                    for block in tokens.blocks(texts):
                        yield from zip(ids[block.start : block.stop], (np.frombuffer(b, "<u4") for b in encoder.encode(texts[block.start : block.stop])))

        flow = encoded()
        item = next(flow, None)
        while item:
            with storage.created(folder, ".ids.zst") as (stream, path):
                writer = Writer(stream, wide)
                while item and writer.written < FILE_BYTES:
                    writer.add(item[0], np.append(item[1], np.uint32(end_id)))
                    item = next(flow, None)
                writer.close()
            out.append((part, file_no, path, writer.docs, writer.ids))
            file_no += 1
        released(tokenizers=False)
        schema = pa.schema([("part", pa.int32()), ("file_no", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    inner, _, (own_id, text) = hidden(docs, "doc_id", "text")
    keyed = inner.select(F.col(own_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))
    laid = keyed.repartitionByRange("doc_id", "h", "m").sortWithinPartitions("doc_id", "h", "m").select("doc_id", "text")
    return checkpointed(laid.mapInArrow(run, "part int, file_no int, path string, n_docs bigint, n_ids bigint"))


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: start counts the ids of all documents before it."""
    rows, start = [], 0
    for f in sorted(files.collect(), key=lambda f: (f["part"], f["file_no"])):  # one row for each FILE_BYTES
        rows.append((f["path"], start))
        start += f["n_ids"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with storage.read_from(path) as stream:
                    reader = Reader(stream)
                    for k in range(len(reader.entries)):
                        found = []
                        for doc_id, ids in reader.frame(k):
                            found.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            at += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)
        released()

    named = spark.createDataFrame(rows, "path string, start bigint").repartition(max(1, len(rows)))
    return named.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes all documents to files below the shared folder and returns what reading them back gives.

    A null or empty text has the end id alone; a very long one is encoded whole; repeated
    rows and doc_ids are all written; an empty table writes no file and gives no rows.
    Other columns of docs are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    return read(spark, write(docs, storage.fresh_dir(spark, "token-ids"), tokenizer, end_id))
