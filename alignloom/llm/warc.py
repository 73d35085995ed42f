"""WARC archives compressed with Zstandard and a dictionary (.warc.zst).

A file begins with a skippable frame that holds the dictionary; each record is one
frame of its own. The writer stores a payload once and lets records of equal payloads
revisit it; the reader decodes frame by frame and validates headers and lengths.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm import storage
from alignloom.llm.common import checkpointed, hidden

#: Fixed values of the public formats.
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION, PROFILE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")

FILE_BYTES, READ_BYTES = 256 << 20, 1 << 20
#: A dictionary is trained on a bounded sample: so many payloads at most, of each so many bytes, from the start of a task's rows.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 32768


def _headed(first: bytes, fields: list[tuple[bytes, bytes]]) -> bytes:
    return b"".join([first, b"\r\n", *(k + b": " + v + b"\r\n" for k, v in fields), b"\r\n"])


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or (refers_to given) a revisit without."""
    name = lambda i: b"<urn:page:%s>" % (b"null" if i is None else b"%d" % i)
    http = _headed(b"HTTP/1.1 200 OK", [(b"Content-Type", b"text/html; charset=utf-8"), (b"Content-Length", b"%d" % size)])
    block = http if refers_to is not None else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A").encode()
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"), (b"WARC-Record-ID", name(page_id)), (b"WARC-Target-URI", target), (b"WARC-Date", b"1970-01-01T00:00:00Z"),
        (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Length", b"%d" % len(block)),
    ]
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", name(refers_to)), (b"WARC-Profile", PROFILE)]
    return _headed(VERSION, fields) + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; empty where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=3).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body


def frames(stream) -> Iterator[bytes]:
    """The plain bytes of each record's frame, one at a time; the leading skippable frame gives the dictionary."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the archive's start")
    body = stream.read(size)
    if len(body) != size:
        raise ValueError("the dictionary frame is cut short")
    plain = zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_MAGIC else body
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(plain)) if plain else zstandard.ZstdDecompressor()
    rest = b""
    while chunk := rest or stream.read(READ_BYTES):
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(chunk))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (chunk := stream.read(READ_BYTES)):
                raise ValueError("a record's frame is cut short")
        yield b"".join(parts)


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise ValueError(f"a malformed header line: {line[:80]!r}")
        out[key.lower()] = value.strip()
    return out


def parsed(plain: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record whose headers, lengths and digest hold."""
    head, gap, rest = plain.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise ValueError("not one WARC record in the frame")
    fields = _fields(lines)
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"missing headers: {missing}")
    length = int(fields[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record's frame")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("the record's block is no HTTP response")
    size, digest, kind = int(_fields(lines)[b"content-length"]), fields[b"warc-payload-digest"].removeprefix(b"sha1:").decode(), fields[b"warc-type"].decode()
    page = lambda name: None if name == b"<urn:page:null>" else int(name[10:-1])
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("a payload does not have its length and digest")
        return page(fields[b"warc-record-id"]), size, digest, kind, None
    if kind != "revisit" or payload or fields.get(b"warc-profile") != PROFILE:
        raise ValueError(f"an unexpected record: {kind}")
    return page(fields[b"warc-record-id"]), size, digest, kind, page(fields[b"warc-refers-to"])


def planned(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, size, digest, refers_to of every row.

    Payloads of least_bytes or more that occur again refer to the row of the largest
    page_id; a payload's rows meet in a partial aggregate and a join that AQE splits.
    """
    inner, _, (page_id, url, html) = hidden(pages, "page_id", "url", "html")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = inner.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    again = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("digest", "leader")
    joined = rows.join(again.hint("shuffle_hash"), "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("leader").isNotNull() & (F.col("size") >= least_bytes) & ~F.col("leader").eqNullSafe(F.col("page_id")), F.col("leader"))).drop("leader")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for every row of pages (page_id, url, html) and returns (path, n_records) per archive.

    Each task trains a dictionary on a bounded sample of its own rows and streams its
    records out. A null html is an empty payload, a null page_id or url an empty name; a
    very long payload is one record. Repeated rows are each written; rows that tie for
    the largest page_id of a payload are all responses. Other columns of pages are not
    looked at, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)))
        out = []
        while early := list(islice(rows, SAMPLE_RECORDS)):
            dictionary = trained([r[2][:SAMPLE_BYTES].encode() for r in early])
            extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
            compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **extra)
            with storage.created(folder, ".warc.zst") as (stream, path):
                stream.write(_dictionary_frame(dictionary))
                written = n = 0
                for page_id, url, html, size, digest, refers_to in chain(early, rows):
                    frame = compressor.compress(record(page_id, url, html.encode(), digest, size, refers_to))
                    stream.write(frame)
                    written, n = written + len(frame), n + 1
                    if written >= FILE_BYTES and n >= len(early):
                        break
            out.append({"path": path, "n_records": n})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    laid = planned(pages).select("page_id", "url", "html", "size", "digest", "refers_to")
    return checkpointed(laid.mapInArrow(run, "path string, n_records bigint"))


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives; a damaged record or a wrong number of them is an error."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(*(c.to_pylist() for c in batch.columns)):
                found, n = [], 0
                with storage.read_from(path) as stream:
                    for plain in frames(stream):
                        found.append(parsed(plain))
                        n += 1
                        if len(found) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)
                            found = []
                if n != expected:
                    raise ValueError(f"{path} has {n} records instead of {expected}")
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), schema)], schema=schema)

    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.select("path", "n_records").mapInArrow(run, ddl)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives below the shared folder and returns what reading them back gives; an empty table writes none and gives no rows."""
    return read(write(pages, storage.fresh_dir(pages.sparkSession, "warc")))
