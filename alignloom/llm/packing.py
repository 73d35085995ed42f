"""Packing documents' tokens into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm import tokens
from alignloom.llm.common import checkpointed, hidden, numbered, released

#: Documents of a group on average.
GROUP_DOCS = 2000


class Bins:
    """Bins of equal capacity under a tournament tree: each inner node holds the most room below it."""

    def __init__(self, count: int, capacity: int):
        self._leaves = 1
        while self._leaves < count:
            self._leaves *= 2
        self._room = [capacity] * (2 * self._leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Into the first bin with room for size: (bin, room it had)."""
        room, at = self._room, 1
        while at < self._leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] = had - size
        found = at - self._leaves
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each item; items of equal size keep their order. Each size is 1 to capacity."""
    bins, placed = Bins(len(sizes), capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found, had = bins.put(sizes[i])
        placed[i] = (found, capacity - had)
    return placed


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> DataFrame:
    """doc_id, doc_key, deal, start, length, ids_crc32, doc_tokens (and ids) of each document's pieces: cuts at multiples of capacity. deal: a hash of doc_id and text."""
    fields = [("doc_id", pa.int64()), ("doc_key", pa.int64()), ("deal", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for some in (batch.slice(at, tokens.SLICE_DOCS) for batch in batches for at in range(0, batch.num_rows, tokens.SLICE_DOCS)):
            doc_ids, keys, deals, texts = (c.to_pylist() for c in some.columns)
            for block in tokens.blocks(texts):
                rows = []
                for i, body in zip(block, encode(texts[block.start : block.stop])):
                    ids = body + end
                    for at in range(0, len(ids), 4 * capacity):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_ids[i], keys[i], deals[i], at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *[part] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        released(tokenizers=False)

    ddl = "doc_id bigint, doc_key bigint, deal bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    deal = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return inner.select(F.col(doc_id).cast("long"), F.monotonically_increasing_id(), deal, F.col(text)).mapInArrow(cut, ddl)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, seed: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens.

    A document's ids and end_id are cut at multiples of `capacity`. A full piece is a
    sequence. Rests are dealt at random to groups of about GROUP_DOCS documents, and
    each group is packed alone, first-fit decreasing; ties go by hash. The seed and the
    rows decide what goes where, however the rows are laid out. Columns: doc_id, doc_key
    (which tells rows of equal doc_id apart, and alone depends on the layout), start,
    length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the piece's ids as
    4-byte little-endian binary. A null or empty text is the end id alone; a very long
    one is encoded whole; repeated rows and null doc_ids are packed as any other, each
    copy dealt by a number of its own; an empty table gives no rows; other columns of
    docs are ignored, whatever their names. A group's size does not depend on any key of
    the data.
    """
    n_groups = -(-max(docs.count(), 1) // GROUP_DOCS)
    found = checkpointed(pieces(docs, tokenizer, end_id, capacity, with_ids))
    full, rests = found.filter(F.col("length") == capacity), found.filter(F.col("length") < capacity)
    long = numbered(full.filter("start = 0").select("doc_id", "deal", "doc_key"), ["doc_id", "deal"], "number").select("doc_key", "number")
    first = F.lit(1 << 62) + F.shiftleft("number", 24)
    full = full.join(long, "doc_key").withColumn("sequence_id", first + F.expr(f"start div {int(capacity)}")).withColumn("offset", F.lit(0).cast("long")).drop("number", "deal")
    again = rests.groupBy("deal").count().filter("count > 1").select("deal")
    if again.isEmpty():
        rests = rests.withColumn("__copy", F.lit(0).cast("long"))
    else:  # repeated rows, which a number tells apart
        twins = numbered(rests.join(again, "deal", "left_semi").select("deal", "doc_id", "doc_key"), ["deal", "doc_id"], "number")
        rests = rests.join(twins.select("doc_key", F.col("number").alias("__copy")), "doc_key", "left").withColumn("__copy", F.coalesce("__copy", F.lit(0)))
    rests = rests.withColumn("__group", F.pmod(F.xxhash64("deal", "__copy", F.lit(seed)), F.lit(n_groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["deal", "__copy"], ignore_index=True)
        placed = first_fit_decreasing(group["length"].tolist(), capacity)
        base = int(group["__group"].iloc[0]) << 32
        group["sequence_id"] = [base + b for b, _ in placed]
        group["offset"] = [o for _, o in placed]
        return group[list(names)]

    names = [c for c in rests.columns if c not in ("deal", "__copy", "__group")] + ["sequence_id", "offset"]
    full = full.select(names)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    return rests.groupBy("__group").applyInPandas(packed, ddl).unionByName(full)
