"""Reproducible shuffling and sharding by a Feistel permutation of row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from alignloom.llm.common import hidden, numbered

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer; the round function of the network."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where each index of range(n) goes under the seeded permutation of range(n).

    A balanced Feistel network permutes the smallest domain of 4**b >= n values; an
    image outside range(n) is put through the network again until it lies inside
    (cycle walking), four rounds of the walk on average at most.
    """
    half = 1
    while 4**half < n:
        half += 1
    mask, width = np.uint64(2**half - 1), np.uint64(half)

    def network(v):
        left, right = v >> width, v & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, (seed * ROUNDS + r + 1) * 0x9E3779B97F4A7C15) & mask)
        return (left << width) | right

    out = network(np.asarray(index, dtype=np.uint64))
    outside = np.flatnonzero(out >= n)
    while outside.size:
        out[outside] = network(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def permuted(col: Column, n: int, seed: int = 0) -> Column:
    """permute() over a column of row numbers."""

    @F.pandas_udf(LongType())
    def of(v: pd.Series) -> pd.Series:
        return pd.Series(permute(v.to_numpy(), n, seed))

    return of(col)


def shard(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard and slot of every row of docs.

    Law `rows`: shards differ by one row at most. row: the global number in order of
    doc_id (null first), size and checksum; position: its image under the permutation;
    shard = position mod shards and slot = position div shards, so both are computable
    from the row number alone, slots are gapless from 0, and reading shards' slots in
    turn gives one shuffled epoch. size: UTF-8 bytes of the text (null: none) plus 1.
    Repeated rows are each placed; very long texts count by their bytes and checksum. An
    empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = numbered(inner.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")), ["doc_id", "size", "text_crc32"], "row")
    n = rows.count()
    placed = rows.withColumn("position", permuted(F.col("row"), n, seed))
    return placed.select("*", (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {int(shards)}").alias("slot"))
