"""Columns and kernels over bases: complement, substitution matrix, per-base counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases and their complements; all others are their own.
BASES, COMPLEMENTS = "ACGTacgtRYKMBVDHrykmbvdh", "TGCAtgcaYRMKVBHDyrmkvbhd"
#: The default substitution scores, rows and columns A, C, G, T.
DEFAULT_MATRIX = (91, -114, -31, -123, -114, 100, -125, -31, -31, -125, 100, -114, -123, -31, -114, 91)

#: Bases that are counted at a time.
STEP = 4 << 20
COUNTS = "struct<matches:bigint,n:bigint,a:bigint,c:bigint,g:bigint,t:bigint,repeats:bigint,total:bigint>"


def complement(bases: Column) -> Column:
    return F.translate(bases, BASES, COMPLEMENTS)


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def pair_score(query: Column, target: Column, matrix: tuple[int, ...] = DEFAULT_MATRIX) -> Column:
    """The score of a pair of bases, either case; 0 where one is none of A, C, G, T."""
    q, t = (F.locate(c, F.lit("ACGT")) if isinstance(c, str) else F.instr(F.lit("ACGT"), F.upper(c)) for c in (query, target))
    return F.when((q > 0) & (t > 0), F.element_at(F.lit(list(matrix)), (q - 1) * 4 + t)).otherwise(0)


def _codes() -> np.ndarray:
    codes = np.full(256, 4, dtype=np.int64)
    for i, base in enumerate("ACGT"):
        codes[ord(base)] = codes[ord(base.lower())] = i
    return codes


def counted(target: Column, query: Column, matrix: tuple[int, ...] = DEFAULT_MATRIX) -> Column:
    """Of two equally long stretches of bases: the sum of pair scores, how many positions agree by class
    (n: neither of A, C, G, T), how many are soft-masked on either side, all.

    An Arrow batch is one vector, whatever the number and length of its stretches.
    """

    @F.arrow_udf(COUNTS)
    def of(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        count = counter(matrix)
        for targets, queries in batches:
            found = count(targets, queries, np.zeros(len(targets), bool))
            yield pa.StructArray.from_arrays([pa.array(v) for v in found.values()], names=list(found))

    return of(*(F.encode(x, "ISO-8859-1") for x in (target, query)))


def _tables(matrix: tuple[int, ...]) -> dict[str, np.ndarray]:
    """What each pair of bytes (target * 256 + query) adds to each count."""
    codes, masked = _codes(), np.isin(np.arange(256), list(b"acgtn"))
    flat = np.zeros(25, dtype=np.int64)
    for i in range(4):
        flat[i * 5 : i * 5 + 4] = matrix[i * 4 : i * 4 + 4]
    t, q = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
    both = {c: (codes[t] == i) & (codes[q] == i) for c, i in zip("nacgt", (4, 0, 1, 2, 3))}
    return {k: v.astype(np.int64) for k, v in ({"matches": flat[5 * codes[q] + codes[t]]} | both | {"repeats": masked[t] | masked[q]}).items()}


def counter(matrix: tuple[int, ...] = DEFAULT_MATRIX) -> Callable[[pa.Array, pa.Array, np.ndarray], dict[str, np.ndarray]]:
    """What counts Arrow arrays of stretches held as bytes, by the fields of COUNTS; where the third is true, over the query's reverse complement."""
    tables, turned = _tables(matrix), np.arange(256, dtype=np.uint8)
    turned[list(BASES.encode())] = list(COMPLEMENTS.encode())

    def flat(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:  # all bytes, and where each stretch begins
        held = held.cast(pa.large_binary())
        _, at, data = held.buffers()
        at = np.frombuffer(at, np.int64)[held.offset : held.offset + len(held) + 1] if at else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
        return body[at[0] : at[-1]], at - at[0]

    def counts(t: np.ndarray, q: np.ndarray, at: np.ndarray, back: np.ndarray) -> list[np.ndarray]:
        sizes = np.diff(at)
        if back.any():
            owner, place = np.repeat(back, sizes), np.arange(len(q))
            q = np.where(owner, turned[q[np.where(owner, np.repeat(at[:-1] + at[1:] - 1, sizes) - place, place)]], q)
        pair, some = t.astype(np.uint16) << 8 | q, np.flatnonzero(sizes)
        out = [np.zeros(len(sizes), np.int64) for _ in tables]
        for column, table in zip(out, tables.values()):
            column[some] = np.add.reduceat(table[pair], at[some]) if len(some) else 0
        return [*out, sizes]

    def count(targets: pa.Array, queries: pa.Array, minus: np.ndarray) -> dict[str, np.ndarray]:
        (t, at), (q, other) = flat(targets), flat(queries)
        if not np.array_equal(at, other):
            raise ValueError("stretches of different lengths")
        parts, low = [], 0
        while low < len(at) - 1 or not parts:  # stretches of STEP bases, or one longer
            high = min(max(low + 1, int(np.searchsorted(at, at[low] + STEP, side="right")) - 1), len(at) - 1)
            some = slice(at[low], at[high])
            parts.append(counts(t[some], q[some], at[low : high + 1] - at[low], minus[low:high]))
            low = high
        return dict(zip([*tables, "total"], map(np.concatenate, zip(*parts))))

    return count
