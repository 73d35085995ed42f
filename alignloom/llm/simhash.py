"""SimHash near-duplicates: fingerprints of word shingles, met by variants within half the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.llm.common import checkpointed, first_of_each, hidden
from alignloom.llm.graph import connected_components

BITS, RADIUS = 64, 3
#: Fingerprints that share a half exactly before they meet by whole fingerprints instead of pairwise.
CROWDED = 64


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Of a whole text: bit i is 1 if it is set in over half of the XXH64 of its word shingles, repeats included.

    Words are runs of other characters than ASCII white space, A-Z lower-cased. Fewer
    than `words` words: the whole sequence is the one shingle; no word: 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    plain, n = b" ".join(parts), len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(plain, seed)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    stops = (starts + lengths)[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts, shingles = np.zeros(BITS, np.int64), n - words + 1
    hashes = np.array([digest(plain[a:b], seed) for a, b in zip(starts.tolist(), stops)], dtype="<u8")
    for at in range(0, shingles, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, extra: Column | None = None) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long, and the long `extra` as h if given; null texts have no words."""
    more = extra is not None
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [("h", pa.int64())] * more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(t) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), *([part.column(2)] if more else [])], schema=schema)

    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")] + ([extra.alias("h")] if more else [])
    return docs.select(*wanted).mapInArrow(run, "doc_id bigint, fp bigint" + ", h bigint" * more)


def _half(side: int) -> Column:
    """That half of the fingerprint as a long of 32 bits."""
    mask = F.lit((1 << 32) - 1)
    return F.col("fp").bitwiseAND(mask) if side == 0 else F.shiftrightunsigned("fp", 32).bitwiseAND(mask)


def _masks(bits: int, flips: int) -> list[int]:
    """Signed masks of all choices of up to so many of the bits."""
    out = [0]
    if flips > 0:
        out += [1 << i for i in range(bits)]
    if flips > 1:
        out += [1 << i | 1 << j for i in range(bits) for j in range(i)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of different fingerprints at RADIUS bits or fewer.

    fps: distinct values of `fp`. Two fingerprints within 3 bits have a half (32 bits)
    in which they differ by one bit at most, which is half the radius: every
    fingerprint emits, for either half, all variants within that distance, the
    variants are shuffled, meet the fingerprints that have the half so, and the pairs
    are verified on all 64 bits. Where more than CROWDED fingerprints share a half,
    those that would meet there do so by whole fingerprints: each emits its variants
    within two bits. A variant within one bit of some fingerprint and within two of
    others proves that all of them are linked, so each links to the least of them;
    no pair is listed, and work stays linear in the group.
    """
    sides = F.array(*[F.struct(F.lit(s).alias("side"), _half(s).alias("half")) for s in (0, 1)])
    exact = fps.select("fp", F.inline(sides))
    crowded = exact.groupBy("side", "half").count().filter(F.col("count") > CROWDED).select("side", "half")
    variants = exact.select("fp", "side", "half", F.explode(F.lit(_masks(32, RADIUS // 2)).cast("array<bigint>")).alias("m")).select(F.col("fp").alias("other"), "side", F.col("half").bitwiseXOR(F.col("m")).alias("half"))
    calm = exact.join(crowded, ["side", "half"], "left_anti")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = variants.join(calm, ["side", "half"]).filter((F.col("fp") < F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    dense = checkpointed(variants.join(crowded, ["side", "half"], "left_semi").select(F.col("other").alias("fp")).distinct())
    whole = dense.select("fp", F.explode(F.lit(_masks(64, 2)).cast("array<bigint>")).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"), (F.bit_count("m") <= 1).alias("close"))
    met = whole.groupBy("variant").agg(F.min("fp").alias("b"), F.max("close").alias("close"), F.count("*").alias("n"), F.collect_list("fp").alias("fps")).filter("close and n > 1")
    stars = met.select(F.explode("fps").alias("a"), "b")
    return pairs.unionAll(stars.filter("a <> b"))


def linked(fps: DataFrame) -> DataFrame:
    """(node, label) of the fingerprints that links reach; fps: distinct values of `fp`, kept."""
    return checkpointed(connected_components(links(fps)))


def _named(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of rows (doc_id, fp)."""
    classes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = linked(classes.select("fp"))
    labelled = classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    leaders = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(leaders, "label").select("fp", "component_id", "label")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the smallest doc_id that links reach.

    Rows of equal fingerprints are one class, whatever their number, before any are
    compared. Empty and null texts share fingerprint zero. Repeated rows are returned
    each; component_id is null only where no doc_id of the component is known. An
    empty table gives no rows; other columns of docs are ignored.
    """
    rows = checkpointed(fingerprints(_needed(docs)))
    named = _named(rows).drop("label")
    return rows.join(named.hint("shuffle_hash"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _needed(docs: DataFrame) -> DataFrame:
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    return inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least doc_id (null last), of its texts that of the least hash.

    Null and empty texts, long ones and repeated rows as in components(); columns keep
    names and values, whatever they are called.
    """
    rows = checkpointed(fingerprints(_needed(docs), F.xxhash64("text")))
    named = _named(rows.select("doc_id", "fp")).select("fp", "label")
    return first_of_each(docs, rows.join(named.hint("shuffle_hash"), "fp"))
