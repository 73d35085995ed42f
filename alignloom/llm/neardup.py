"""Near-duplicate documents: SimHash links and MinHash bands of whole texts, exact Jaccard of their five-word shingles.

Both find pairs, none decides: fingerprints meet as op9's do, by variants within half
of the radius, and what they link is compared exactly, as is what shares a band. Bands
reach the pairs at 0.8 whose fingerprints are further apart than any feasible radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm import passages, simhash
from alignloom.llm.common import checkpointed, first_of_each, hidden, released

#: Bands of passages.ROWS rows: a pair at the threshold 0.8 is missed with probability (1 - 0.8**4)**24 = 3e-6.
BANDS = 24

_SEEDS = np.random.default_rng(23).integers(1, 1 << 63, (2, BANDS * passages.ROWS), dtype=np.uint64)


def whole(text: str | None) -> Iterator[tuple[int, int, str, list[bytes]]]:
    """The whole text as the one unit that is compared, as passages.lines gives lines; null counts as empty."""
    yield 0, 0, text or "", (text or "").encode().lower().split()


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, id, fp, bands) of every row: the text's XXH64, a hash of its words, op9's fingerprint and its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        known: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, names, found = batch.slice(at, 256), [], []
                for text in part.column(2).to_pylist():
                    words = (text or "").encode().lower().split()
                    name = passages.named(words)
                    if name not in known:
                        if len(known) >= 5_000:
                            known.clear()
                        known[name] = simhash.fingerprint(text), passages.bands(passages.shingles(words), _SEEDS)
                    names.append(name)
                    found.append(known[name])
                fps, found = zip(*found)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))], schema=schema)
        released()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id bigint, h bigint, id bigint, fp bigint, bands array<bigint>")


def met(rows: DataFrame) -> DataFrame:
    """(id, bands, times) of the classes of rows: where each meets others, by its bands and by the component that SimHash links give it."""
    linked = simhash.linked(checkpointed(rows.select("fp").distinct())).toDF("fp", "component")
    distinct = rows.groupBy("id").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("times"))
    of_component = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    return distinct.join(linked, "fp", "left").select("id", F.concat("bands", F.array(of_component)).alias("bands"), "times")


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, h, label) of every row; rows of one label are linked by texts whose Jaccard similarity is 0.8 or more.

    Texts of equal words are one class, whatever their number, before any are compared.
    Null and empty texts are one class; very long ones are compared whole; other columns
    are not looked at, whatever their names.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    docs = inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = checkpointed(signatures(docs))
    labels = checkpointed(passages.similar(met(rows), docs, whole))
    return rows.drop("fp", "bands").join(labels.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").select("doc_id", "h", F.coalesce("label", "id").alias("label"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component of near duplicates: that of the least doc_id (null last), of its texts that of the least hash.

    Repeated rows leave one, an empty table stays empty, columns keep names and values.
    """
    return first_of_each(docs, labelled(docs))
