"""What several corpus operators share: tables, the shared folder, row numbers."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.storage import checkpointed, lent, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str], list[str]]:
    """docs with private column names, those names in order, and the private names of the needed columns.

    Columns are told apart by place, so names that differ by case only, hold dots or
    are names that an operator uses itself cannot clash. A needed column is the one
    spelled so, else the first that differs by case only.
    """
    own = [f"__own{i}" for i in range(len(docs.columns))]
    lower = [c.lower() for c in docs.columns]
    places = [docs.columns.index(n) if n in docs.columns else lower.index(n.lower()) for n in needed]
    return docs.toDF(*own), own, [own[i] for i in places]


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores after it as make it differ from every column of docs, in any case."""
    while has_column(docs, name):
        name += "_"
    return name


def released(tokenizers: bool = True) -> None:
    """In a Python worker, which lives on from task to task: free memory goes back to the system, and tokenizers that it remembers are forgotten."""
    if tokenizers:
        sys.modules.pop("_alignloom_worker", None)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def has_column(docs: DataFrame, name: str) -> bool:
    return name.lower() in (c.lower() for c in docs.columns)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with the gapless global row number `name` in the order of `keys`.

    The rows are range-partitioned and sorted, and that layout is checkpointed, so a
    row's number is its partition's offset plus its place there: one shuffle, no
    single task. Rows equal in all keys are told apart by where they were read, so a
    key that many rows share still spreads over partitions; such rows differ only in
    what `keys` leave out, so name all columns whose order matters. Only a count per
    partition comes to the driver.
    """
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    laid = checkpointed(salted.repartitionByRange(*keys, "__salt").sortWithinPartitions(*keys, "__salt").drop("__salt"))
    counts = laid.groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = {r["p"]: r["count"] for r in counts}
    offsets, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    place = F.monotonically_increasing_id()
    start = F.element_at(F.lit(offsets or [0]).cast("array<bigint>"), (F.shiftright(place, 33) + 1).cast("int"))
    return laid.withColumn(name, start + place.bitwiseAND(F.lit((1 << 33) - 1)))


def first_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with one row of each label: that of the least doc_id (null last), of its texts that of the least hash.

    rows: (doc_id, h, label) of every row of docs, h the XXH64 of the text. What is
    kept is known by doc_id and text, so no row number has to be the same in two
    readings; the texts are shuffled once, to meet the kept names and to leave one of
    repeated rows. Columns keep their names and values, whatever they are called.
    """
    inner, own, (doc_id, text) = hidden(docs, "doc_id", "text")
    doc, keys = F.col(doc_id).cast("long"), ["__known", "__doc", "__text_hash"]
    keyed = inner.select("*", doc.isNotNull().alias("__known"), F.coalesce(doc, F.lit(0)).alias("__doc"), F.xxhash64(text).alias("__text_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")
    kept = rows.groupBy("label").agg(F.min(order).alias("k")).select((~F.col("k.unknown")).alias("__known"), F.coalesce("k.doc_id", F.lit(0)).alias("__doc"), F.col("k.h").alias("__text_hash"))
    copies = keyed.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*own)).alias("r"))
    return copies.select("r.*").toDF(*docs.columns)
