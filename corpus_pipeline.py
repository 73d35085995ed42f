"""A training corpus from documents: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from alignloom.llm import decontaminate, neardup, packing, secrets, toxicity
from alignloom.llm.common import shared_dir, table
from alignloom.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    Null and empty texts are scored as any other, very long ones whole; repeated rows each stay or go; an empty
    table stays empty; other columns keep names and values, whatever they are called.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row of the least doc_id (of its rows, the first read).

    Pairs are found by SimHash links and by MinHash bands and compared exactly.
    """
    return neardup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window.

    Null and empty texts have no words and stay; very long ones are read whole; repeated rows each stay or go; an
    empty table stays empty; columns keep names and values.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), 10)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret masked and n_chars as it is then.

    Null and empty texts stay as they are; very long ones are masked whole; repeated rows each stay; an empty table
    stays empty; other columns keep names and values.
    """
    return secrets.redacted(docs, length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, with their ids; doc_key tells rows of equal doc_id apart.

    A null or empty text is its end id alone; very long ones are encoded whole; repeated rows are each packed; an
    empty table gives no rows; other columns of docs are left out.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096, seed=42, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: A fitted classifier, fingerprints and a tokenizer are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what each returns is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
