"""Chains from a folder that whole files arrive in, as a stream into a folder of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from alignloom.sources import chains


def ingest(spark: SparkSession, folder: str, out: str, marks: str, files_per_trigger: int = 16, range_bytes: int = chains.RANGE_BYTES) -> StreamingQuery:
    """Chains of every file that appears in the folder, as Parquet below out: what is there by now, then the query ends.

    A batch is the new files' names, which are few; their texts are read by byte ranges,
    a task a range. Each batch is one folder of its own, named by its number, and takes
    the place of what an earlier attempt left there, so after a failure and a restart
    from `marks` each chain is there once. Each chain needs its id: numbering would be
    one state for all files.
    """

    def commit(batch: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())
        if paths:
            found = chains.read_items(batch.sparkSession, paths, need_id=True, range_bytes=range_bytes)
            chains.chains(found, generate=False).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select("path").writeStream.foreachBatch(commit).option("checkpointLocation", marks).trigger(availableNow=True).start()
