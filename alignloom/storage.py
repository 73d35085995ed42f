"""The folder that driver and executors share, and what is kept there."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where the cluster names none and all runs on one machine (local master), a
    temporary one is made; elsewhere that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="alignloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of what runs inside are removed as each execution ends, since its result is kept whole."""
    flag = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(flag, None)
    spark.conf.set(flag, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(flag)
        else:
            spark.conf.set(flag, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()  # a frame made here takes the setting, df itself is older


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet to the shared folder: column by column and compressed, unlike a checkpoint."""
    path = fresh(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def lent(df: DataFrame, name: str):
    """df as written() keeps it, until the block ends; what is read from it must be kept elsewhere by then."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    with tidy(spark):
        df.write.parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs: ...) or path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def part_files(folder: str, ending: str = "") -> list[str]:
    """The files of a folder that Spark or assemble() wrote, by name."""
    system, inner = opened(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File]
    names = sorted(f.base_name for f in found if not f.base_name.startswith(("_", ".")) and f.base_name.endswith(ending))
    return [f"{folder}/{n}" for n in names]
