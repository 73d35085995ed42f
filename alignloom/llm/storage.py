"""Files in the shared folder, from any task, through whatever file system its URI names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import SparkSession

from alignloom.llm.common import shared_dir


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A folder of its own for one run, below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    system, inner = opened(path)
    system.create_dir(inner, recursive=True)
    return path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file:, hdfs:, s3:, gs: ...) or absolute path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@contextmanager
def created(folder: str, suffix: str):
    """(stream, path) of a new file that no other attempt of the task shares.

    A task names its files in the rows it returns, so a lost or repeated attempt leaves
    at most a file that no row names.
    """
    path = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, inner = opened(path)
    with system.open_output_stream(inner, compression=None) as stream:
        yield stream, path


@contextmanager
def read_from(path: str):
    """A seekable file."""
    system, inner = opened(path)
    with system.open_input_file(inner) as stream:
        yield stream
