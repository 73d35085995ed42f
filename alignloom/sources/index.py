"""A kept index of records: spans in small sorted files, of which one search and one read give a record's bytes."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.sources.chains import read_range, text_stream
from alignloom.storage import opened

#: Fixed-width entries: file_no, offset, length as little-endian 64-bit integers.
_ENTRY = 24
#: Records that a task holds at a time.
BATCH = 256


def write(spans: DataFrame, folder: str) -> None:
    """Keeps chains.spans() in a folder: for each partition a file of entries in order, and a footer that says which ordinals each has."""
    system, inner = opened(folder)
    system.create_dir(inner)
    shape = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        out, first, n, name = None, 0, 0, ""
        for batch in batches:
            if not batch.num_rows:
                continue
            ordinal, *columns = (c.to_numpy().astype("<i8") for c in batch.columns)
            if out is None:
                first = int(ordinal[0])
                name = f"{first:020d}.spans"  # another attempt of the task writes the same bytes
                out = system.open_output_stream(f"{inner}/{name}", compression=None)
            out.write(np.stack(columns, 1).tobytes())
            n += len(ordinal)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"first": first, "n": n, "name": name}], schema=shape)

    rows = spans.select("ordinal", F.col("file_no").cast("long"), "offset", "length").mapInArrow(run, "first bigint, n bigint, name string").collect()
    footer = sorted([r["first"], r["n"], r["name"]] for r in rows)
    with system.open_output_stream(f"{inner}/footer.json", compression=None) as out:
        out.write(json.dumps(footer).encode())


def _footer(folder: str) -> list[list]:
    system, inner = opened(folder)
    with system.open_input_file(f"{inner}/footer.json") as stream:
        return json.loads(stream.read())


def size(folder: str) -> int:
    """How many records the index has."""
    return sum(n for _, n, _ in _footer(folder))


def place(folder: str, footer: list[list], ordinal: int, read: Callable[[str, int, int], bytes] = read_range) -> tuple[int, int, int] | None:
    """(file_no, offset, length) of a record: its file of entries by binary search, its entry by one read; None beyond the last."""
    at = bisect_right(footer, ordinal, key=lambda f: f[0]) - 1
    if at < 0 or ordinal >= footer[at][0] + footer[at][1]:
        return None
    entry = read(f"{folder}/{footer[at][2]}", _ENTRY * (ordinal - footer[at][0]), _ENTRY)
    return tuple(np.frombuffer(entry, "<i8").tolist())


def chain_bytes(folder: str, paths: str | list[str], ordinal: int) -> bytes | None:
    """The bytes of the record of that ordinal; None beyond the last."""
    found = place(folder, _footer(folder), ordinal)
    return None if found is None else bytes(read_range(([paths] if isinstance(paths, str) else paths)[found[0]], *found[1:]))


def fetched(wanted: DataFrame, folder: str, paths: str | list[str]) -> DataFrame:
    """(ordinal, record) of the rows of wanted (ordinal): each costs two reads, wherever the record is, of files that a task opens once; ordinals beyond the last have none."""
    named, footer = [paths] if isinstance(paths, str) else list(paths), _footer(folder)
    shape = pa.schema([("ordinal", pa.int64()), ("record", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as stack:
            held = {}

            def read(path: str, offset: int, length: int) -> bytes:
                if path not in held:
                    held[path] = text_stream(path, stack)
                held[path].seek(offset)
                return held[path].read(length)

            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    some = batch.column(0).slice(at, BATCH).to_pylist()
                    found = [(o, f) for o in some if (f := place(folder, footer, o, read)) is not None]
                    records = [bytes(read(named[f[0]], *f[1:])) for _, f in found]
                    yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.array(records, pa.binary())], schema=shape)

    return wanted.select(F.col("ordinal").cast("long")).mapInArrow(run, "ordinal bigint, record binary")
