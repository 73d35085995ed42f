"""spark.read.format("chain"): chain files as a data source, whose header filters leave blocks unread."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from alignloom.schema import CHAINS, HEADER
from alignloom.sources import chains, scan
from alignloom.storage import part_files

_COMPARED = {ds.EqualTo: pc.equal, ds.EqualNullSafe: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal}
_MATCHED = {ds.StringStartsWith: pc.starts_with, ds.StringEndsWith: pc.ends_with, ds.StringContains: pc.match_substring}
_TEXTS = ("r_name", "r_strand", "q_name", "q_strand")


def predicate(f: ds.Filter) -> Callable[[scan.Headers], pa.Array] | None:
    """What a filter says of headers, true, false or null; None if it is not about one column of the header."""
    if isinstance(f, ds.Not):
        inner = predicate(f.child)
        return None if inner is None else lambda h: pc.invert(inner(h))
    if len(f.attribute) != 1 or f.attribute[0] not in HEADER:
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    column = lambda h: _column(h, name)
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        test = pc.is_null if isinstance(f, ds.IsNull) else pc.is_valid
        return lambda h: test(column(h))
    if isinstance(f, ds.In):
        listed = [_value(name, v) for v in f.value if v is not None]
        return None if len(listed) < len(f.value) else lambda h: pc.if_else(pc.is_valid(column(h)), pc.is_in(column(h), pa.array(listed, column(h).type)), None)
    if value is None:
        return None
    if type(f) in _COMPARED:
        compared = lambda h: _COMPARED[type(f)](column(h), pa.scalar(_value(name, value), column(h).type))
        return (lambda h: pc.fill_null(compared(h), False)) if isinstance(f, ds.EqualNullSafe) else compared
    if type(f) in _MATCHED and name in _TEXTS:
        return lambda h: _MATCHED[type(f)](column(h), value)
    return None


def _value(name: str, value):
    return value if name in _TEXTS else int(value)


def _column(h: scan.Headers, name: str) -> pa.Array:
    if name == "id":
        return pa.array(h["id"], mask=~h["id_explicit"])
    return h[name] if isinstance(h[name], pa.Array) else pa.array(h[name])


@dataclass
class Range(ds.InputPartition):
    """Neighbouring ranges of files' bytes, as ranges_of() gives them."""

    spans: list[tuple]


class ChainReader(ds.DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str], range_bytes: int):
        self._paths, self._columns, self._range_bytes = paths, columns, range_bytes
        self._predicates: list[Callable[[scan.Headers], pa.Array]] = []

    def partitions(self) -> list[Range]:
        spans = chains.ranges_of(self._paths, self._range_bytes)
        tasks = chains.tasks_for(spans)
        return [Range(spans[i * len(spans) // tasks : (i + 1) * len(spans) // tasks]) for i in range(tasks)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            yield from self._of(span)

    def _of(self, span: tuple) -> Iterator[pa.RecordBatch]:
        kept = []

        def wanted(h: scan.Headers) -> np.ndarray:
            stay = np.ones(len(h["score"]), bool)
            for test in self._predicates:
                stay &= np.asarray(pc.fill_null(test(h), False).to_numpy(zero_copy_only=False), bool)
            kept.append(stay)
            return stay if "blocks" in self._columns else np.zeros(len(stay), bool)

        with ExitStack() as stack:
            for part in chains.items_of(span, scan.Options(wanted=wanted), None, stack, whole=True):
                failed = part.filter(pc.is_valid(part["error"]))
                if failed.num_rows:
                    raise ValueError(f"{failed['error'][0].as_py()} at byte {failed['offset'][0].as_py()} of {span[1]}")
                rows = part.filter(pc.equal(part["kind"], "chain"))
                rows = rows.filter(pa.array(kept.pop()[: rows.num_rows]))
                yield from (rows.slice(at, scan.BATCH_ROWS).select(self._columns) for at in range(0, rows.num_rows, scan.BATCH_ROWS))


class FilteringChainReader(ChainReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            found = predicate(f)
            if found is None:
                yield f
            else:
                self._predicates.append(found)


class ChainSource(ds.DataSource):
    """Chains of the files or folders that load() names, in file order within a partition, which has neighbouring byte ranges.

    Filters on header columns are pushed: rows that they reject never leave the reader,
    and their blocks are not even parsed (so faults in them go unseen). With a schema
    that leaves `blocks` out, no blocks are. A header without an id has a null id here;
    chains.read() numbers them. Options: range_bytes, the size of a range; pushdown.

    Spark keeps pushed filters with the relation that load() made, and a later query of
    the same relation without any filter still gets them (seen in 4.1.2). So load() anew
    for each query, or say option("pushdown", "false"): then Spark filters the rows, and
    a relation may be used again and again.
    """

    @classmethod
    def name(cls) -> str:
        return "chain"

    def schema(self) -> str:
        return CHAINS

    def reader(self, schema) -> ChainReader:
        named = self.options.get("paths")
        given = json.loads(named) if named else [self.options["path"]]
        paths = [file for path in given for file in (part_files(path) if chains.is_folder(path) else [path])]
        known = [c.split()[0] for c in CHAINS.split(", ")]
        unknown = [c for c in schema.names if c not in known]
        if unknown:
            raise ValueError(f"chains have no columns {unknown}")
        reader = ChainReader if self.options.get("pushdown", "true").lower() == "false" else FilteringChainReader
        return reader(paths, schema.names, int(self.options.get("range_bytes", chains.RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    """Makes format("chain") known to the session and lets filters be pushed into Python sources, which Spark asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChainSource)
