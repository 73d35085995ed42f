"""Chains as text: a record is rendered as a column, without its final newline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.functions import blocks as B


def header(chain_id: Column | None = None, always_plus: bool = False) -> Column:
    """The header line; chain_id replaces the id; always_plus writes + for the reference strand whatever it is."""
    c = F.col
    parts = [F.lit("chain"), c("score"), c("r_name"), c("r_size"), F.lit("+") if always_plus else c("r_strand"), c("r_start"), c("r_end"), c("q_name"), c("q_size"), c("q_strand"), c("q_start"), c("q_end"), c("id") if chain_id is None else chain_id]
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def dense_lines(blocks: Column) -> Column:
    text = lambda b, *f: F.concat_ws("\t", *[b[x].cast("string") for x in f])
    line = lambda b, i: F.when(i + 1 < F.size(blocks), text(b, "size", "gap_reference", "gap_query")).otherwise(b["size"].cast("string"))
    return F.array_join(F.transform(blocks, line), "\n")


def long_lines(blocks: Column) -> Column:
    """Absolute blocks as: target start, query start, size and, but for the last, both gaps."""
    def of(placed):
        def line(b, i):
            after = F.try_element_at(placed, i + 2)
            head = [b["r_start"], b["q_start"], b["r_end"] - b["r_start"]]
            gaps = [after["r_start"] - b["r_end"], after["q_start"] - b["q_end"]]
            return F.concat_ws("\t", *[x.cast("string") for x in head + gaps])  # nulls after the last block are left out

        return F.array_join(F.transform(placed, line), "\n")

    return B.let(blocks, of)


def record(chain_id: Column | None = None, always_plus: bool = False, long: bool = False) -> Column:
    """A record with its blank line; one more newline, which text sinks add, ends it."""
    body = long_lines(B.absolute(F.col("blocks"), F.col("r_start"), F.col("q_start"))) if long else dense_lines(F.col("blocks"))
    return F.concat(header(chain_id, always_plus), F.lit("\n"), body, F.lit("\n"))


def record_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long") + 1


def metadata(line: Column) -> Column:
    return F.when(line.contains("\n"), F.raise_error(F.lit("metadata lines hold no newline")).cast("string")).otherwise(line)


def write(lines: DataFrame, path: str, gzip: bool = False, overwrite: bool = False) -> None:
    """Writes the one string column of lines as text parts in their present order; an existing path is an error unless overwrite."""
    writer = lines.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("compression", "gzip") if gzip else writer).text(path)
