"""Registered queries over files: the tables' chains and sequences are written in their file formats and read back."""

from __future__ import annotations

import contextlib
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignloom.functions import blocks, gaps
from alignloom.functions import sql as functions
from alignloom.operators import bed, files, ordering, render, scoring, split
from alignloom.plans.queries import _DENSE, _HEADER_SQL, _cost_cte, _grid, AB, BASE, GRID, HEAD, MIXED, RECURSIVE, SCORE, SHUFFLE, WITH, _query
from alignloom.plans.universe import ALPHABET, chains, sequences
from alignloom.sources import chains as texts
from alignloom.sources import datasource, index
from alignloom.sources import sequences as files_of_bases
from alignloom.storage import checkpointed, fresh, opened, part_files
from alignloom.streaming.ingest import ingest

#: Ranges are small, so that the small tables' files have hundreds of cuts; ranges_of() makes those of large files longer.
RANGE = 20_000
#: Chains of a text file that a task writes, and the files at least.
FILE_ROWS, LEAST_FILES = 500_000, 4
_RECORD = f"concat({_HEADER_SQL.format(id='id')}, chr(10), body, chr(10), chr(10))"
_HEADS = f"SELECT {', '.join(HEAD)} FROM ch"
#: Lines before every fiftieth chain, in SQL and as columns.
_NOTED = "CASE WHEN id % 50 = 1 THEN concat('#note ', id, chr(10)) ELSE '' END"


def _noted() -> Column:
    return F.when(F.col("id") % 50 == 1, F.concat(F.lit("#note "), F.col("id").cast("string"), F.lit("\n"))).otherwise("")


def _written(rows: DataFrame, value: Column, gzip: bool = False) -> list[str]:
    """The files of a folder that the rows' text is written to, in order of offset."""
    folder = fresh(rows.sparkSession, "texts")
    parts = max(LEAST_FILES, -(-rows.count() // FILE_ROWS))
    laid = rows.repartitionByRange(parts, "offset").sortWithinPartitions("offset")  # the exchange takes a sample first, which would make all text once more
    render.write(laid.select(value.alias("value")), folder, gzip)
    return part_files(folder, ".gz" if gzip else ".txt")


def _table(df: DataFrame) -> DataFrame:
    """df, computed now: it reads files that may not be there for ever."""
    return checkpointed(df)


@_query("text_ranges", f"{WITH} {_HEADS}")
def text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with metadata between them, in byte ranges."""
    paths = _written(chains(spark, sf_dir), F.concat(_noted(), render.record()))
    return texts.read(spark, paths, range_bytes=RANGE).select(*HEAD)


@_query("text_blocks", f"{WITH} SELECT id, CAST(n-1 AS BIGINT) block_no, size, CAST(gr AS BIGINT) gap_reference, CAST(gq AS BIGINT) gap_query FROM b JOIN ch USING (k)")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block lines in byte ranges."""
    rows = texts.read(spark, _written(chains(spark, sf_dir), render.record()), range_bytes=RANGE)
    return rows.select("id", F.posexplode("blocks").alias("block_no", "b")).select("id", F.col("block_no").cast("bigint").alias("block_no"), "b.*")


@_query("text_unruly", f"{WITH} {_HEADS}")
def text_unruly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriage returns, indented headers, tabs for spaces, further words, blank lines of white space."""
    record = F.concat(F.when(F.col("id") % 3 == 0, "\t ").otherwise(""), render.header(), F.lit(" further words\n"), render.dense_lines(F.col("blocks")), F.lit("\n \t\n"))
    unruly = F.when(F.col("id") % 2 == 0, F.regexp_replace(record, "\n", "\r\n")).otherwise(F.regexp_replace(record, " ", "\t"))
    return texts.read(spark, _written(chains(spark, sf_dir), unruly), range_bytes=RANGE).select(*HEAD)


@_query("text_gzip", f"{WITH} {_HEADS}")
def text_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip sink and source."""
    return texts.read(spark, _written(chains(spark, sf_dir), render.record(), gzip=True)).select(*HEAD)


@_query("text_memory", f"{WITH} SELECT k//40 AS text, {', '.join(HEAD)} FROM ch")
def text_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of texts that rows hold, some dozens in each."""
    records = F.transform(F.array_sort(F.collect_list(F.struct("offset", "record"))), lambda x: x["record"])
    held = chains(spark, sf_dir).select(F.expr("offset div 40").alias("text"), "offset", render.record().alias("record")).groupBy("text").agg(F.array_join(records, "\n").alias("body"))
    return texts.of_texts(held, "text", "body").filter("kind = 'chain'").select(F.col("of").alias("text"), *HEAD)


@_query("text_metadata", f"{WITH} SELECT concat('#note ', id) line FROM ch WHERE id % 50 = 1")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata lines among chains."""
    paths = _written(chains(spark, sf_dir), F.concat(F.when(_noted() == "", "").otherwise(F.concat(render.metadata(F.regexp_replace(_noted(), "\n", "")), F.lit("\n"))), render.record()))
    return texts.metadata(texts.read_items(spark, paths, range_bytes=RANGE)).select("line")


@_query("text_generated_ids", f"{WITH} SELECT k, CASE WHEN k % 3 = 0 THEN CAST(row_number() OVER (PARTITION BY k % 3 = 0 ORDER BY k) AS BIGINT) ELSE id END id FROM ch")
def text_generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without an id are numbered through files and ranges; the name carries the chain's key."""
    rows = chains(spark, sf_dir).withColumn("r_name", F.col("offset").cast("string"))
    paths = _written(rows, render.record(F.when(F.col("offset") % 3 != 0, F.col("id"))))  # a null id is left out
    return texts.read(spark, paths, range_bytes=RANGE).select(F.col("r_name").cast("bigint").alias("k"), F.col("id").cast("bigint").alias("id"))


_PLACED = f"""{WITH}{_DENSE}, o AS (SELECT k, id, {_NOTED} note, {_RECORD} rec FROM ch JOIN tx USING (k)),
pl AS (SELECT k, id, strlen(note) nl, strlen(rec) rl, coalesce(sum(strlen(note) + strlen(rec)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pos FROM o)"""


@_query("text_spans", f"{_PLACED} SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1 ordinal, CAST(pos + nl AS BIGINT) \"offset\", CAST(rl AS BIGINT) length FROM pl")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte spans of all records of one file put together from parts."""
    return texts.spans(spark, _whole(spark, sf_dir), range_bytes=RANGE).select("ordinal", "offset", "length")


def _one_file(spark: SparkSession, rows: DataFrame, value: Column, name: str, cut: int = 0, tail: str = "") -> list[str]:
    """The rows' text in order of offset as one file, without its last `cut` bytes, then tail."""
    paths = _written(rows, value)
    sizes = [files._size(p) for p in paths]
    last = max(i for i, n in enumerate(sizes) if n)
    pieces = [(f"{name}.chain", i, p, 0, n - (cut if i == last else 0), tail.encode() if i == len(paths) - 1 else None) for i, (p, n) in enumerate(zip(paths, sizes))]
    folder = fresh(spark, name)
    files.assemble(spark.createDataFrame(pieces, "name string, seq int, path string, offset bigint, length bigint, tail binary"), folder).collect()
    return part_files(folder)


def _whole(spark: SparkSession, sf_dir: str) -> list[str]:
    """The chains' text with metadata as one file."""
    return _one_file(spark, chains(spark, sf_dir), F.concat(_noted(), render.record()), "whole")


@_query("text_chain_bytes", f"{WITH}{_DENSE}, o AS (SELECT {_RECORD} rec, CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1 ordinal FROM ch JOIN tx USING (k)) SELECT ordinal, md5(rec) digest FROM o WHERE ordinal % 50 = 0")
def text_chain_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every fiftieth record, by ordinal in a kept index; each costs a search of the index and one read."""
    paths, kept = _whole(spark, sf_dir), fresh(spark, "index")
    index.write(texts.spans(spark, paths, range_bytes=RANGE), kept)
    wanted = spark.range(0, index.size(kept), 50).select(F.col("id").alias("ordinal"))
    return index.fetched(wanted, kept, paths).select("ordinal", F.md5("record").alias("digest"))


_HEAD_SQL = _HEADER_SQL.format(id="id")


@_query("text_faults", f"""{WITH}{_DENSE}, x AS (SELECT id, {_HEAD_SQL} h, id % 12 f FROM ch) SELECT id, CASE f WHEN 1 THEN 'expected a chain header' WHEN 2 THEN 'chain header is missing fields' WHEN 3 THEN 'score is not a 64-bit number' WHEN 4 THEN 'strand is neither + nor -'
 WHEN 5 THEN 'reference size exceeds u32' WHEN 6 THEN 'id exceeds u64' WHEN 7 THEN 'block line missing dq value' WHEN 9 THEN 'chain without any alignment blocks' WHEN 11 THEN 'query end is not a number' ELSE 'block value is not a number' END error,
 CAST(CASE WHEN f BETWEEN 1 AND 6 OR f = 11 THEN 0 ELSE length(h) + 1 END AS BIGINT) error_offset FROM x WHERE f <> 0""")
def text_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain's text with a fault of its own kind, and what the reader says of it and where."""
    head, body, word = render.header(), render.dense_lines(F.col("blocks")), lambda n, x: F.regexp_replace(render.header(), rf"^((?:\S+ ){{{n}}})\S+", rf"$1{x}")
    last = F.regexp_replace(render.header(), r"\S+$", "18446744073709551616")
    kinds = [
        F.concat(F.lit("rubbish\n"), head), F.concat(F.regexp_extract(head, r"^(\S+ ){6}", 0), F.lit("\n9\n")), word(1, "x"), word(4, "*"), word(3, "4294967296"), last, F.concat(head, F.lit("\n9 1\n"), body),
        F.concat(head, F.lit("\n+9\n"), body), F.concat(head, F.lit("\n\n")), F.concat(head, F.lit("\n#9\n"), body), word(11, "-9"),
    ]
    text = F.lit(None).cast("string")
    for k, broken in enumerate(kinds, 1):
        text = F.when(F.col("id") % 12 == k, F.concat(broken, F.lit("\n"))).otherwise(text)
    rows = chains(spark, sf_dir).select("id", F.coalesce(text, F.concat(head, F.lit("\n"), body, F.lit("\n"))).alias("text"))
    return texts.of_texts(rows.repartition("id"), "id", "text").filter("kind = 'error'").select(F.col("of").alias("id"), "error", "error_offset")


@_query("records_broken", f"""{WITH}{_DENSE}, x AS (SELECT id, {_HEAD_SQL} h, body, id % 5 f FROM ch JOIN tx USING (k)), y AS (SELECT f, id, strlen(h) + strlen(body) + 3 n, strlen(h) h, row_number() OVER (PARTITION BY f ORDER BY id) i FROM x),
z AS (SELECT f, CAST(sum(n) AS BIGINT) before, max(i) last FROM y WHERE f > 0 GROUP BY f) SELECT CAST(f AS INT) kind, before + CASE f WHEN 2 THEN -1 ELSE 0 END AS "offset",
CASE f WHEN 1 THEN 'expected a chain header or metadata line' WHEN 2 THEN 'missing blank line between chain records' WHEN 3 THEN 'metadata line inside chain record' ELSE 'expected a chain header or metadata line' END message FROM z""".replace("before + CASE f WHEN 2 THEN -1 ELSE 0 END", "before + CASE WHEN f IN (2, 3) THEN -1 ELSE 0 END"))
def records_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of whole records that end in a broken one; the scan of records says what is wrong, and where."""
    found = []
    tails = {1: "stray\n\n", 2: "chain 1 c 9 + 0 9 q 9 + 0 9 1\n9\n\n", 3: "#note\n\n", 4: " chain 1 c 9 + 0 9 q 9 + 0 9 1\n9\n\n"}
    for kind, tail in tails.items():
        path = _one_file(spark, chains(spark, sf_dir).filter(F.col("id") % 5 == kind), render.record(), "broken", cut=1 if kind in (2, 3) else 0, tail=tail)
        try:
            texts.entries(spark, path, range_bytes=RANGE)
        except ValueError as fault:
            message, at = str(fault).split(" of ")[0].rsplit(" at byte ", 1)
            found.append((kind, int(at), message))
    return spark.createDataFrame(found, "kind int, offset bigint, message string")


@_query("text_stream", f"{WITH} {_HEADS}")
def text_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: a folder of files as a stream, until none is left."""
    paths = _written(chains(spark, sf_dir), render.record())
    out, marks = fresh(spark, "stream"), fresh(spark, "marks")
    ingest(spark, paths[0].rsplit("/", 1)[0], out, marks, 2, RANGE).awaitTermination()
    return spark.read.parquet(out).select(*HEAD)


_SEQUENCES = f"""{WITH}, nm AS (SELECT DISTINCT 'reference' side, r_name AS name FROM ch UNION SELECT DISTINCT 'query', q_name FROM ch),
np AS (SELECT *, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) + CASE WHEN name LIKE '%#_random' ESCAPE '#' THEN 100 WHEN name LIKE '%#_alt' ESCAPE '#' THEN 200 ELSE 0 END + CASE side WHEN 'query' THEN 300 ELSE 0 END p FROM nm),
sq AS (SELECT side, name, string_agg(substr('{ALPHABET}', CAST(((p*1103515245 + i*12345)//65536) % 14 AS INT)+1, 1), '' ORDER BY i) seq FROM np, range(0, 10000) r(i) GROUP BY side, name)"""


def _bases_in(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """FASTA files of the fixture's sequences, one for each side, as tasks write them."""
    made = []
    for side in ("reference", "query"):
        rows = sequences(spark, sf_dir).filter(F.col("side") == side).select(F.row_number().over(Window.orderBy("name", "bin")).alias("offset"), "name", "bin", "seq")
        wrapped = F.regexp_replace("seq", "(.{60})(.{60})", "$1\n$2\r\n")
        made += _one_file(spark, rows, F.concat(F.when(F.col("bin") == 0, F.concat(F.lit(">"), "name", F.lit(" made\n"))).otherwise(""), wrapped), side)
    return tuple(made)


def _twobit_in(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """2bit files of the fixture's sequences; a few hundred kB, put together here as an index of all records heads the format."""
    rows, folder = sequences(spark, sf_dir).orderBy("side", "name", "bin").collect(), fresh(spark, "bases")
    system, inner = files.opened(folder)
    system.create_dir(inner)
    for side in ("reference", "query"):
        held: dict[str, str] = {}
        for r in rows:
            if r["side"] == side:
                held[r["name"]] = held.get(r["name"], "") + r["seq"]
        with system.open_output_stream(f"{inner}/{side}.2bit", compression=None) as out:
            out.write(files_of_bases.to_twobit(held))
    return f"{folder}/reference.2bit", f"{folder}/query.2bit"


def _digests(found: DataFrame) -> DataFrame:
    whole = found.groupBy("side", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return _table(whole.select("side", "name", F.length("seq").cast("bigint").alias("length"), F.md5("seq").alias("digest")))


def _loaded(spark: SparkSession, paths: tuple[str, str], names: DataFrame | None = None) -> DataFrame:
    r, q = (files_of_bases.load(spark, p, side, names, range_bytes=RANGE) for p, side in zip(paths, ("reference", "query")))
    return r.unionByName(q)


@_query("fasta_sequences", f"{_SEQUENCES} SELECT side, name, CAST(length(seq) AS BIGINT) length, md5(seq) digest FROM sq")
def fasta_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13, S16, S19."""
    return _digests(_loaded(spark, _bases_in(spark, sf_dir)))


@_query("twobit_sequences", f"{_SEQUENCES} SELECT side, name, CAST(length(seq) AS BIGINT) length, md5(seq) digest FROM sq")
def twobit_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S14."""
    return _digests(_loaded(spark, _twobit_in(spark, sf_dir)))


@_query("twobit_named", f"{_SEQUENCES} SELECT side, name, CAST(length(seq) AS BIGINT) length, md5(seq) digest FROM sq WHERE name IN ('chr3', 'qry2')")
def twobit_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the named sequences are decoded."""
    names = spark.createDataFrame([("chr3",), ("qry2",)], "name string")
    return _digests(_loaded(spark, _twobit_in(spark, sf_dir), names))


@_query("sequence_fetch", f"{_SEQUENCES} SELECT name, substr(seq, 4001, 300) bases FROM sq WHERE name IN ('chr1', 'qry1')")
def sequence_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S18."""
    held = sequences(spark, sf_dir)
    return spark.createDataFrame([(n, files_of_bases.fetch(held, side, n, 4000, 300)) for side, n in (("reference", "chr1"), ("query", "qry1"))], "name string, bases string")


@_query("sequence_lengths", f"{_SEQUENCES} SELECT side, name, CAST(length(seq) AS BIGINT) length FROM sq")
def sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S19."""
    return files_of_bases.lengths(sequences(spark, sf_dir))


@_query("matrix_file", f"""{WITH}{AB}{BASE}, mt AS (SELECT substr('ACGT', CAST(n_nationkey // 4 AS INT) + 1, 1) || substr('ACGT', CAST(n_nationkey % 4 AS INT) + 1, 1) x, n_nationkey * 7 - n_regionkey * 20 v FROM nation WHERE n_nationkey < 16)
SELECT id, CAST(sum(coalesce(v, 0)) AS BIGINT) matches FROM ba LEFT JOIN mt ON x = upper(q) || upper(t) GROUP BY id""")
def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chains' bases by a matrix file whose scores the table of nations gives."""
    found = {r["n_nationkey"]: r["n_nationkey"] * 7 - r["n_regionkey"] * 20 for r in spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 16").collect()}
    lines = ["# scores", "gap = 400", "   A   C   G   T", *(f"{'' if i == 2 else x} " + " ".join(str(found[4 * i + k]) for k in range(4)) for i, x in enumerate("ACGT"))]
    matrix = files_of_bases.score_matrix("\n".join(lines) + "\n")
    return scoring.counted(chains(spark, sf_dir), sequences(spark, sf_dir), matrix).select("id", "counts.matches")


_GAP_FILE = "tablesize 4\nsmallSize 3\nposition 1 3 10 100\nqGap 10 30 100 1000\ntGap 20 60 200 2000\nbothGap 15 45 150 1500\n"
_SMALL = "SELECT i, dq % 300 dq, dt % 300 dt FROM ({grid})"


@_query("gap_file", f"""WITH g AS ({_SMALL.format(grid=GRID)}), h AS (SELECT *, dq + dt x, CASE WHEN dt = 0 THEN 10.0 WHEN dq = 0 THEN 20.0 ELSE 15.0 END u FROM g)
SELECT i, CAST(trunc(CASE WHEN x < 3 THEN u*x WHEN x < 10 THEN 3*u + 7*u*(x-3)/7 WHEN x < 100 THEN 10*u + 90*u*(x-10)/90 ELSE 100*u + u*(x-100) END) AS BIGINT) AS cost FROM h""")
def gap_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the orders by a table from a file."""
    table = gaps.parsed(_GAP_FILE)
    grid = _grid(spark, sf_dir).select("i", (F.col("dq") % 300).alias("dq"), (F.col("dt") % 300).alias("dt"))
    return grid.select("i", F.expr(gaps.cost_sql("dq", "dt", table)).alias("cost"))


@_query("split_bytes", f"""{WITH}{_DENSE}, o AS (SELECT k, concat({_NOTED}, {_RECORD}) piece, CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1 i, count(*) OVER () total FROM ch JOIN tx USING (k)),
nx AS (SELECT *, CASE WHEN i = 0 THEN piece ELSE substr(piece, CASE WHEN piece LIKE '#%' THEN strpos(piece, chr(10)) + 1 ELSE 1 END) END own, lead(CASE WHEN piece LIKE '#%' THEN substr(piece, 1, strpos(piece, chr(10))) ELSE '' END) OVER (ORDER BY i) trail FROM o),
f AS (SELECT unnest(range(0, 7)) f) SELECT concat('part.', lpad(CAST(f+1 AS VARCHAR), 5, '0'), '.whole.chain') AS name, md5(string_agg(concat(own, trail), '' ORDER BY i)) digest FROM nx JOIN f ON i >= (f*total)//7 AND i < ((f+1)*total)//7 GROUP BY f""")
def split_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input's own bytes in parts, metadata after a chain with that chain."""
    folder = fresh(spark, "parts")
    files.split_files(spark, _whole(spark, sf_dir), folder, files=7).collect()
    return _content(spark, folder)


def _content(spark: SparkSession, folder: str) -> DataFrame:
    """The name and digest of each file of a folder, read a step at a time by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                digest = hashlib.md5()
                system, inner = opened(path)
                with system.open_input_file(inner) as raw:
                    while part := raw.read(files.STEP):
                        digest.update(part)
                yield pa.RecordBatch.from_pydict({"name": [path.rsplit("/", 1)[1]], "digest": [digest.hexdigest()]})

    paths = spark.createDataFrame([(p,) for p in part_files(folder)], "path string")
    return _table(paths.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, "name string, digest string"))


@_query("merge_bytes", f"""{WITH}{_DENSE}, o AS (SELECT k, {_RECORD} rec, id % 2 half FROM ch JOIN tx USING (k)), h AS (SELECT half, string_agg(rec, '' ORDER BY k) txt FROM o GROUP BY half)
SELECT concat('part.', lpad(CAST(half + 1 AS VARCHAR), 5, '0'), '.half.chain') AS name, md5(CASE half WHEN 0 THEN txt ELSE rtrim(txt, chr(10)) END) digest FROM h""")
def merge_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: inputs without a last newline, byte by byte, a blank line between them."""
    paths = [p for half in (0, 1) for p in _one_file(spark, chains(spark, sf_dir).filter(F.col("id") % 2 == half), render.record(), "half", cut=2)]
    merged = fresh(spark, "merged")
    files.merge_files(spark, paths, merged).collect()
    return _content(spark, merged)


def _command(spark: SparkSession, *argv: str) -> None:
    from alignloom.__main__ import parser, run

    with contextlib.redirect_stderr(io.StringIO()):
        run(spark, parser().parse_args(list(argv)))


def _records_of(spark: SparkSession, folder: str) -> DataFrame:
    """The place and digest of each record of a folder's files, by name, as tasks read them."""
    found = texts.raw(spark, part_files(folder), range_bytes=RANGE)
    return _table(found.select("ordinal", F.md5("record").alias("digest")))


_PLUS = _RECORD.replace("r_strand", "'+'")


@_query("command_filter", f"{WITH}{_DENSE} SELECT CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1 ordinal, md5({_PLUS}) digest FROM ch JOIN tx USING (k) WHERE score >= 20000 AND score < 200000")
def command_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's filter, text to text; metadata goes."""
    out = fresh(spark, "filtered")
    _command(spark, "filter", "-c", *_whole(spark, sf_dir), "-o", out, "--min-score", "20000", "--max-score", "200000")
    return _records_of(spark, out)


@_query("command_sort", f"{WITH}{_DENSE} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) - 1 ordinal, md5({_RECORD}) digest FROM ch JOIN tx USING (k) UNION ALL SELECT -CAST(row_number() OVER (ORDER BY id DESC) AS BIGINT), md5(concat('#note ', id)) FROM ch WHERE id % 50 = 1")
def command_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's sort; metadata comes first, numbered backwards from the first record."""
    out = fresh(spark, "sorted")
    _command(spark, "sort", "-c", *_whole(spark, sf_dir), "-o", out, "-s", "score")
    lines = texts.metadata(texts.read_items(spark, part_files(out), range_bytes=RANGE))
    placed = ordering.ranked(lines, [F.col("file_no").desc(), F.col("offset").desc()])
    return _records_of(spark, out).unionByName(placed.select((-F.col("rank")).alias("ordinal"), F.md5("line").alias("digest")))


@_query("command_bed", f"{WITH} SELECT concat_ws(chr(9), q_name, q_start, q_end, concat('chain_', id), 0, q_strand) AS line FROM ch")
def command_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's BED6 of the query side, from a list of paths."""
    out = fresh(spark, "bed")
    _command(spark, "bed", "-c", *_whole(spark, sf_dir), "-o", out, "--side", "query", "--type", "6", "--spanned")
    return spark.read.text(out).withColumnRenamed("value", "line")


@_query("command_score", f"{SCORE} SELECT CAST(row_number() OVER (ORDER BY sc.score DESC, k) AS BIGINT) - 1 ordinal, id, sc.score FROM sc JOIN ch USING (id) WHERE sc.score >= -3000")
def command_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's score, sorted, over sequences in FASTA."""
    out, (reference, query) = fresh(spark, "scored"), _bases_in(spark, sf_dir)
    _command(spark, "score", "-c", *_whole(spark, sf_dir), "-o", out, "-r", reference, "-q", query, "-m", "-3000", "--sort-by-score")
    rows = texts.read_items(spark, part_files(out), range_bytes=RANGE).filter("kind = 'chain'")
    return ordering.ranked(rows, [F.col("file_no").asc(), F.col("offset").asc()]).select((F.col("rank") - 1).alias("ordinal"), "id", "score")


@_query("command_split", f"{WITH}{_DENSE}, o AS (SELECT k, {_RECORD} rec, (CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1)//400 part FROM ch JOIN tx USING (k)) SELECT concat('part.', lpad(CAST(part+1 AS VARCHAR), 5, '0'), '.plain.chain') AS name, md5(string_agg(rec, '' ORDER BY k)) digest FROM o GROUP BY part")
def command_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's split by chunks."""
    out = fresh(spark, "chunks")
    _command(spark, "split", "-c", *_one_file(spark, chains(spark, sf_dir), render.record(), "plain"), "-o", out, "--chunks", "400")
    return _content(spark, out)


_BLOCK_CASE = "SELECT CAST(o_orderkey AS BIGINT) k, CAST(o_orderkey % 50 AS BIGINT) rs, CAST(o_orderkey % 50 + o_orderkey % 9 - 1 AS BIGINT) re, CAST(o_orderkey % 70 AS BIGINT) qs, CAST(o_orderkey % 70 + (o_orderkey * 3) % 9 - 1 AS BIGINT) qe FROM orders"


@_query("block_lengths", f"WITH x AS ({_BLOCK_CASE}) SELECT k, greatest(re-rs, 0) reference_length, greatest(qe-qs, 0) query_length, CASE WHEN greatest(re-rs, 0) = greatest(qe-qs, 0) THEN greatest(re-rs, 0) END aligned_length, re > rs AND re-rs = greatest(qe-qs, 0) gapless FROM x")
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3."""
    x = spark.sql(_BLOCK_CASE.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    b = F.struct(F.col("rs").alias("r_start"), F.col("re").alias("r_end"), F.col("qs").alias("q_start"), F.col("qe").alias("q_end"))
    return x.select("k", b.alias("b")).select("k", blocks.reference_length(F.col("b")).alias("reference_length"), blocks.query_length(F.col("b")).alias("query_length"), blocks.aligned_length(F.col("b")).alias("aligned_length"), blocks.is_gapless(F.col("b")).alias("gapless"))


@_query("absolute_block_faults", f"""{WITH}{AB}, x AS (SELECT id, n, m, size, rs + CASE WHEN id % 7 = 1 AND n = 1 THEN size ELSE 0 END a, rs + size b, qs + CASE WHEN id % 7 = 1 AND n = 1 THEN 0 WHEN id % 7 = 2 AND n = 1 THEN size WHEN id % 7 = 3 AND n = m THEN 1 ELSE 0 END c, qs + size d FROM ab),
y AS (SELECT *, CASE WHEN id % 7 = 4 AND n = 1 THEN b + 900 ELSE b END e, CASE WHEN id % 7 = 4 AND n = 1 THEN d + 900 ELSE d END f FROM x),
z AS (SELECT *, lead(a) OVER w na, lead(c) OVER w nc FROM y WINDOW w AS (PARTITION BY id ORDER BY n))
SELECT id, CASE WHEN bool_or(e <= a) THEN 'reference interval of a block is empty or inverted' WHEN bool_or(f <= c) THEN 'query interval of a block is empty or inverted' WHEN bool_or(e-a <> f-c) THEN 'block lengths of both sides differ'
 WHEN bool_or(coalesce(na < e, false)) THEN 'blocks overlap on the reference' WHEN bool_or(coalesce(nc < f, false)) THEN 'blocks overlap on the query' END fault FROM z GROUP BY id""")
def absolute_block_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7, V8."""
    rows = chains(spark, sf_dir).withColumn("a", blocks.absolute(F.col("blocks"), F.col("r_start"), F.col("q_start")))
    case = F.col("id") % 7

    def broken(b, i):
        first, last = i == 0, i == F.size("a") - 1
        more = F.when((case == 4) & first, 900).otherwise(0)
        size = b["r_end"] - b["r_start"]
        return F.struct(
            (b["r_start"] + F.when((case == 1) & first, size).otherwise(0)).alias("r_start"), (b["r_end"] + more).alias("r_end"),
            (b["q_start"] + F.when((case == 2) & first, size).when((case == 3) & last, 1).otherwise(0)).alias("q_start"), (b["q_end"] + more).alias("q_end"),
        )

    return rows.select("id", blocks.absolute_faults(F.transform("a", broken)).alias("fault"))


@_query("from_absolute_blocks", f"{WITH} SELECT id, r_start, r_end, q_start, q_end, nb n_blocks FROM ch")
def from_absolute_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: chains made from absolute blocks have the blocks' spans."""
    rows = chains(spark, sf_dir).withColumn("absolute", blocks.absolute(F.col("blocks"), F.col("r_start"), F.col("q_start"))).drop("blocks", "r_start", "r_end", "q_start", "q_end")
    return blocks.from_absolute(rows, "absolute").select("id", "r_start", "r_end", "q_start", "q_end", F.size("blocks").cast("bigint").alias("n_blocks"))


@_query("bed_faults", f"""{WITH} SELECT k, CASE WHEN k % 4 = 1 THEN 'chain side span is empty or inverted' WHEN k % 4 = 2 THEN 'chain block coordinates do not match header end' END fault FROM ch""")
def bed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5, V6."""
    end = F.expr("CASE offset % 4 WHEN 1 THEN r_start WHEN 2 THEN r_end + 1 ELSE r_end END")
    return chains(spark, sf_dir).withColumn("r_end", end).select(F.col("offset").alias("k"), bed.fault("reference").alias("fault"))


@_query("header_lines", f"{WITH} SELECT id, {_HEADER_SQL.format(id='id').replace('r_strand', chr(39) + '+' + chr(39))} AS line, {_HEADER_SQL.format(id='id + 1000')} renamed FROM ch")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3, K5."""
    return chains(spark, sf_dir).select("id", render.header(always_plus=True).alias("line"), render.header(F.col("id") + 1000).alias("renamed"))


@_query("splitmix64", f"WITH {MIXED.format(seed='1234567::UHUGEINT', number='i', source='(SELECT CAST(o_orderkey AS UHUGEINT) i, 0 n FROM orders)')} SELECT CAST(i AS BIGINT) i, CAST(z AS VARCHAR) AS value FROM mx")
def splitmix64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each order the number that the generator gives at its place."""

    @F.pandas_udf("string")
    def drawn(i: pd.Series) -> pd.Series:
        return pd.Series(split.draws(1234567, i.to_numpy())).astype(str)

    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"), drawn("o_orderkey").alias("value"))


@_query("score_blocks", f"{SCORE} SELECT id, score FROM sc")
def score_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chains' absolute blocks over the bases of both sequences, whose chunks the blocks' pieces meet."""
    placed = blocks.absolute(F.col("blocks"), F.col("r_start"), F.col("q_start")).alias("absolute")
    rows = chains(spark, sf_dir).select("file_no", "offset", "id", "r_name", "q_name", "q_size", "q_strand", placed)
    return scoring.absolute_scored(rows, "absolute", sequences(spark, sf_dir)).select("id", "score")


@_query("split_shuffled", f"{RECURSIVE}{SHUFFLE} SELECT place, ordinal FROM pm")
def split_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The permutation of all chains by seed 42."""
    return split.permutation(spark, chains(spark, sf_dir).count(), 42)


@_query("source_pushdown", f"{WITH} {_HEADS} WHERE score >= 50000 AND score < 200000 AND r_name IN ('chr1', 'chr2', 'chr3_random') AND q_strand = '-' AND r_start > 100 AND NOT q_name = 'qry3'")
def source_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source, with filters that it takes over."""
    datasource.register(spark)
    folder = _written(chains(spark, sf_dir), F.concat(_noted(), render.record()))[0].rsplit("/", 1)[0]
    rows = spark.read.format("chain").option("range_bytes", RANGE).load(folder)
    return rows.filter("score >= 50000 and score < 200000 and r_name in ('chr1', 'chr2', 'chr3_random') and q_strand = '-' and r_start > 100 and q_name <> 'qry3'").select(*HEAD)


@_query("source_columns", f"{WITH} SELECT r_name, CAST(count(*) AS BIGINT) n, CAST(max(score) AS BIGINT) best FROM ch WHERE q_name LIKE 'qry1%' GROUP BY r_name")
def source_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema without blocks."""
    datasource.register(spark)
    folder = _written(chains(spark, sf_dir), render.record())[0].rsplit("/", 1)[0]
    rows = spark.read.format("chain").schema("r_name string, q_name string, score bigint").option("range_bytes", RANGE).load(folder)
    return rows.filter(F.col("q_name").startswith("qry1")).groupBy("r_name").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@_query("sql_functions", f"""{WITH}{AB}{_cost_cte('medium', '(SELECT id, CAST(gq AS BIGINT) dq, CAST(gr AS BIGINT) dt FROM ab WHERE n < m)')}, gs AS (SELECT id, CAST(sum(cost) AS BIGINT) gaps FROM gc GROUP BY id){_DENSE}
SELECT id, coalesce(gaps, 0) gaps, md5({_RECORD}) record, {_HEAD_SQL} AS line, reverse(translate(r_name, 'ACGTacgtRYKMBVDHrykmbvdh', 'TGCAtgcaYRMKVBHDyrmkvbhd')) turned FROM ch JOIN tx USING (k) LEFT JOIN gs USING (id)""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of spark.sql, over a view of the chains."""
    functions.register(spark)
    fields = "score, r_name, r_size, r_strand, r_start, r_end, q_name, q_size, q_strand, q_start, q_end, id"
    return spark.sql(f"""SELECT id, gaps, md5(concat(chain_record({fields}, blocks), '\\n')) record, chain_header({fields}) line, reverse_complement(r_name) turned
    FROM (SELECT *, coalesce((SELECT sum(gap_cost_medium(b.gap_query, b.gap_reference)) FROM (SELECT explode(slice(blocks, 1, size(blocks) - 1)) b)), 0) gaps FROM {{chains}})""", chains=chains(spark, sf_dir))


@_query("text_gzip_blocks", f"{WITH} {_HEADS}")
def text_gzip_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzip written in blocks and read by ranges of its text."""
    folder = fresh(spark, "packed")
    files.merge_files(spark, _whole(spark, sf_dir), folder, gzipped=True).collect()
    return texts.read(spark, part_files(folder), range_bytes=RANGE * 10).select(*HEAD)


@_query("sort_ties", f"{WITH}, bs AS (SELECT k, list({{'size': size, 'gr': gr, 'gq': gq}} ORDER BY n) bl FROM b GROUP BY k), u AS (SELECT *, id % 3 i3, score // 200000 s, 0 AS copy FROM ch JOIN bs USING (k) UNION ALL SELECT * REPLACE (bl[1:nb - 1] AS bl), id % 3, score // 200000, 1 FROM ch JOIN bs USING (k) WHERE nb > 1) SELECT CAST(row_number() OVER (ORDER BY s DESC, i3, r_name, r_size, r_strand, r_start, r_end, q_name, q_size, q_strand, q_start, q_end, bl) AS BIGINT) AS rank, k, copy FROM u")
def sort_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: few ids and scores, so all fields decide, and blocks last: a list that begins another comes first."""
    rows = chains(spark, sf_dir).withColumn("copy", F.lit(0)).withColumn("k", F.col("offset")).withColumn("id", F.col("id") % 3).withColumn("score", F.expr("score div 200000"))
    cut = rows.filter(F.size("blocks") > 1).withColumn("copy", F.lit(1)).withColumn("blocks", F.slice("blocks", F.lit(1), F.size("blocks") - 1))
    return ordering.ranked(rows.unionByName(cut), ordering.keys("score")).select("rank", "k", "copy")


@_query("score_twobit", f"{SCORE} SELECT id, score FROM sc WHERE score >= -3000")
def score_twobit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains scored over 2bit files, of which only the chunks that their blocks lie in are read."""
    rows = chains(spark, sf_dir)
    bins = checkpointed(scoring.needed_bins(rows))
    known = [files_of_bases.load_bins(spark, p, side, bins.filter(F.col("side") == side)) for p, side in zip(_twobit_in(spark, sf_dir), ("reference", "query"))]
    return scoring.scored(rows, known[0].unionByName(known[1]), -3000).select("id", "score")
