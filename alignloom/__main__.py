"""python -m alignloom filter|sort|merge|split|bed|score|antirepeat ...: the chain operators on files."""

from __future__ import annotations

import argparse
import dataclasses
import sys
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alignloom.functions import bases, blocks, gaps
from alignloom.operators import bed, files, filters, ordering, render, scoring
from alignloom.sources import chains, sequences
from alignloom.storage import lent


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="alignloom")
    out.add_argument("--level", default="WARN")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name, aliases=list(aliases))
        c.add_argument("-c", "--chain", nargs="*", default=[])
        c.add_argument("--file", help="a list of paths, one a line")
        c.add_argument("-o", "--out", required=True)
        c.add_argument("-G", "--gzip", action="store_true")
        c.add_argument("--overwrite", action="store_true")
        return c

    c = command("filter")
    for f in dataclasses.fields(filters.FilterSpec):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            c.add_argument(flag, action="store_true")
        else:
            c.add_argument(flag, type=int if f.type.startswith("int") else str)
    c.add_argument("--output-format", choices=("dense", "long"), default="dense")
    c = command("sort")
    c.add_argument("-s", "--sort-by", choices=("score", "id", "target", "reference", "query"), default="score")
    c.add_argument("--rename", action="store_true")
    c.add_argument("--out-index")
    c.add_argument("--max-gb", type=float, default=16)
    c = command("merge")
    c.add_argument("-S", "--sort-by", choices=("score", "id", "reference", "query"))
    c.add_argument("--rename", action="store_true")
    c = command("split")
    c.add_argument("--files", type=int)
    c.add_argument("--chunks", type=int)
    c.add_argument("--randomize", action="store_true")
    c.add_argument("--seed", type=int)
    c = command("bed")
    c.add_argument("--side", choices=("reference", "query"), default="reference")
    c.add_argument("--type", type=int, choices=(3, 6, 12), default=12)
    c.add_argument("--spanned", action="store_true")
    c.add_argument("-L", "--long", action="store_true")
    c.add_argument("--sort-by", choices=("none", "coordinate"), default="none")
    for name, aliases in (("score", ()), ("antirepeat", ("anti-repeat",))):
        c = command(name, *aliases)
        c.add_argument("-r", "--reference", required=True, nargs="+")
        c.add_argument("-q", "--query", required=True, nargs="+")
        c.add_argument("-m", "--min-score", type=int, default=1000 if name == "score" else 5000)
        if name == "score":
            c.add_argument("-s", "--score-scheme")
            c.add_argument("-g", "--linear-gap", default="loose")
            c.add_argument("--sort-by-score", action="store_true")
            c.add_argument("-M", "--skip-missing-chains", action="store_true")
        else:
            c.add_argument("--no-check-score", type=int, default=200_000)
    return out


def _text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, int]:
    """Runs a command; what it counted."""
    paths = args.chain + (chains.path_list(_text(args.file)) if args.file else [])
    if not paths:
        raise ValueError("no chain files")
    files.guarded(paths, args.out, args.overwrite)
    if args.command == "split":
        made = files.split_files(spark, paths, args.out, args.gzip, files=args.files, chunks=args.chunks, randomize=args.randomize, seed=args.seed).collect()
        return {"files": len(made), "bytes": sum(r["bytes"] for r in made)}
    if args.command == "merge" and not (args.sort_by or args.rename):
        made = files.merge_files(spark, paths, args.out, args.gzip).collect()
        return {"inputs": len(paths), "bytes": sum(r["bytes"] for r in made)}
    if args.command == "filter":
        return _filter(spark, args, paths)
    if args.command in ("sort", "merge"):
        return _sort(spark, args, paths)
    if args.command == "bed":
        return _bed(spark, args, paths)
    return _rescored(spark, args, paths)


def _filter(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> dict[str, int]:
    """Partitions are in file order and nothing is shuffled, so the output is too, and each row is counted once."""
    spec = filters.FilterSpec(**{f.name: getattr(args, f.name) for f in dataclasses.fields(filters.FilterSpec)})
    seen, kept = Observation(), Observation()
    rows = chains.read(spark, paths, wanted=filters.reads_blocks(spec))
    merges = F.sum(F.when(F.lit(spec.merge_zero_gaps), blocks.zero_gap_merges(F.col("blocks"))).otherwise(0))
    rows = rows.observe(seen, F.count("*").alias("read"), F.count(F.when(F.col("score") < 0, 1)).alias("negative"), F.coalesce(merges, F.lit(0)).alias("zero_gap_merges"))
    rows = filters.filtered(rows, spec).observe(kept, F.count("*").alias("written"))
    render.write(rows.select(render.record(None, True, args.output_format == "long").alias("value")), args.out, args.gzip, args.overwrite)
    if seen.get["negative"]:
        print(f"WARN: {seen.get['negative']} chains have a negative score", file=sys.stderr)
    return {"read": seen.get["read"], "written": kept.get["written"], "dropped": seen.get["read"] - kept.get["written"], "zero_gap_merges": seen.get["zero_gap_merges"]}


def _sort(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> dict[str, int]:
    """Texts are parsed once, to Parquet, whose chains one range exchange brings in order; metadata lines come before them.

    Ranks, which new ids and the index need, are places in partitions of that order; it
    is kept then, not made again.
    """
    by, index, rename = args.sort_by or "score", getattr(args, "out_index", None), args.rename
    ordering.checked_memory(getattr(args, "max_gb", 16))
    with lent(chains.numbered_items(spark, paths), "parsed") as found:
        rows, order = chains.chains(found, False), ordering.keys(by)
        notes = chains.metadata(found)
        notes = (ordering.distinct_metadata(notes) if args.command == "merge" else notes.orderBy("file_no", "offset")).select(F.col("line").alias("value"))
        if index or rename:
            rows = ordering.ranked(rows, order, ordering.weight(rename) if index else None)
        else:
            rows = rows.orderBy(*order)
        counted = Observation()
        body = rows.select(render.record(F.col("rank") if rename else None).alias("value")).observe(counted, F.count("*").alias("chains"))
        render.write(notes.unionAll(body), args.out, args.gzip, args.overwrite)
        if index:
            head = notes.agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).first()[0]
            render.write(ordering.runs(rows, by, rename, head).orderBy("offset").select(F.concat_ws("\t", "offset_hex", "key").alias("value")), index)
    return {"inputs": len(paths), "chains": counted.get["chains"]}


def _bed(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> dict[str, int]:
    """Lines stay in the input's order, which partitions have, unless they are to be sorted."""
    seen = Observation()
    lines = bed.lines(bed.project(chains.read(spark, paths), args.side, args.type, args.spanned, args.long, args.sort_by))
    render.write(lines.observe(seen, F.count("*").alias("chains")), args.out, args.gzip, args.overwrite)
    return {"chains": seen.get["chains"]}


def _rescored(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> dict[str, int]:
    with lent(chains.numbered_items(spark, paths), "parsed") as found:
        rows, place, kept = chains.chains(found, False), ["file_no", "offset"], Observation()
        few = rows.filter(F.col("score") < args.no_check_score) if args.command != "score" else rows  # others pass unread
        bins = scoring.needed_bins(few)
        known = sequences.load_bins(spark, args.reference, "reference", bins.filter("side = 'reference'")).unionByName(sequences.load_bins(spark, args.query, "query", bins.filter("side = 'query'")))
        stats = {"read": rows.count()}
        if args.command == "score":
            matrix = sequences.score_matrix(_text(args.score_scheme)) if args.score_scheme else bases.DEFAULT_MATRIX
            table = args.linear_gap if args.linear_gap in gaps.TABLES else gaps.parsed(_text(args.linear_gap))
            if args.skip_missing_chains:
                stats["missing"] = _warned(scoring.missing_sequences(rows, known))
            rows = scoring.scored(rows, known, args.min_score, matrix, table, args.skip_missing_chains)
            place = [F.col("score").desc(), "file_no", "offset"] if args.sort_by_score else place
        else:
            rows = scoring.antirepeat(rows, known, args.min_score, args.no_check_score)
        # counted behind the sort, since its sampling reads what is before it
        count = lambda df: df.observe(kept, F.count(F.when(F.col("is_chain"), 1)).alias("written")).select("value")
        rows = rows.select("file_no", "offset", "score", render.record().alias("value"), F.lit(True).alias("is_chain"))
        notes = chains.metadata(found).withColumnRenamed("line", "value").withColumn("is_chain", F.lit(False))
        if len(place) == 3:  # by score: metadata first
            out = notes.orderBy("file_no", "offset").select("value").unionAll(count(rows.orderBy(*place)))
        else:  # metadata stays between the chains
            out = count(rows.drop("score").unionByName(notes).orderBy(*place))
        render.write(out, args.out, args.gzip, args.overwrite)
    return stats | {"written": kept.get["written"], "dropped": stats["read"] - kept.get["written"] - stats.get("missing", 0)}


def _warned(lacking: DataFrame) -> int:
    """A warning for each chain that has no sequence of its name: the header and the names; how many."""
    n = 0
    for r in lacking.orderBy("file_no", "offset").select(render.header().alias("header"), "missing").toLocalIterator():
        print(f"WARN: no sequence for {', '.join(r['missing'])}, skipped: {r['header']}", file=sys.stderr)
        n += 1
    return n


def main(argv: list[str] | None = None) -> int:
    args, began = parser().parse_args(argv), time.time()
    spark = SparkSession.builder.appName("alignloom").getOrCreate()
    spark.sparkContext.setLogLevel(args.level)
    try:
        stats = run(spark, args)
    except Exception as error:  # the exit code and one line tell a shell what a traceback would
        print(f"ERROR: {str(error).splitlines()[0] if str(error) else error!r}", file=sys.stderr)
        return 1
    print(" ".join([f"{args.command} complete:", *(f"{k}={v}" for k, v in stats.items()), f"seconds={time.time() - began:.1f}"]), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
