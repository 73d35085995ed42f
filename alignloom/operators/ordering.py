"""Total orders of chains, ranks, renumbering, output offsets, merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignloom.operators import render
from alignloom.storage import checkpointed

_TIES = ["id", "r_name", "r_size", "r_strand", "r_start", "r_end", "q_name", "q_size", "q_strand", "q_start", "q_end"]


def keys(by: str) -> list[Column]:
    """The sort keys of `score` (descending), `id`, `reference` (or `target`) or `query`, then all other fields, so equal keys mean equal chains."""
    first = {"score": ["-score"], "id": ["id"], "reference": ["r_name", "r_start"], "target": ["r_name", "r_start"], "query": ["q_name", "q_start"]}[by]
    order = [F.col("score").desc() if k == "-score" else F.col(k).asc() for k in dict.fromkeys(first + _TIES)]
    return [*order, *([] if by == "score" else [F.col("score").desc()]), F.col("blocks").asc()]


def sort(chains: DataFrame, by: str = "score", max_gb: float = 16) -> DataFrame:
    """chains in a total order: a range exchange and a sort that spills by itself, so max_gb is only checked."""
    checked_memory(max_gb)
    return chains.orderBy(*keys(by))


def checked_memory(max_gb: float) -> None:
    if not 0 < max_gb < float("inf"):
        raise ValueError("max_gb must be finite and positive")


def ranked(rows: DataFrame, order: list[Column], weight: Column | None = None) -> DataFrame:
    """rows with `rank` (from 1, gapless, in the order) and, if weight is given, `before`: the weights of all rows ahead.

    One range exchange lays the rows out and is checkpointed; ranks are places in a
    partition plus that partition's offset, so no task sees all rows, and two numbers
    per partition come to the driver.
    """
    laid = rows if weight is None else rows.withColumn("__weight", weight.cast("long"))
    laid = checkpointed(laid.repartitionByRange(*order).sortWithinPartitions(*order))
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    totals = {r["p"]: r for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n"), (F.sum("__weight") if weight is not None else F.lit(0)).alias("w")).collect()}
    starts, weights, n, w = [], [], 0, 0
    for p in range(max(totals, default=-1) + 1):
        starts.append(n)
        weights.append(w)
        n, w = n + (totals[p]["n"] if p in totals else 0), w + (totals[p]["w"] if p in totals else 0)
    at = lambda values: F.element_at(F.lit(values or [0]).cast("array<bigint>"), part + 1)
    out = laid.withColumn("rank", at(starts) + place + 1)
    if weight is None:
        return out
    out = out.withColumn("__part", part).withColumn("__base", at(weights))
    ahead = Window.partitionBy("__part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("before", F.col("__base") + F.coalesce(F.sum("__weight").over(ahead), F.lit(0))).drop("__part", "__base", "__weight")


def renumbered(chains: DataFrame, by: str = "score") -> DataFrame:
    """chains with ids 1, 2, ... in the order; old ids stay as `old_id`."""
    return ranked(chains, keys(by)).withColumn("old_id", F.col("id")).withColumn("id", F.col("rank")).drop("rank")


def index(chains: DataFrame, by: str = "score", rename: bool = False, head_bytes: int = 0) -> DataFrame:
    """(offset, offset_hex, key): where in the sorted output each run of one key begins; head_bytes: metadata lines written first.

    One range exchange: the bytes of records ahead are summed as rows are ranked; with
    rename, records are weighed without their ids, whose digits follow from the ranks.
    """
    return runs(ranked(chains, keys(by), weight(rename)), by, rename, head_bytes)


def weight(rename: bool) -> Column:
    """A record's bytes; with rename, without its id."""
    return render.record_bytes(render.record(F.lit("") if rename else None))


def runs(placed: DataFrame, by: str, rename: bool = False, head_bytes: int = 0) -> DataFrame:
    """index() of chains that ranked() has placed with weight(rename)."""
    last, digits = F.col("rank") - 1, F.lit(0).cast("long")
    for d in range(19):  # of the ids 1 to last, those with more than d digits have one there
        digits = digits + F.greatest(last - (10**d - 1), F.lit(0).cast("long"))
    before = F.col("before") + digits if rename else F.col("before")
    key = {"score": F.col("score").cast("string"), "id": F.col("rank" if rename else "id").cast("string"), "query": F.col("q_name")}.get(by, F.col("r_name"))
    first = placed.select(key.alias("key"), before.alias("before")).groupBy("key").agg(F.min("before").alias("offset"))  # sorted by key, so a key is one run
    return first.select((F.col("offset") + head_bytes).alias("offset"), F.lower(F.hex(F.col("offset") + head_bytes)).alias("offset_hex"), "key")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All chains of the inputs, file_no telling in which order: UNION ALL, nothing is parsed anew or sorted."""
    return reduce(DataFrame.unionByName, [p.withColumn("file_no", F.lit(i)) for i, p in enumerate(parts)])


def merged(parts: list[DataFrame], by: str | None = None, rename: bool = False) -> DataFrame:
    """The union of the inputs, sorted if a key is given; rename alone means by score."""
    union, by = concatenated(parts), by or ("score" if rename else None)
    if rename:
        return renumbered(union, by)
    return union.orderBy("file_no", "offset") if by is None else sort(union, by)


def distinct_metadata(lines: DataFrame) -> DataFrame:
    """Each metadata line once, with the place where it is first seen."""
    first = lines.groupBy("line").agg(F.min(F.struct("file_no", "offset")).alias("f"))
    return first.select("f.file_no", "f.offset", "line").orderBy("file_no", "offset")


def concatenate_text(texts: list[bytes]) -> bytes:
    """Inputs byte by byte, with newlines added so that a blank line separates two of them."""
    out = b""
    for text in texts:
        if out and text:
            out += b"" if out.endswith(b"\n\n") else b"\n" if out.endswith(b"\n") else b"\n\n"
        out += text
    return out


def generated_ids(chains: DataFrame) -> DataFrame:
    """chains without an id of their own get 1, 2, ... in file order; explicit ids do not advance the count, so both may meet."""
    explicit, missing = chains.filter("id_explicit"), chains.filter("not id_explicit")
    numbered = ranked(missing, [F.col("file_no").asc(), F.col("offset").asc()]).withColumn("id", F.col("rank").cast("decimal(20,0)")).drop("rank")
    return explicit.unionByName(numbered)
