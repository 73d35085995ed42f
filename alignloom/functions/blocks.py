"""Columns over a chain's blocks: dense (size and the gaps after it) and absolute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignloom.schema import ABSOLUTE, BLOCKS


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(blocks: Column, *fields: str, last: bool = True) -> Column:
    """The sum of the fields; last=False leaves out the last block's gaps."""
    parts = blocks if last else F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.transform(F.slice(blocks, F.size(blocks), 1), lambda b: F.struct(b["size"].alias("size"), F.lit(0).cast("long").alias("gap_reference"), F.lit(0).cast("long").alias("gap_query"))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, b: s + sum((b[f] for f in fields[1:]), b[fields[0]]))


def largest(blocks: Column) -> Column:
    """The size of the largest block without a gap."""
    return F.array_max(F.transform(blocks, lambda b: b["size"]))


def largest_gap(blocks: Column, side: str) -> Column:
    """The largest gap between two blocks on a side (reference or query); 0 for one block."""
    inner = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.coalesce(F.array_max(F.transform(inner, lambda b: b[f"gap_{side}"])), F.lit(0).cast("long"))


def running(values: Column, plus=lambda a, b: a + b, zero: int = 0, block: int = 128) -> Column:
    """What `plus` makes of all values ahead of each one (their sum); bigint. plus is associative and zero changes nothing.

    Arrays grow within a block only, blocks are joined by flatten, so a million values
    take seconds.
    """
    nothing = F.struct(F.lit(zero).cast("long").alias("all"), F.array().cast("array<bigint>").alias("ahead"))

    def scanned(part: Column, of) -> Column:
        return F.aggregate(part, nothing, lambda s, x: F.struct(plus(s["all"], of(x).cast("long")).alias("all"), F.concat(s["ahead"], F.array(s["all"])).alias("ahead")))

    def parts(held: Column) -> Column:
        count = F.ceil(F.size(held) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: scanned(F.slice(held, i * block + 1, F.lit(block)), lambda x: x))

    def joined(p: Column) -> Column:
        return F.flatten(F.zip_with(p, scanned(p, lambda x: x["all"])["ahead"], lambda x, s: F.transform(x["ahead"], lambda y: plus(s, y))))

    return let(let(values, parts), joined)


def absolute(blocks: Column, r_start: Column, q_start: Column) -> Column:
    """Blocks with their coordinates, by running sums; time is linear in the blocks."""
    steps = lambda gap: running(F.transform(blocks, lambda b: b["size"] + b[gap]))

    def placed(ahead):
        def at(b, i):
            r, q = r_start.cast("long") + F.get(ahead["r"], i), q_start.cast("long") + F.get(ahead["q"], i)
            return F.struct(r.alias("r_start"), (r + b["size"]).alias("r_end"), q.alias("q_start"), (q + b["size"]).alias("q_end"))

        return F.transform(blocks, at).cast(ABSOLUTE)

    return let(F.struct(steps("gap_reference").alias("r"), steps("gap_query").alias("q")), placed)


def exploded(chains: DataFrame, *keys: str) -> DataFrame:
    """A row for each block with its coordinates, by a running sum; keys name a chain."""
    rows = chains.select(*keys, "r_start", "q_start", F.posexplode("blocks").alias("block_no", "b"))
    before = Window.partitionBy(*keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda gap: F.coalesce(F.sum(F.col("b.size") + F.col(f"b.{gap}")).over(before), F.lit(0))
    placed = rows.select(*keys, "block_no", "b", (F.col("r_start") + past("gap_reference")).alias("r_start"), (F.col("q_start") + past("gap_query")).alias("q_start"))
    return placed.select(*keys, "block_no", F.col("b.size").alias("size"), "r_start", (F.col("r_start") + F.col("b.size")).alias("r_end"), "q_start", (F.col("q_start") + F.col("b.size")).alias("q_end"))


def dense(blocks: Column) -> Column:
    """Absolute blocks as dense ones: gaps to the next block, none after the last."""
    def of(held):
        def at(b, i):
            after = lambda end, start: F.coalesce(F.try_element_at(held, i + 2)[start] - b[end], F.lit(0).cast("long"))
            return F.struct((b["r_end"] - b["r_start"]).alias("size"), after("r_end", "r_start").alias("gap_reference"), after("q_end", "q_start").alias("gap_query"))

        return F.transform(held, at).cast(BLOCKS)

    return let(blocks, of)


def reference_length(b: Column) -> Column:
    return F.greatest(b["r_end"] - b["r_start"], F.lit(0).cast("long"))


def query_length(b: Column) -> Column:
    return F.greatest(b["q_end"] - b["q_start"], F.lit(0).cast("long"))


def aligned_length(b: Column) -> Column:
    """The common length of both sides; null if they differ."""
    return F.when(reference_length(b) == query_length(b), reference_length(b))


def is_gapless(b: Column) -> Column:
    return (reference_length(b) > 0) & (reference_length(b) == query_length(b))


def _touches(blocks: Column, i: Column) -> Column:
    """Whether block i (from 1) has no gap to the next; false at either end."""
    b = F.try_element_at(blocks, F.greatest(i, F.lit(1)))
    return (i >= 1) & (i < F.size(blocks)) & (b["gap_reference"] == 0) & (b["gap_query"] == 0)


def zero_gap_merges(blocks: Column) -> Column:
    """How many neighbouring blocks have no gap between them."""
    return F.size(F.filter(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: (b["gap_reference"] == 0) & (b["gap_query"] == 0))).cast("long")


def merged_pairs(blocks: Column, r_start: Column, q_start: Column) -> Column:
    """Absolute blocks after merging neighbours without a gap, pairwise: a block that touches its
    predecessor goes, and one that touches its successor takes over that one's end only. Of a run
    of three or more, blocks from the third on are therefore lost, as the established tools do it."""
    def of(placed):
        def keep(b, i):
            end = F.when(_touches(blocks, i + 1), F.try_element_at(placed, i + 2)).otherwise(b)
            return F.when(~_touches(blocks, i), F.struct(b["r_start"].alias("r_start"), end["r_end"].alias("r_end"), b["q_start"].alias("q_start"), end["q_end"].alias("q_end")))

        return F.array_compact(F.transform(placed, keep))

    return let(absolute(blocks, r_start, q_start), of)


def absolute_faults(blocks: Column) -> Column:
    """What is wrong with a list of absolute blocks; null if nothing."""
    step = lambda i: F.try_element_at(blocks, i + 2)
    overlaps = lambda end, start: F.exists(F.transform(blocks, lambda b, i: F.coalesce(step(i)[start] < b[end], F.lit(False))), lambda x: x)
    return (
        F.when(F.size(blocks) == 0, "no absolute blocks")
        .when(F.exists(blocks, lambda b: b["r_end"] <= b["r_start"]), "reference interval of a block is empty or inverted")
        .when(F.exists(blocks, lambda b: b["q_end"] <= b["q_start"]), "query interval of a block is empty or inverted")
        .when(F.exists(blocks, lambda b: b["r_end"] - b["r_start"] != b["q_end"] - b["q_start"]), "block lengths of both sides differ")
        .when(overlaps("r_end", "r_start"), "blocks overlap on the reference")
        .when(overlaps("q_end", "q_start"), "blocks overlap on the query")
    )


def from_absolute(rows: DataFrame, column: str) -> DataFrame:
    """rows with `blocks`, r_start, r_end, q_start and q_end made from a column of absolute blocks, which goes; a faulty list is an error."""
    a, why = F.col(column), absolute_faults(F.col(column))
    good = F.when(why.isNotNull(), F.raise_error(why).cast(ABSOLUTE)).otherwise(a)
    ends = [F.element_at(column, i)[f].alias(f) for f, i in (("r_start", 1), ("r_end", -1), ("q_start", 1), ("q_end", -1))]
    return rows.withColumn(column, good).select("*", dense(a).alias("blocks"), *ends).drop(column)
