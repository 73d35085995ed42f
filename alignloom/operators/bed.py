"""BED projection of one side of chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.functions import blocks as B

COLUMNS = ["chrom", "chrom_start", "chrom_end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts"]


def fault(side: str = "reference", spanned: bool = False) -> Column:
    """What keeps a chain from being projected; null if nothing. Here the last block's gap counts toward its end."""
    p = "r" if side == "reference" else "q"
    c = F.col
    out = F.when(c(f"{p}_end") <= c(f"{p}_start"), "chain side span is empty or inverted")
    if spanned:
        return out
    gap = "gap_reference" if p == "r" else "gap_query"
    return out.when(c(f"{p}_start") + B.total(c("blocks"), "size", gap) != c(f"{p}_end"), "chain block coordinates do not match header end").when(~F.exists("blocks", lambda b: b["size"] > 0), "chain has no positive-length alignment blocks")


def project(chains: DataFrame, side: str = "reference", kind: int = 12, spanned: bool = False, long_names: bool = False, sort_by: str = "none", strict: bool = True) -> DataFrame:
    """BED3, BED6 or BED12 rows of the reference or query side; a minus strand's coordinates stay as they are.

    spanned: one block over the span. long_names: the other side's name, the id and the
    other side's span. sort_by: `coordinate` (chrom, start, end, name) or `none`.
    """
    if kind not in (3, 6, 12) or side not in ("reference", "query") or sort_by not in ("none", "coordinate"):
        raise ValueError("kind is 3, 6 or 12; side reference or query; sort_by none or coordinate")
    p, o = ("r", "q") if side == "reference" else ("q", "r")
    c, start, end = F.col, F.col(f"{p}_start"), F.col(f"{p}_end")
    name = F.concat(F.lit("chain_"), c("id").cast("string"))
    if long_names:
        name = F.concat_ws("_", c(f"{o}_name"), c("id").cast("string"), (c(f"{o}_end") - c(f"{o}_start")).cast("string"))
    if spanned:
        starts, sizes = F.array(F.lit(0).cast("long")), F.array(end - start)
    else:
        placed = F.filter(B.absolute(c("blocks"), c("r_start"), c("q_start")), lambda b: b[f"{p}_end"] > b[f"{p}_start"])
        starts, sizes = F.transform(placed, lambda b: b[f"{p}_start"] - start), F.transform(placed, lambda b: b[f"{p}_end"] - b[f"{p}_start"])
    comma = lambda xs: F.concat(F.array_join(F.transform(xs, lambda x: x.cast("string")), ","), F.lit(","))
    checked = chains
    if strict:
        why = fault(side, spanned)
        checked = chains.filter(F.when(why.isNotNull(), F.raise_error(why).cast("boolean")).otherwise(True))
    out = checked.select(
        "file_no", "offset", c(f"{p}_name").alias("chrom"), start.alias("chrom_start"), end.alias("chrom_end"), name.alias("name"), F.lit(0).alias("score"), c(f"{p}_strand").alias("strand"),
        start.alias("thick_start"), end.alias("thick_end"), F.lit("0,0,0").alias("item_rgb"), F.size(sizes).alias("block_count"), comma(sizes).alias("block_sizes"), comma(starts).alias("block_starts"),
    )
    if sort_by == "coordinate":
        out = out.orderBy("chrom", "chrom_start", "chrom_end", "name")
    return out.select(*COLUMNS[:kind])


def lines(bed: DataFrame) -> DataFrame:
    return bed.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in bed.columns]).alias("value"))
