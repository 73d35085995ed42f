"""Chain filters: header predicates, block predicates, validation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.functions import blocks as B


def names(text: str) -> list[str]:
    """A comma-separated list: nothing is trimmed, inner empty names stay, a trailing one does not; '' is no name."""
    out = text.split(",")
    return out[:-1] if out[-1] == "" else out


@dataclass(frozen=True)
class FilterSpec:
    """Which chains stay; an option that is None does not count. All that are given must hold."""

    query_names: str | None = None
    exclude_query_names: str | None = None
    target_names: str | None = None
    exclude_target_names: str | None = None
    min_score: int | None = None
    max_score: int | None = None
    min_query_start: int | None = None
    max_query_start: int | None = None
    min_query_end: int | None = None
    max_query_end: int | None = None
    min_target_start: int | None = None
    max_target_start: int | None = None
    min_target_end: int | None = None
    max_target_end: int | None = None
    query_overlap_start: int | None = None
    query_overlap_end: int | None = None
    target_overlap_start: int | None = None
    target_overlap_end: int | None = None
    min_query_span: int | None = None
    max_query_span: int | None = None
    min_target_span: int | None = None
    max_target_span: int | None = None
    query_strand: str | None = None
    chain_id: int | None = None
    exclude_random: bool = False
    exclude_haplotype: bool = False
    min_gapless_block: int | None = None
    min_query_gap: int | None = None
    min_target_gap: int | None = None
    max_query_gap: int | None = None
    max_target_gap: int | None = None
    merge_zero_gaps: bool = False

    def __post_init__(self):
        if self.chain_id is not None and self.chain_id < 1:
            raise ValueError("chain_id is 1 or more")


def header_predicates(s: FilterSpec) -> list[Column]:
    c, out = F.col, []
    add = lambda option, make: out.append(make(option)) if option is not None else None
    for option, column, wanted in ((s.query_names, "q_name", True), (s.exclude_query_names, "q_name", False), (s.target_names, "r_name", True), (s.exclude_target_names, "r_name", False)):
        if option is not None:
            listed = c(column).isin(names(option)) if names(option) else F.lit(False)
            out.append(listed if wanted else ~listed)
    add(s.min_score, lambda n: (c("score") >= 0) & (c("score") >= n))
    add(s.max_score, lambda n: (c("score") < 0) | (c("score") < n))
    for side, col in (("query", "q"), ("target", "r")):
        for edge in ("start", "end"):
            add(getattr(s, f"min_{side}_{edge}"), lambda n, col=f"{col}_{edge}": c(col) >= n)
            add(getattr(s, f"max_{side}_{edge}"), lambda n, col=f"{col}_{edge}": c(col) < n)
        add(getattr(s, f"{side}_overlap_start"), lambda n, col=f"{col}_end": c(col) >= n)
        add(getattr(s, f"{side}_overlap_end"), lambda n, col=f"{col}_start": c(col) < n)
        span = c(f"{col}_end") - c(f"{col}_start")
        add(getattr(s, f"min_{side}_span"), lambda n, span=span: span >= n)
        add(getattr(s, f"max_{side}_span"), lambda n, span=span: span <= n)
    add(s.query_strand, lambda x: c("q_strand") == x[0] if x else F.lit(False))
    add(s.chain_id, lambda n: c("id") == n)
    if s.exclude_random:
        out.append(~c("r_name").endswith("_random") & ~c("q_name").endswith("_random"))
    if s.exclude_haplotype:
        out.append(~(c("r_name").contains("_hap") | c("r_name").contains("_alt") | c("q_name").contains("_hap") | c("q_name").contains("_alt")))
    return out


def reads_blocks(s: FilterSpec):
    """A function of headers' columns that says whose blocks the filter can look at: what header predicates reject
    needs none, unless gaps are merged. An id that is still to be generated decides nothing."""
    listed = [(c, names(v), want) for v, c, want in ((s.query_names, "q_name", True), (s.exclude_query_names, "q_name", False), (s.target_names, "r_name", True), (s.exclude_target_names, "r_name", False)) if v is not None]
    bounds = []  # (value of headers, least, below)
    for side, p in (("query", "q"), ("target", "r")):
        bounds += [(f"{p}_{edge}", getattr(s, f"min_{side}_{edge}"), getattr(s, f"max_{side}_{edge}")) for edge in ("start", "end")]
        bounds += [(f"{p}_end", getattr(s, f"{side}_overlap_start"), None), (f"{p}_start", None, getattr(s, f"{side}_overlap_end"))]
    spans = [(p, getattr(s, f"min_{side}_span"), getattr(s, f"max_{side}_span")) for side, p in (("query", "q"), ("target", "r"))]

    def reads(h: dict) -> np.ndarray:
        score = h["score"]
        out = np.ones(len(score), bool)
        if s.merge_zero_gaps:
            return out
        flags = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), bool)
        if s.min_score is not None:
            out &= (score >= 0) & (score >= s.min_score)
        if s.max_score is not None:
            out &= (score < 0) | (score < s.max_score)
        for c, known, want in listed:
            out &= flags(pc.is_in(h[c], pa.array(known, pa.string()))) == want
        for c, low, high in bounds:
            out &= True if low is None else h[c] >= low
            out &= True if high is None else h[c] < high
        for p, low, high in spans:
            span = h[f"{p}_end"] - h[f"{p}_start"]
            out &= True if low is None else span >= low
            out &= True if high is None else span <= high
        for c in ("r_name", "q_name"):
            if s.exclude_random:
                out &= ~flags(pc.ends_with(h[c], "_random"))
            if s.exclude_haplotype:
                out &= ~flags(pc.match_substring_regex(h[c], "_hap|_alt"))
        if s.query_strand is not None:
            out &= flags(pc.equal(h["q_strand"], s.query_strand[:1]))
        return out

    return reads


def block_predicates(s: FilterSpec, blocks: Column) -> list[Column]:
    gap = lambda side: B.largest_gap(blocks, side)
    found = (
        (s.min_gapless_block, lambda n: B.largest(blocks) >= n), (s.min_query_gap, lambda n: gap("query") >= n), (s.min_target_gap, lambda n: gap("reference") >= n),
        (s.max_query_gap, lambda n: gap("query") <= n), (s.max_target_gap, lambda n: gap("reference") <= n),
    )
    return [make(n) for n, make in found if n is not None]


def header_fault() -> Column:
    """What is wrong with a chain's header; null if nothing."""
    c = F.col
    return (
        F.when((c("r_end") <= c("r_start")) | (c("q_end") <= c("q_start")), "chain end must be greater than start")
        .when((c("r_end") > c("r_size")) | (c("q_end") > c("q_size")), "chain extends past sequence size")
        .when(c("id") == 0, "chain id must be positive")
    )


def block_fault() -> Column:
    """Whether the blocks end where the header does; the last block's gaps do not count."""
    c = F.col
    sides = [c(f"{p}_start") + B.total(c("blocks"), "size", gap, last=False) != c(f"{p}_end") for p, gap in (("r", "gap_reference"), ("q", "gap_query"))]
    return F.when(F.size("blocks") == 0, "chain without any alignment blocks").when(sides[0] | sides[1], "chain block coordinates do not match header end")


def validated(chains: DataFrame) -> DataFrame:
    """chains with `fault`, the first that the checks find, or null."""
    return chains.withColumn("fault", F.coalesce(header_fault(), block_fault()))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for x in conditions:
        out = out & x
    return out


def filtered(chains: DataFrame, spec: FilterSpec, strict: bool = True) -> DataFrame:
    """The chains that the spec keeps; merge_zero_gaps also merges their blocks before block predicates see them.

    strict: a faulty header fails the job wherever it is, faulty blocks only in chains
    that header predicates keep (or in any, when gaps are merged); checks and
    predicates are one expression, so no optimizer can move one before the other.
    """
    header = _all(header_predicates(spec))
    if strict:
        fail = lambda fault, then: F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(then)
        header = fail(header_fault(), fail(block_fault(), header) if spec.merge_zero_gaps else F.when(header, fail(block_fault(), F.lit(True))).otherwise(False))
    kept = chains.filter(header)
    if spec.merge_zero_gaps:
        kept = kept.withColumn("blocks", B.dense(B.merged_pairs(F.col("blocks"), F.col("r_start"), F.col("q_start"))))
    conditions = block_predicates(spec, F.col("blocks"))
    return kept.filter(_all(conditions)) if conditions else kept
