"""Connected components of very large graphs by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm.common import checkpointed


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))


def _stars(rows: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour to the smallest node of its neighbourhood, the node included.

    large: only larger neighbours move, and all neighbours are seen; else only smaller
    ones and the node itself move. The smallest node of each neighbourhood comes from
    a partial aggregate; a node with very many neighbours is a skewed join key that
    AQE splits.
    """
    least = rows.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
    met = rows.join(least, "node")
    if large:
        out = met.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("other").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node of its component.

    Large-star and small-star steps alternate until the edges are stars around the
    smallest nodes; rounds grow with the logarithm of the nodes. Each round is
    checkpointed to the shared folder; only a row count and a checksum of the edges
    come to the driver. Repeated edges, loops and either direction are allowed; loops
    alone give no row.
    """
    now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seen = mark
        large = _stars(_neighbours(now), True)
        now = checkpointed(_stars(large.select(F.col("a").alias("node"), F.col("b").alias("other")), False).distinct())
