"""Partition of chains into parts: by a number of parts or of chains, in order or at random."""

from __future__ import annotations

import logging
import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alignloom.operators.ordering import ranked
from alignloom.storage import checkpointed

_MASK = (1 << 64) - 1
#: The public SplitMix64 generator.
_GAMMA, _MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def draws(seed: int, number: np.ndarray) -> np.ndarray:
    """The SplitMix64 generator's 64-bit numbers of those places (from 0): it counts, so any of them is computed alone."""
    with np.errstate(over="ignore"):
        z = (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_GAMMA) + np.uint64(seed & _MASK)
        z = (z ^ z >> np.uint64(30)) * np.uint64(_MIX[0])
        z = (z ^ z >> np.uint64(27)) * np.uint64(_MIX[1])
        return z ^ z >> np.uint64(31)


def high_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 64 bits of products of 64-bit numbers."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    with np.errstate(over="ignore"):
        first, second = (a >> half) * (b & low), (a & low) * (b >> half)
        carry = (((a & low) * (b & low) >> half) + (first & low) + (second & low)) >> half
        return (a >> half) * (b >> half) + (first >> half) + (second >> half) + carry


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(place, ordinal): range(n) after a Fisher-Yates pass from the end, places drawn by multiply-high, without running its steps in turn.

    Step i swaps the places i and j <= i, so it settles place i: with what j held then.
    That is j itself unless an earlier step, the next larger one of equal j, brought
    there what its own place held before it, which in turn is its place unless a step
    brought something there, and so on. These references lead to ever larger steps and
    are followed by doubling, in few rounds, each kept in the shared folder.
    """

    @F.pandas_udf("bigint")
    def drawn(i: pd.Series) -> pd.Series:
        i = i.to_numpy()
        return pd.Series(high_product(draws(seed, n - 1 - i), i.astype(np.uint64) + np.uint64(1)).astype(np.int64))

    steps = spark.range(0, n).select(F.col("id").alias("i")).withColumn("j", F.when(F.col("i") > 0, drawn("i")).otherwise(0))
    steps = checkpointed(steps.withColumn("later", F.lead("i").over(Window.partitionBy("j").orderBy("i"))))
    to = checkpointed(steps.filter("i > j").groupBy(F.col("j").alias("s")).agg(F.min("i").alias("to")))
    while True:
        ahead = to.select(F.col("s").alias("to"), F.col("to").alias("beyond"))
        met = to.join(ahead, "to", "left").select("s", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
        met = checkpointed(met)
        to = met.select("s", "to")
        if met.filter("moved").isEmpty():
            break
    found = steps.join(to.withColumnRenamed("s", "later"), "later", "left")
    return found.select(F.col("i").alias("place"), F.coalesce("to", "later", "j").alias("ordinal"))


def _ordinals(chains: DataFrame) -> tuple[DataFrame, int]:
    rows = chains if "ordinal" in chains.columns else ranked(chains, [F.col("file_no").asc(), F.col("offset").asc()]).withColumn("ordinal", F.col("rank") - 1).drop("rank")
    n = rows.count()
    if n == 0:
        raise ValueError("no chains to split")
    return rows, n


def split(chains: DataFrame, files: int | None = None, chunks: int | None = None, randomize: bool = False, seed: int | None = None) -> DataFrame:
    """chains with `part` and `ordinal`, the place in file order (taken as it is where chains have it). files=N: part f holds the ordinals from floor(f n / N) to below floor((f + 1) n / N); chunks=N: N chains each.

    randomize deals shuffled places instead of ordinals, exactly as the established
    generator does for a seed (see permutation()). More parts than chains give one part.
    """
    if (files is None) == (chunks is None) or (files or chunks) < 1:
        raise ValueError("give a positive number of either files or chunks")
    if seed is not None and not randomize:
        raise ValueError("a seed needs randomize")
    rows, n = _ordinals(chains)
    if files is not None and files > n:
        return rows.withColumn("part", F.lit(0).cast("long"))
    if randomize:
        seed = time.time_ns() & _MASK if seed is None else seed
        logging.getLogger(__name__).warning("split: seed %d", seed)
        rows = rows.join(permutation(rows.sparkSession, n, seed), "ordinal")
    part = F.expr(f"(({'place' if randomize else 'ordinal'} + 1) * {files} - 1) div {n}") if files is not None else F.expr(f"{'place' if randomize else 'ordinal'} div {chunks}")
    return rows.withColumn("part", part).drop("place")


def base_name(path: str) -> str:
    """A file's name without .gz and then .chain."""
    return path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".chain")
