"""Synthetic chains and sequences from the driver's tables, the same in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.sources.sequences import chunked
from alignloom.storage import fresh

ALPHABET, LENGTH = "ACGTACGTacgtNn", 10_000

#: b: blocks by order; ch: chain headers. Blocks are numbered by all columns, as line numbers repeat.
CTE = """b0 AS (SELECT l_orderkey k,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS BIGINT) n,
 CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) m,
 CAST(l_quantity AS BIGINT) size, CAST(round(l_tax*100) AS BIGINT) dt, CAST(round(l_discount*100) AS BIGINT) dq FROM {lineitem}),
b AS (SELECT k, n, m, size, CASE WHEN n=m THEN 0 ELSE dt END gr, CASE WHEN n=m THEN 0 ELSE dq END gq FROM b0),
sp AS (SELECT k, CAST(sum(size+gr) AS BIGINT) rs, CAST(sum(size+gq) AS BIGINT) qs, CAST(count(*) AS BIGINT) nb FROM b GROUP BY k),
ch AS (SELECT o_orderkey+1 id, o_orderkey k, CAST(floor(o_totalprice) AS BIGINT)-5000 score,
 concat('chr', CAST(o_custkey%23+1 AS VARCHAR(9)), CASE WHEN o_custkey%29=0 THEN '_random' WHEN o_custkey%31=0 THEN '_alt' ELSE '' END) r_name,
 CAST(10000 AS BIGINT) r_size, '+' r_strand, (o_orderkey*37)%5000 r_start, (o_orderkey*37)%5000+rs r_end,
 concat('qry', CAST(c_nationkey+1 AS VARCHAR(9))) q_name, CAST(10000 AS BIGINT) q_size, CASE WHEN o_orderstatus='F' THEN '-' ELSE '+' END q_strand,
 (o_orderkey*53)%5000 q_start, (o_orderkey*53)%5000+qs q_end, nb
 FROM {orders} JOIN {customer} ON o_custkey=c_custkey JOIN sp ON sp.k=o_orderkey)"""


_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written to the shared folder once in a session: the fixture stands for input files."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _WRITTEN:
        path = fresh(spark, what)
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "chains", lambda: _chains(spark, sf_dir))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ch with the blocks of b: lines are shuffled once, grouped by order, and meet the order in the same partition; sums are taken over the blocks."""
    lines, orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    line = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    grouped = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(*line))).alias("ls"))
    gap = lambda x, i: F.when(i + 1 < F.size("ls"), F.round(x * 100).cast("bigint")).otherwise(0)
    block = lambda x, i: F.struct(x["l_quantity"].cast("bigint").alias("size"), gap(x["l_tax"], i).alias("gap_reference"), gap(x["l_discount"], i).alias("gap_query"))
    blocks = grouped.select("k", F.transform("ls", block).alias("blocks"))
    heads = spark.sql("""SELECT o_orderkey k, CAST(floor(o_totalprice) AS BIGINT)-5000 score,
     concat('chr', CAST(o_custkey%23+1 AS VARCHAR(9)), CASE WHEN o_custkey%29=0 THEN '_random' WHEN o_custkey%31=0 THEN '_alt' ELSE '' END) r_name,
     concat('qry', CAST(c_nationkey+1 AS VARCHAR(9))) q_name, CASE WHEN o_orderstatus='F' THEN '-' ELSE '+' END q_strand FROM {orders} JOIN {customer} ON o_custkey=c_custkey""", orders=orders, customer=customer)
    span = lambda gap: f"aggregate(blocks, CAST(NULL AS BIGINT), (a, b) -> coalesce(a + b.size + b.{gap}, a, b.size + b.{gap}))"
    placed = heads.join(blocks, "k").selectExpr("*", "(k*37)%5000 r_start", "(k*53)%5000 q_start", f"{span('gap_reference')} rs", f"{span('gap_query')} qs")
    return placed.selectExpr("0 file_no", "k AS `offset`", "score", "r_name", "10000L r_size", "'+' r_strand", "r_start", "r_start + rs r_end", "q_name", "10000L q_size", "q_strand", "q_start", "q_start + qs q_end", "k + 1 id", "true id_explicit", "blocks")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(side, name, bin, seq) for every name of the chains; bases by a formula of the name's number and the place."""
    return _once(spark, sf_dir, "sequences", lambda: _sequences(spark, sf_dir))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chains(spark, sf_dir)
    names = c.select(F.lit("reference").alias("side"), F.col("r_name").alias("name")).union(c.select(F.lit("query"), "q_name")).distinct()
    number = F.regexp_extract("name", "[0-9]+", 0).cast("bigint") + F.when(F.col("name").endswith("_random"), 100).when(F.col("name").endswith("_alt"), 200).otherwise(0) + F.when(F.col("side") == "query", 300).otherwise(0)
    base = f"array_join(transform(sequence(0, {LENGTH - 1}), i -> substr('{ALPHABET}', CAST(((p * 1103515245 + i * 12345) div 65536) % 14 AS INT) + 1, 1)), '')"
    return chunked(names.withColumn("p", number).select("side", "name", F.expr(base).alias("seq")))
