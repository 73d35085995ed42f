"""The registered queries of the chain operators, each with DuckDB SQL written on its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.functions import bases, blocks, gaps
from alignloom.operators import bed, filters, ordering, render, scoring, split
from alignloom.operators.filters import FilterSpec
from alignloom.plans.universe import ALPHABET, CTE, chains, sequences

HEAD = ["id", "score", "r_name", "r_start", "r_end", "q_name", "q_strand", "q_start", "q_end"]
_TABLES = {t: t for t in ("lineitem", "orders", "customer")}
WITH = f"WITH {CTE.format(**_TABLES)}"
AGG = """, ag AS (SELECT k, max(size) big, coalesce(max(CASE WHEN n<m THEN gq END), 0) qg, coalesce(max(CASE WHEN n<m THEN gr END), 0) tg FROM b GROUP BY k)"""
AB = """, ab AS (SELECT b.k, id, n, m, size, gr, gq, r_start + CAST(coalesce(sum(size+gr) OVER w, 0) AS BIGINT) rs, q_start + CAST(coalesce(sum(size+gq) OVER w, 0) AS BIGINT) qs
 FROM b JOIN ch USING (k) WINDOW w AS (PARTITION BY b.k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
BASE = """, al AS (SELECT id, score, q_strand, CAST(regexp_extract(r_name, '[0-9]+') AS BIGINT) + CASE WHEN r_name LIKE '%#_random' ESCAPE '#' THEN 100 WHEN r_name LIKE '%#_alt' ESCAPE '#' THEN 200 ELSE 0 END tp,
 300 + CAST(regexp_extract(q_name, '[0-9]+') AS BIGINT) qp, unnest(range(0, size)) o, rs, qs FROM ab JOIN ch USING (k, id)),
ba AS (SELECT id, score, substr('{a}', CAST(((tp*1103515245 + (rs+o)*12345)//65536) % 14 AS INT)+1, 1) t,
 CASE WHEN q_strand='-' THEN translate(substr('{a}', CAST(((qp*1103515245 + (9999-(qs+o))*12345)//65536) % 14 AS INT)+1, 1), 'ACGTacgt', 'TGCAtgca')
 ELSE substr('{a}', CAST(((qp*1103515245 + (qs+o)*12345)//65536) % 14 AS INT)+1, 1) END q FROM al),
ct AS (SELECT id, min(score) score, CAST(sum(CASE WHEN upper(t)=upper(q) AND upper(t)='A' THEN 1 ELSE 0 END) AS BIGINT) a, CAST(sum(CASE WHEN upper(t)=upper(q) AND upper(t)='C' THEN 1 ELSE 0 END) AS BIGINT) c,
 CAST(sum(CASE WHEN upper(t)=upper(q) AND upper(t)='G' THEN 1 ELSE 0 END) AS BIGINT) g, CAST(sum(CASE WHEN upper(t)=upper(q) AND upper(t)='T' THEN 1 ELSE 0 END) AS BIGINT) t,
 CAST(sum(CASE WHEN upper(t)='N' AND upper(q)='N' THEN 1 ELSE 0 END) AS BIGINT) n, CAST(sum(CASE WHEN t IN ('a','c','g','t','n') OR q IN ('a','c','g','t','n') THEN 1 ELSE 0 END) AS BIGINT) repeats, CAST(count(*) AS BIGINT) total,
 CAST(sum(CASE upper(q) || upper(t) WHEN 'AA' THEN 91 WHEN 'TT' THEN 91 WHEN 'CC' THEN 100 WHEN 'GG' THEN 100 WHEN 'AC' THEN -114 WHEN 'CA' THEN -114 WHEN 'GT' THEN -114 WHEN 'TG' THEN -114
  WHEN 'AG' THEN -31 WHEN 'GA' THEN -31 WHEN 'CT' THEN -31 WHEN 'TC' THEN -31 WHEN 'AT' THEN -123 WHEN 'TA' THEN -123 WHEN 'CG' THEN -125 WHEN 'GC' THEN -125 ELSE 0 END) AS BIGINT) mt FROM ba GROUP BY id)""".replace("{a}", ALPHABET)
_DUCK_TRUNC = lambda e: f"CAST(trunc({e}) AS BIGINT)"
#: Positions and costs of the established gap tables, written out here so that the SQL does not follow the library's.
_TABLES = {
    "loose": {
        "at": (1, 2, 3, 11, 111, 2111, 12111, 32111, 72111, 152111, 252111),
        "query": (325, 360, 400, 450, 600, 1100, 3600, 7600, 15600, 31600, 56600), "target": (325, 360, 400, 450, 600, 1100, 3600, 7600, 15600, 31600, 56600),
        "both": (625, 660, 700, 750, 900, 1400, 4000, 8000, 16000, 32000, 57000),
    },
    "medium": {
        "at": (1, 2, 3, 11, 111, 2111, 12111, 32111, 72111, 152111, 252111),
        "query": (350, 425, 450, 600, 900, 2900, 22900, 57900, 117900, 217900, 317900), "target": (350, 425, 450, 600, 900, 2900, 22900, 57900, 117900, 217900, 317900),
        "both": (750, 825, 850, 1000, 1300, 3300, 23300, 58300, 118300, 218300, 318300),
    },
    "cheap": {"at": (1, 100, 1000), "query": (0, 30, 300), "target": (0, 30, 300), "both": (0, 30, 300)},
    "rnaDna": {
        "at": (1, 2, 3, 11, 31, 111, 2111, 12111, 32111, 72111, 152111, 252111),
        "query": (325, 360, 400, 450, 600, 800, 1100, 3600, 7600, 15600, 31600, 56600), "target": (200, 210, 220, 250, 300, 400, 500, 600, 800, 1200, 2000, 4000),
        "both": (625, 660, 700, 750, 900, 1100, 1400, 4000, 8000, 16000, 32000, 57000),
    },
}


def _knots(table: str) -> str:
    """Rows of the oracle's range join: side, a knot and its cost (0 and 0 first), the next knot and its cost."""
    t, rows = _TABLES[table], []
    for side in ("query", "target", "both"):
        known = [(0, 0), *zip(t["at"], t[side])]
        for (p, v), (after, cost) in zip(known, [*known[1:], ("NULL", "NULL")]):
            rows.append(f"('{side}', {p}, {v}, {after}, {cost})")
    return ", ".join(rows)


def _cost_cte(table: str, source: str) -> str:
    """gc: id-wise gap costs of rows (id, dq, dt) by a join with the knots; past the last, the last two knots' line; below the first, only 0 occurs."""
    t = _TABLES[table]
    p = t["at"]
    last = " ".join(f"WHEN '{s}' THEN {v[-1]} + ({v[-1] - v[-2]}) / CAST({p[-1] - p[-2]} AS DOUBLE) * (x - {p[-1]})" for s, v in ((s, t[s]) for s in ("query", "target", "both")))
    return f""", gx AS (SELECT *, CASE WHEN dt = 0 THEN 'query' WHEN dq = 0 THEN 'target' ELSE 'both' END side, dq + dt x FROM {source}),
kn(side, p0, v0, p1, v1) AS (VALUES {_knots(table)}),
gc AS (SELECT gx.*, CAST(CASE WHEN x = 0 THEN 0 WHEN p1 IS NULL THEN trunc(CASE gx.side {last} END) ELSE trunc(v0 + CAST(v1 - v0 AS DOUBLE) * CAST(x - p0 AS DOUBLE) / CAST(p1 - p0 AS DOUBLE)) END AS BIGINT) cost
 FROM gx JOIN kn ON kn.side = gx.side AND x >= p0 AND (p1 IS NULL OR x < p1))"""


QUERIES, ORACLES = {}, {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _filter(name: str, spec: FilterSpec, where: str) -> None:
    _query(name, f"{WITH}{AGG} SELECT {', '.join(HEAD)} FROM ch JOIN ag USING (k) WHERE {where}")(lambda spark, d: filters.filtered(chains(spark, d), spec).select(*HEAD))


_filter("filter_names_in", FilterSpec(query_names="qry1,qry2,qry7", target_names="chr1,chr2,chr3_random,chr9"), "q_name IN ('qry1','qry2','qry7') AND r_name IN ('chr1','chr2','chr3_random','chr9')")
_filter("filter_names_not_in", FilterSpec(exclude_query_names="qry1,qry2", exclude_target_names="chr1,chr2"), "q_name NOT IN ('qry1','qry2') AND r_name NOT IN ('chr1','chr2')")
_filter("filter_score_range", FilterSpec(min_score=0, max_score=150000), "score >= 0 AND score < 150000")
_filter("filter_max_score", FilterSpec(max_score=14000), "score < 14000")
_filter("filter_start_end_ranges", FilterSpec(min_query_start=500, max_query_start=4500, min_query_end=600, max_query_end=4600, min_target_start=300, max_target_start=4700, min_target_end=400, max_target_end=4800), "q_start >= 500 AND q_start < 4500 AND q_end >= 600 AND q_end < 4600 AND r_start >= 300 AND r_start < 4700 AND r_end >= 400 AND r_end < 4800")
_filter("filter_overlap", FilterSpec(query_overlap_start=1000, query_overlap_end=3000, target_overlap_start=500, target_overlap_end=4000), "q_end >= 1000 AND q_start < 3000 AND r_end >= 500 AND r_start < 4000")
_filter("filter_span", FilterSpec(min_query_span=50, max_query_span=200, min_target_span=60, max_target_span=180), "q_end-q_start BETWEEN 50 AND 200 AND r_end-r_start BETWEEN 60 AND 180")
_filter("filter_strand", FilterSpec(query_strand="-"), "q_strand = '-'")
_filter("filter_chain_id", FilterSpec(chain_id=8), "id = 8")
_filter("filter_random_haplotype", FilterSpec(exclude_random=True, exclude_haplotype=True), "r_name NOT LIKE '%#_random' ESCAPE '#' AND r_name NOT LIKE '%#_alt%' ESCAPE '#'")
_filter("filter_gapless", FilterSpec(min_gapless_block=45), "big >= 45")
_filter("filter_gap_min", FilterSpec(min_query_gap=8, min_target_gap=5), "qg >= 8 AND tg >= 5")
_filter("filter_gap_max", FilterSpec(max_query_gap=7, max_target_gap=6), "qg <= 7 AND tg <= 6")

_query("blocks_absolute", f"{WITH}{AB} SELECT id, CAST(n-1 AS BIGINT) block_no, size, rs r_start, rs+size r_end, qs q_start, qs+size q_end FROM ab")(
    lambda spark, d: blocks.exploded(chains(spark, d), "id").withColumn("block_no", F.col("block_no").cast("bigint")))


@_query("blocks_dense_roundtrip", f"{WITH} SELECT id, CAST(n-1 AS BIGINT) block_no, size, CAST(gr AS BIGINT) gap_reference, CAST(gq AS BIGINT) gap_query FROM b JOIN ch USING (k)")
def blocks_dense_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = chains(spark, sf_dir).withColumn("a", blocks.absolute(F.col("blocks"), F.col("r_start"), F.col("q_start")))
    back = placed.withColumn("d", blocks.dense(F.col("a")))
    return back.select("id", F.posexplode("d").alias("block_no", "dense")).select("id", F.col("block_no").cast("bigint").alias("block_no"), "dense.*")


@_query("zero_gap_merge", f"""{WITH}{AB}, tc AS (SELECT *, n<m AND gr=0 AND gq=0 nxt, coalesce(lag(n<m AND gr=0 AND gq=0) OVER w, false) prv, lead(rs+size) OVER w nre, lead(qs+size) OVER w nqe,
 CAST(sum(CASE WHEN n<m AND gr=0 AND gq=0 THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS BIGINT) merges FROM ab WINDOW w AS (PARTITION BY k ORDER BY n))
SELECT id, merges, rs r_start, CASE WHEN nxt THEN nre ELSE rs+size END r_end, qs q_start, CASE WHEN nxt THEN nqe ELSE qs+size END q_end FROM tc WHERE NOT prv""")
def zero_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains(spark, sf_dir).select("id", blocks.zero_gap_merges(F.col("blocks")).alias("merges"), blocks.merged_pairs(F.col("blocks"), F.col("r_start"), F.col("q_start")).alias("a"))
    return rows.select("id", "merges", F.inline("a"))


@_query("validate_chains", f"""{WITH} SELECT k, CASE WHEN re <= r_start THEN 'chain end must be greater than start' WHEN re > 10000 THEN 'chain extends past sequence size' WHEN k % 13 = 0 THEN 'chain id must be positive'
 WHEN re <> r_end THEN 'chain block coordinates do not match header end' END fault FROM (SELECT *, CASE k % 5 WHEN 1 THEN r_end+1 WHEN 2 THEN r_start WHEN 3 THEN r_end+9000 ELSE r_end END re FROM ch)""")
def validate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("CASE offset % 5 WHEN 1 THEN r_end+1 WHEN 2 THEN r_start WHEN 3 THEN r_end+9000 ELSE r_end END")
    broken = chains(spark, sf_dir).withColumn("r_end", end).withColumn("id", F.when(F.col("offset") % 13 == 0, 0).otherwise(F.col("id")))
    return filters.validated(broken).select(F.col("offset").alias("k"), "fault")


_HEADER_SQL = "concat_ws(' ', 'chain', score, r_name, r_size, r_strand, r_start, r_end, q_name, q_size, q_strand, q_start, q_end, {id})"
_DENSE = """, tx AS (SELECT k, string_agg(CASE WHEN n<m THEN concat_ws(chr(9), size, gr, gq) ELSE CAST(size AS VARCHAR) END, chr(10) ORDER BY n) body FROM b GROUP BY k)"""
_query("render_dense", f"{WITH}{_DENSE} SELECT id, concat({_HEADER_SQL.format(id='id')}, chr(10), body, chr(10)) record FROM ch JOIN tx USING (k)")(lambda spark, d: chains(spark, d).select("id", render.record().alias("record")))
_query("render_long", f"""{WITH}{AB}, tx AS (SELECT k, string_agg(CASE WHEN n<m THEN concat_ws(chr(9), rs, qs, size, gr, gq) ELSE concat_ws(chr(9), rs, qs, size) END, chr(10) ORDER BY n) body FROM ab GROUP BY k)
SELECT id, concat({_HEADER_SQL.format(id='id')}, chr(10), body, chr(10)) record FROM ch JOIN tx USING (k)""")(lambda spark, d: chains(spark, d).select("id", render.record(long=True).alias("record")))

_ORDERS = {"score": "score DESC, id", "target": "r_name, r_start, id", "query": "q_name, q_start, id", "id": "id"}
for _by, _order in _ORDERS.items():
    _query(f"sort_{_by}", f"{WITH} SELECT CAST(row_number() OVER (ORDER BY {_order}) AS BIGINT) AS rank, id, score FROM ch")(lambda spark, d, by=_by: ordering.ranked(chains(spark, d), ordering.keys(by)).select("rank", "id", "score"))
_query("sort_rename", f"{WITH} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) id, id old_id, score FROM ch")(lambda spark, d: ordering.renumbered(chains(spark, d)).select("id", "old_id", "score"))
_query("sort_index", f"""{WITH}{_DENSE}, o AS (SELECT id, r_name, r_start, strlen(concat({_HEADER_SQL.format(id='id')}, chr(10), body, chr(10))) + 1 bytes FROM ch JOIN tx USING (k)),
r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY r_name, r_start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) pos, lag(r_name) OVER (ORDER BY r_name, r_start, id) prv FROM o)
SELECT CAST(pos AS BIGINT) AS "offset", lower(to_hex(CAST(pos AS BIGINT))) offset_hex, r_name AS key FROM r WHERE prv IS NULL OR prv <> r_name""")(lambda spark, d: ordering.index(chains(spark, d), "target"))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    every = chains(spark, sf_dir)
    return [every.filter("id % 2 = 0"), every.filter("id % 2 = 1")]


_query("merge_union", f"{WITH} SELECT CAST(id % 2 AS INT) file_no, id, score FROM ch")(lambda spark, d: ordering.concatenated(_halves(spark, d)).select("file_no", "id", "score"))
_query("merge_sorted_rename", f"{WITH} SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) id, id old_id, CAST(id % 2 AS INT) file_no FROM ch")(lambda spark, d: ordering.merged(_halves(spark, d), rename=True).select("id", "old_id", "file_no"))
_query("merge_metadata_distinct", "SELECT CAST(0 AS INT) file_no, CAST(min(n_nationkey) AS BIGINT) AS \"offset\", concat('#region ', CAST(n_regionkey AS VARCHAR)) line FROM nation GROUP BY n_regionkey")(
    lambda spark, d: ordering.distinct_metadata(spark.read.parquet(f"{d}/nation.parquet").select(F.lit(0).alias("file_no"), F.col("n_nationkey").cast("bigint").alias("offset"), F.concat(F.lit("#region "), F.col("n_regionkey").cast("string")).alias("line"))))

_ORD = "CAST(row_number() OVER (ORDER BY k) AS BIGINT) - 1 i, count(*) OVER () total"
_query("split_files", f"{WITH}, p AS (SELECT id, {_ORD} FROM ch), f AS (SELECT unnest(range(0, 7)) f) SELECT id, CAST(f AS BIGINT) part FROM p JOIN f ON i >= (f*total)//7 AND i < ((f+1)*total)//7")(lambda spark, d: split.split(chains(spark, d), files=7).select("id", "part"))
_query("split_chunks", f"{WITH}, p AS (SELECT id, {_ORD} FROM ch) SELECT id, i//1000 part FROM p")(lambda spark, d: split.split(chains(spark, d), chunks=1000).select("id", "part"))
#: The public SplitMix64 generator and the swaps that it draws for range(n), whose references are followed by recursion.
MIXED = """z AS (SELECT i, n, ((({seed} + ({number} + 1) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT))::UBIGINT z FROM {source}),
z1 AS (SELECT i, n, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT z FROM z),
z2 AS (SELECT i, n, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT z FROM z1),
mx AS (SELECT i, n, xor(z, z >> 31) z FROM z2)"""
SHUFFLE = f""", cn AS (SELECT count(*)::UHUGEINT n FROM ch), ix AS (SELECT unnest(range(0, n::BIGINT))::UHUGEINT i, n FROM cn),
{MIXED.format(seed='42::UHUGEINT', number='n - 1 - i', source='ix WHERE i > 0')},
sw AS (SELECT i::BIGINT i, ((z::UHUGEINT * (i + 1)) // 18446744073709551616::UHUGEINT)::BIGINT j FROM mx UNION ALL SELECT 0, 0),
la AS (SELECT i, j, lead(i) OVER (PARTITION BY j ORDER BY i) later FROM sw), nx AS (SELECT j s, min(i) t FROM sw WHERE i > j GROUP BY j),
wk AS (SELECT s, t FROM nx UNION ALL SELECT wk.s, nx.t FROM wk JOIN nx ON nx.s = wk.t), rt AS (SELECT s, max(t) t FROM wk GROUP BY s),
pm AS (SELECT la.i place, coalesce(rt.t, later, j) ordinal FROM la LEFT JOIN rt ON rt.s = later)"""
RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)
_query("split_randomized", f"{RECURSIVE}{SHUFFLE}, p AS (SELECT id, {_ORD} FROM ch) SELECT id, CAST(((place + 1) * 7 - 1) // total AS BIGINT) part FROM p JOIN pm ON ordinal = i")(lambda spark, d: split.split(chains(spark, d), files=7, randomize=True, seed=42).select("id", "part"))

for _side, _p, _o in (("reference", "r", "q"), ("query", "q", "r")):
    _head = f"{_p}_name chrom, {_p}_start chrom_start, {_p}_end chrom_end"
    _six = f"{_head}, concat('chain_', CAST(id AS VARCHAR)) AS name, CAST(0 AS INT) AS score, {_p}_strand strand"
    _sums = f"{AB}, bb AS (SELECT k, CAST(count(*) AS INT) bc, concat(string_agg(CAST(size AS VARCHAR), ',' ORDER BY n), ',') bs, concat(string_agg(CAST({_p}s AS VARCHAR), ',' ORDER BY n), ',') raw FROM (SELECT ab.*, ab.{_p}s - ch.{_p}_start AS o FROM ab JOIN ch USING (k)) GROUP BY k)".replace(f"CAST({_p}s AS VARCHAR)", "CAST(o AS VARCHAR)")
    _query(f"bed3_{_side}", f"{WITH} SELECT {_head} FROM ch")(lambda spark, d, s=_side: bed.project(chains(spark, d), s, 3))
    _query(f"bed6_{_side}", f"{WITH} SELECT {_six} FROM ch")(lambda spark, d, s=_side: bed.project(chains(spark, d), s, 6))
    _query(f"bed12_{_side}", f"{WITH}{_sums} SELECT {_six}, {_p}_start thick_start, {_p}_end thick_end, '0,0,0' item_rgb, bc block_count, bs block_sizes, raw block_starts FROM ch JOIN bb USING (k)")(lambda spark, d, s=_side: bed.project(chains(spark, d), s, 12))
    _query(f"bed_long_{_side}", f"{WITH} SELECT {_head}, concat({_o}_name, '_', id, '_', {_o}_end - {_o}_start) AS name, CAST(0 AS INT) AS score, {_p}_strand strand FROM ch")(lambda spark, d, s=_side: bed.project(chains(spark, d), s, 6, long_names=True))
_query("bed_spanned", f"{WITH} SELECT r_name chrom, r_start chrom_start, r_end chrom_end, concat('chain_', id) AS name, CAST(0 AS INT) AS score, r_strand strand, r_start thick_start, r_end thick_end, '0,0,0' item_rgb, CAST(1 AS INT) block_count, concat(r_end-r_start, ',') block_sizes, '0,' block_starts FROM ch")(lambda spark, d: bed.project(chains(spark, d), "reference", 12, spanned=True))
_query("bed_sorted", f"{WITH} SELECT r_name chrom, r_start chrom_start, r_end chrom_end FROM ch ORDER BY 1, 2, 3")(lambda spark, d: bed.project(chains(spark, d), "reference", 3, sort_by="coordinate"))

GRID = "SELECT i, CASE WHEN i % 3 = 1 THEN 0 ELSE (i*i*i) % 300007 END dq, CASE WHEN i % 3 = 2 THEN 0 ELSE (i*i*7) % 300007 END dt FROM (SELECT CAST(o_orderkey AS BIGINT) i FROM orders)"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of GRID; powers are taken modulo 300007 step by step, as those of large keys exceed 64 bits."""
    power = lambda *f: F.expr(reduce(lambda a, b: f"({a} * {b}) % 300007", f))
    i, zero, x = F.col("i"), F.lit(0).cast("bigint"), "(i % 300007)"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("bigint").alias("i"))
    return orders.select("i", F.when(i % 3 == 1, zero).otherwise(power(x, x, x)).alias("dq"), F.when(i % 3 == 2, zero).otherwise(power(x, x, "7")).alias("dt"))


for _table in ("loose", "medium", "cheap", "rnaDna"):
    _query(f"gap_cost_{_table.lower()}", f"WITH grid AS ({GRID}){_cost_cte(_table, 'grid')} SELECT i, dq, dt, cost FROM gc")(
        lambda spark, d, t=_table: _grid(spark, d).withColumn("cost", F.expr(gaps.cost_sql("dq", "dt", t))))

_query("revcomp", "SELECT p_partkey, reverse(translate(p_name, 'ACGTacgtRYKMBVDHrykmbvdh', 'TGCAtgcaYRMKVBHDyrmkvbhd')) rc FROM part")(lambda spark, d: spark.read.parquet(f"{d}/part.parquet").select("p_partkey", bases.reverse_complement(F.col("p_name")).alias("rc")))
_PAIRS = "SELECT DISTINCT substr('ACGTNacgtnRX', CAST(o_orderkey % 12 AS INT) + 1, 1) q, substr('ACGTNacgtnRX', CAST((o_orderkey // 12) % 12 AS INT) + 1, 1) t FROM orders"
_query("matrix_pair", f"""WITH p AS ({_PAIRS}), m(x, v) AS (VALUES ('AA',91),('TT',91),('CC',100),('GG',100),('AC',-114),('CA',-114),('GT',-114),('TG',-114),('AG',-31),('GA',-31),('CT',-31),('TC',-31),('AT',-123),('TA',-123),('CG',-125),('GC',-125))
SELECT q, t, CAST(coalesce(v, 0) AS INT) score FROM p LEFT JOIN m ON x = upper(q) || upper(t)""")(
    lambda spark, d: spark.sql(_PAIRS.replace("//", "div").replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{d}/orders.parquet")).select("q", "t", bases.pair_score(F.col("q"), F.col("t")).alias("score")))

_GAPS = _cost_cte("loose", "(SELECT id, CAST(gq AS BIGINT) dq, CAST(gr AS BIGINT) dt FROM ab WHERE n < m)")
SCORE = f"{WITH}{AB}{BASE}{_GAPS}, gs AS (SELECT id, CAST(sum(cost) AS BIGINT) cost FROM gc GROUP BY id), sc AS (SELECT ct.id, mt - coalesce(cost, 0) score FROM ct LEFT JOIN gs USING (id))"
_query("score_chain", f"{SCORE} SELECT id, score FROM sc WHERE score >= -3000")(lambda spark, d: scoring.scored(chains(spark, d), sequences(spark, d), -3000).select("id", "score"))
_query("score_sorted", f"{SCORE} SELECT id, score FROM sc WHERE score >= -2000 ORDER BY score DESC, id")(lambda spark, d: scoring.scored(chains(spark, d), sequences(spark, d), -2000, sort_by_score=True).select("id", "score"))
_query("score_skip_missing", f"{SCORE} SELECT id, sc.score FROM sc JOIN ch USING (id) WHERE sc.score >= -3000 AND r_name <> 'chr5' AND q_name <> 'qry3'")(
    lambda spark, d: scoring.scored(chains(spark, d), sequences(spark, d).filter("name not in ('chr5', 'qry3')"), -3000, skip_missing=True).select("id", "score"))
_query("score_missing_report", f"{WITH} SELECT id, r_name, q_name FROM ch WHERE r_name = 'chr5' OR q_name = 'qry3'")(
    lambda spark, d: scoring.missing_sequences(chains(spark, d), sequences(spark, d).filter("name not in ('chr5', 'qry3')")).select("id", "r_name", "q_name"))
_BEST = "greatest(a+c, a+g, a+t, c+g, c+t, g+t)"
_M = "CAST(a+c+g+t AS DOUBLE)"
_DEG = f"(a+c+g+t > 0 AND ({_BEST}/{_M} - CAST(0.8 AS DOUBLE) <= 0 OR score*(CAST(1.01 AS DOUBLE) - ({_BEST}/{_M} - CAST(0.8 AS DOUBLE))/(CAST(1.0 AS DOUBLE)-CAST(0.8 AS DOUBLE))) >= 5000))"
_REP = "(total > 0 AND CAST(score AS DOUBLE)*2*CAST(total-repeats AS DOUBLE)/CAST(total AS DOUBLE) >= 5000)"
_query("antirepeat_counts", f"{WITH}{AB}{BASE} SELECT id, mt matches, n, a, c, g, t, repeats, total FROM ct")(lambda spark, d: scoring.counted(chains(spark, d), sequences(spark, d)).select("id", "counts.*"))
_query("degeneracy", f"{WITH}{AB}{BASE} SELECT id, {_DEG} passes FROM ct")(lambda spark, d: scoring.counted(chains(spark, d), sequences(spark, d)).select("id", scoring.degeneracy_passes(F.col("counts"), F.col("score"), 5000).alias("passes")))
_query("repeat_filter", f"{WITH}{AB}{BASE} SELECT id, {_REP} passes FROM ct")(lambda spark, d: scoring.counted(chains(spark, d), sequences(spark, d)).select("id", scoring.repeat_passes(F.col("counts"), F.col("score"), 5000).alias("passes")))
_query("antirepeat", f"{WITH}{AB}{BASE} SELECT id, score FROM ct WHERE score >= 200000 OR ({_DEG} AND {_REP})")(lambda spark, d: scoring.antirepeat(chains(spark, d), sequences(spark, d)).select("id", "score"))
_query("antirepeat_rescored", f"{SCORE}, kp AS (SELECT id FROM ct WHERE score >= 200000 OR ({_DEG} AND {_REP})) SELECT id, score FROM sc JOIN kp USING (id) WHERE score >= -3000 ORDER BY score DESC, id")(
    lambda spark, d: scoring.antirepeat_scored(chains(spark, d), sequences(spark, d), min_rescore=-3000, sort_by_score=True).select("id", "score"))

_query("generated_ids", f"{WITH} SELECT k, CASE WHEN k % 3 = 0 THEN CAST(row_number() OVER (PARTITION BY k % 3 = 0 ORDER BY k) AS BIGINT) ELSE id END id FROM ch")(
    lambda spark, d: ordering.generated_ids(chains(spark, d).withColumn("id_explicit", F.col("offset") % 3 != 0).withColumn("id", F.when(F.col("id_explicit"), F.col("id")).cast("decimal(20,0)"))).select(F.col("offset").alias("k"), F.col("id").cast("bigint").alias("id")))
_query("referenced_names", f"{WITH} SELECT DISTINCT 'reference' side, r_name AS name FROM ch UNION SELECT DISTINCT 'query', q_name FROM ch")(lambda spark, d: scoring.referenced_names(chains(spark, d)))


@_query("chain_spans", f"""{WITH}{_DENSE}, o AS (SELECT k, id, CAST(strlen(concat({_HEADER_SQL.format(id='id')}, chr(10), body, chr(10))) + 1 AS BIGINT) len FROM ch JOIN tx USING (k))
SELECT id, CAST(coalesce(sum(len) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", len FROM o""")
def chain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = chains(spark, sf_dir).select("id", F.col("offset").alias("k"), render.record_bytes(render.record()).alias("len"))
    return ordering.ranked(sized, [F.col("k").asc()], F.col("len")).select("id", F.col("before").alias("offset"), "len")
