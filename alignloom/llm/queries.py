"""The registered queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.llm import conversations, decontaminate, exactdedup, packing, passages, periodic, secrets, sharding, simhash, tokenfiles, toxicity, warc, winnowing
from alignloom.llm.common import table


def _of_kind(kind: str):
    return lambda s: F.when(s["kind"] == kind, 1)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, a digest of their spans, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secrets.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.array_compact(F.transform("spans", _of_kind(k)))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(secrets.spelled(base), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op1_sql() -> str:
    """The same by whole scans: each pattern cuts each text into gaps and matches, whose lengths give the places."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = secrets.BASE + secrets.EXTRA
    cut = ", ".join(f"regexp_split_to_array(body, {quoted(r.pattern)}) g{i}, regexp_extract_all(body, {quoted(r.pattern)}) m{i}" for i, r in enumerate(rules))
    placed = []
    for i, r in enumerate(rules):
        start = f"coalesce(list_sum(list_transform(g{i}[1:n], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m{i}[1:n-1], lambda y: length(y))), 0)"
        ok = f"length(regexp_extract(m{i}[n], {quoted(r.pattern)}, {r.group})) >= {r.least}" if r.least else "true"
        placed.append(f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda n: {ok}), lambda n: {{'s': CAST({start} AS BIGINT), 'r': {i}, 'e': CAST({start} + length(m{i}[n]) AS BIGINT), 'k': '{r.kind}'}})")
    spelled = lambda x: f"array_to_string(list_transform({x}, lambda z: concat(z.k, ':', z.s, ':', z.e)), ',')"
    base = f"list_filter(a, lambda z: z.r < {len(secrets.BASE)})"
    counts = ", ".join(f"CAST(len(list_filter(a, lambda z: z.r = {i})) AS BIGINT) n_{r.kind}" for i, r in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') body FROM documents),
c AS (SELECT doc_id, {cut} FROM d),
p AS (SELECT doc_id, list_sort(flatten([{', '.join(placed)}])) a FROM c)
SELECT doc_id, {counts}, sha256(coalesce({spelled(base)}, '')) base_sha256, coalesce({spelled('a')}, '') spans FROM p"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 8 and slot, under the law `rows`."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8, seed=42)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurrences of 10-word windows of benchmark items."""
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), 10)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP5_SQL = f"""WITH dw AS (SELECT doc_id, {_WORDS} w, row_number() OVER () r FROM documents),
bw AS (SELECT item_id, {_WORDS} w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) n, w[i:i + least(len(w), 10) - 1] g FROM bi),
dp AS (SELECT r, unnest(w) word, generate_subscripts(w, 1) i FROM dw),
dg AS (SELECT r, i, array_agg(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) g FROM dp),
di AS (SELECT r, i, n, g[1:n] g FROM dg, (SELECT DISTINCT n FROM win) WHERE len(g) >= n),
hit AS (SELECT r, i, di.n, item_id FROM di JOIN win ON win.n = di.n AND di.g = win.g),
pos AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + n)) p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels of held-out rows are not learned from."""
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from .warc.zst archives."""
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


OP4_SQL = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) payload_bytes, sha1(coalesce(html, '')) payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) leader FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < leader THEN 'revisit' ELSE 'response' END record_type,
CASE WHEN payload_bytes >= 1000 AND page_id < leader THEN leader END refers_to FROM m"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, capacity=4096, seed=42)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum as read back from token-id files."""
    return tokenfiles.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return winnowing.edited(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links reach from it."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a passage that other documents repeat."""
    return passages.repeats(table(spark, sf_dir, "documents"))


def _crc32_sql(ascii_text: str) -> str:
    """The unsigned CRC-32 of an ASCII string, by the column `crc_t` of the table `crc`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({ascii_text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc_t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295::BIGINT)"


_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(CAST(k AS BIGINT), range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) crc_t)"


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    source = table(spark, sf_dir, "conversations")
    found, ids = conversations.assess(conversations.damaged(source)), source.select("conv_id").distinct()
    met = ids.alias("i").join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    longs = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("i.conv_id", *longs, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _op11_sql() -> str:
    """Costs and labels of the four grammar states in one string each, nine digits then labels, so that least() compares both; ~ is out of reach."""
    plus = lambda w, cost, label: f"CASE WHEN {w} = '~' THEN '~' ELSE concat(lpad(CAST(CAST(left({w}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0'), substr({w}, 10), '{label}') END"
    # states: 0 nothing yet, 1 after s, 2 after u, 3 after a
    inserted = lambda w: (f"'~'", "'~'", f"least({', '.join(plus(w[i], 3, 'I') for i in (0, 1, 3))})", plus(w[2], 3, "I"))
    names = [f"w{i}" for i in range(4)]
    once, twice = [f"i{i}" for i in range(4)], [f"j{i}" for i in range(4)]
    closure = f"""SELECT *, {', '.join(f'{e} j{i}' for i, e in enumerate(inserted(once)))} FROM (SELECT *, {', '.join(f'{e} i{i}' for i, e in enumerate(inserted(names)))} FROM {{source}})"""
    best = [f"least({a}, {b}, {c})" for a, b, c in zip(names, once, twice)]
    keep = lambda w, to: plus(w, "3 * r.truncated", "K") if to is None else plus(w, to, "K")
    row = lambda sources, ini, can_rerole: f"least({', '.join([x for w in sources for x in ([f'CASE WHEN r.ini = ' + repr(ini) + f' AND NOT r.bad THEN {keep(w, None)} ELSE ' + repr('~') + ' END'] + ([f'CASE WHEN r.bad THEN ' + repr('~') + f' ELSE {plus(w, chr(51) + chr(43) + chr(51) + chr(42) + "r.truncated", "R")} END'] if can_rerole else []))])})"
    steps = [plus("b0", 4, "D"), f"least({plus('b1', 4, 'D')}, {row(['b0'], 's', False)})", f"least({plus('b2', 4, 'D')}, {row(['b0', 'b1', 'b3'], 'u', True)})", f"least({plus('b3', 4, 'D')}, {row(['b2'], 'a', True)})"]
    blank = r"'[^\x20\x09-\x0D]'"
    return rf"""WITH RECURSIVE {_CRC_TABLE},
src AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc32_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 dmg FROM conversations, crc),
dam AS (SELECT conv_id, turn, CASE WHEN dmg = 4 THEN 'user' ELSE role END role, CASE dmg WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text, unnest(range(CASE dmg WHEN 3 THEN 2 ELSE 1 END)) copy FROM src WHERE dmg <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) i FROM dam),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 again, NOT regexp_matches(text, {blank.replace(chr(92) * 2, chr(92))}) blank,
 CASE WHEN regexp_matches(text, '[.!?][ 	-
]*$') THEN 0 ELSE 1 END unended, left(role, 1) ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) pair FROM num),
r AS (SELECT *, blank OR again bad, CASE WHEN blank OR again THEN 0 ELSE unended END truncated FROM seen),
fold AS (SELECT conv_id, 0::BIGINT i, '000000000' w0, '~' w1, '~' w2, '~' w3 FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT b.conv_id, b.i + 1, {', '.join(steps)} FROM (SELECT conv_id, i, {', '.join(f'{e} b{k}' for k, e in enumerate(best))} FROM ({closure.format(source='fold')})) b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1),
done AS (SELECT conv_id, i, least(b0, b3) w FROM (SELECT conv_id, i, {', '.join(f'{e} b{k}' for k, e in enumerate(best))} FROM ({closure.format(source='(SELECT * FROM fold QUALIFY i = max(i) OVER (PARTITION BY conv_id))')}))),
lab AS (SELECT conv_id, p, substr(w, 9 + p, 1) l, sum(CASE WHEN substr(w, 9 + p, 1) = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) i FROM (SELECT conv_id, w, unnest(range(1, length(w) - 8)) p FROM done)),
out AS (SELECT lab.conv_id, p, l, text, role, count(*) OVER (PARTITION BY lab.conv_id ORDER BY p) - max(CASE WHEN l = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY lab.conv_id) nth FROM lab LEFT JOIN r ON lab.l <> 'I' AND r.conv_id IS NOT DISTINCT FROM lab.conv_id AND r.i = lab.i WHERE l <> 'D'),
rep AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN concat(role, ':', text) ELSE concat(CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN l = 'R' THEN text ELSE '' END) END, chr(10) ORDER BY p) body FROM out GROUP BY conv_id),
cnt AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) gaps, CAST(count(*) FILTER (blank) AS BIGINT) blank, CAST(count(*) FILTER (again AND NOT blank) AS BIGINT) duplicate, CAST(sum(truncated) AS BIGINT) truncated, CAST(count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS BIGINT) illegal FROM r GROUP BY conv_id)
SELECT done.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) audit, sha256(coalesce(body, '')) repaired_sha256
FROM done LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM done.conv_id LEFT JOIN rep ON rep.conv_id IS NOT DISTINCT FROM done.conv_id"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text group and the row of it that stays."""
    return exactdedup.assess(table(spark, sf_dir, "documents"))


OP12_SQL = """SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 kept, sha256(coalesce(text, '')) text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, one text in ten made periodic first."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.when(h % 10 == 0, F.floor(h / 10)), F.lit(-1)).alias("g"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    periodic = F.expr("array_join(transform(sequence(0, cast(n - 1 as int)), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) as int) + 1)), ' ')")
    planted = docs.withColumn("w", F.when(F.col("g") >= 0, words)).withColumn("n", F.size("w").cast("long"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    found = periodic_runs(planted.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text")))
    return found


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The digest of periodic.detect: doc_id, n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text."""
    found = periodic.detect(docs)
    more = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(more(r, b) > 0, r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Pairs of like words at one distance, in unbroken rows: islands of (place - number).
OP13_SQL = rf"""WITH {_CRC_TABLE}, d0 AS (SELECT doc_id, row_number() OVER () r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, {_crc32_sql("CAST(doc_id AS VARCHAR)")} h FROM documents, crc),
d1 AS (SELECT *, len(w) n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a FROM d0),
d AS (SELECT doc_id, r, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END w FROM d1),
t AS (SELECT r, n, unnest(w) x, generate_subscripts(w, 1) - 1 i FROM d),
e AS (SELECT s.r, s.i, u.i - s.i q FROM t s JOIN t u ON s.r = u.r AND s.x = u.x AND u.i > s.i AND 4 * (u.i - s.i) <= s.n),
g AS (SELECT r, q, min(i) s, count(*) + q len FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) island FROM e) GROUP BY r, q, island),
z AS (SELECT r, s, len, min(q) q FROM g WHERE len >= greatest(6, 4 * q) GROUP BY r, s, len),
b AS (SELECT r, count(*) n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) txt FROM z GROUP BY r),
m AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT r, list_distinct(flatten(list(range(s + q, s + len)))) gs FROM z GROUP BY r),
k AS (SELECT t.r, string_agg(x, ' ' ORDER BY i) body FROM t LEFT JOIN (SELECT r, unnest(gs) i, true hit FROM gone) o USING (r, i) WHERE hit IS NULL GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) n_runs, CAST(s AS BIGINT) AS start, CAST(len AS BIGINT) length, CAST(q AS BIGINT) period, CAST(1000 * len // q AS BIGINT) exponent_milli, sha256(coalesce(txt, '')) runs_sha256, sha256(coalesce(body, '')) collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN k USING (r)"""


QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_sharding": op2_sharding, "op3_toxicity": op3_toxicity, "op4_warc": op4_warc, "op5_decontamination": op5_decontamination, "op6_packing": op6_packing, "op7_token_files": op7_token_files, "op8_winnowing": op8_winnowing, "op9_simhash": op9_simhash, "op10_passages": op10_passages, "op11_conversation_repair": op11_conversation_repair, "op12_exact_dedup": op12_exact_dedup, "op13_periodic_runs": op13_periodic_runs}
ORACLES = {"op1_secret_scan": op1_sql(), "op4_warc": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_conversation_repair": _op11_sql(), "op12_exact_dedup": OP12_SQL, "op13_periodic_runs": OP13_SQL}
