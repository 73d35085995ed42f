"""What must not grow faster than the input: ranges, tasks, bytes read; and values that only large keys reach."""

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from alignloom.sources import chains, scan

A = "chain 5 c 90 + 0 20 q 90 - 0 20 1\n20\n\n"
BAD = ["rubbish\n", "chain 5 c\n9\n", A.replace("20\n\n", "20 1\n\n"), "chain 1 c 9 + 0 9 q 9 + 0 9 3", "chain 1 c 9 + 0 9 q 9 + 0 9 3\n\n" + A, A + "x\n" + A + "y\n", "#n\n" + A + "chain 1 c 9 + 0 9 q 9 + 0 9 3\n+9\n"]


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        part = super().read(n)
        self.got += len(part)
        return part


def test_ranges_of_a_large_file_are_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chains, "MOST_RANGES", 16)
    path = tmp_path / "a.chain"
    path.write_text(A * 500)
    spans = chains.ranges_of(str(path), 20)
    assert len(spans) == 16 and [s[3] for s in spans[1:]] == [s[4] for s in spans[:-1]] and spans[-1][4] == len(A) * 500
    assert len(chains.ranges_of(str(path), 4000)) == -(-len(A) * 500 // 4000)
    rows = chains.read(spark, str(path), range_bytes=20)
    assert rows.count() == 500


def test_neighbouring_ranges_share_a_task(spark, tmp_path):
    path = tmp_path / "a.chain"
    path.write_text(A * 500)
    found = chains.read_items(spark, str(path), range_bytes=20)
    assert len(chains.ranges_of(str(path), 20)) > found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert [r["offset"] for r in found.select("offset").collect()] == [len(A) * i for i in range(500)]


def test_a_range_reads_little_beyond_it():
    stream = Counted((A * 200_000).encode())
    assert sum(b.num_rows for b in scan.parsed(stream, 0, 20 * len(A))) == 20
    assert stream.got < 20 * len(A) + 2 * scan.SLACK
    stream = Counted((A * 200_000).encode())
    assert scan.scanned(stream, 0, 20 * len(A))[0].starts[0] == 20
    assert stream.got < 20 * len(A) + 2 * scan.SLACK


def test_faulty_texts_are_read_as_one(monkeypatch):
    """Items and faults are those of each text alone, also where windows are short; the reader is entered once."""
    bodies = [t.encode() for b in BAD for t in (A, b, "", "#m\n" + A, b + A, A + b, A.rstrip("\n"))]
    alone = [pa.Table.from_batches(scan.parsed(io.BytesIO(b), 0), scan.schema()).to_pylist() for b in bodies]
    want = [(i, r) for i, rows in enumerate(alone) for r in rows]
    assert sum(r["error"] is not None for _, r in want) > 20
    real, calls = scan.parsed, []
    monkeypatch.setattr(scan, "parsed", lambda *a, **k: calls.append(1) or real(*a, **k))
    for window in (40, 300, 4 << 20):
        monkeypatch.setattr(scan, "WINDOW", window)
        table, of = chains.together(bodies, scan.Options())
        assert list(zip(of.tolist(), table.to_pylist())) == want, window
    assert len(calls) == 3


def test_gap_grid_of_large_keys(spark, tmp_path):
    from alignloom.plans.queries import QUERIES

    keys = [0, 1, 2, 2_097_151, 2_097_152, 9_000_000, 9_000_001, 9_000_002, 3_000_000_000_001]
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64())}), tmp_path / "orders.parquet")
    for name in ("gap_cost_loose", "gap_cost_medium", "gap_cost_cheap", "gap_cost_rnadna"):
        got = {r["i"]: (r["dq"], r["dt"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: (0 if i % 3 == 1 else i**3 % 300007, 0 if i % 3 == 2 else i * i * 7 % 300007) for i in keys}, name
    import alignloom.plans.texts  # noqa: F401

    assert QUERIES["gap_file"](spark, str(tmp_path)).count() == len(keys)


def test_gap_costs_are_compiled(spark):
    """The JVM compiles no method of more than 8000 bytes of code; the costs are those of the columns, which have a line in each arm."""
    from pyspark.sql import functions as F

    from alignloom.functions import gaps

    of_file = gaps.GapTable(3, (3, 10, 100), (10.5, -30.25, -300), (20, 60, 70.5), (0, -0.5, -1))
    rows = spark.range(0, 9000).selectExpr("case when id % 5 = 0 then null when id % 3 = 1 then 0 else id * id % 700 * (id % 1000) - 40 end dq", "case when id % 7 = 0 then null when id % 3 = 2 then 0 else id * 31 % (id + 1) - 20 end dt")
    for table in (*gaps.TABLES, of_file):
        found = rows.withColumn("cost", F.expr(gaps.cost_sql("dq", "dt", table)))
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(found._jdf.queryExecution().executedPlan())
        assert all(0 < stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size())) and stages.size(), table
        zero = F.lit(0).cast("bigint")
        assert found.filter(~F.col("cost").eqNullSafe(gaps.cost(F.coalesce("dq", zero), F.coalesce("dt", zero), table))).count() == 0, table


def test_text_is_made_once(spark):
    """A chain's text is made as it is written, not for the sample that lays the rows out too."""
    from pyspark.sql import functions as F

    from alignloom.plans import texts

    made = spark.sparkContext.accumulator(0)

    def body(n):
        made.add(1)
        return str(n)

    paths = texts._written(spark.range(500, 0, -1).withColumnRenamed("id", "offset"), F.udf(body)("offset"))
    assert "".join(open(p.removeprefix("file:")).read() for p in paths) == "".join(f"{n}\n" for n in range(1, 501))
    assert made.value == 500


def test_absolute_blocks_over_chunks(spark):
    """The score of absolute blocks over chunks is that over whole sequences, also for bases outside ASCII; a faulty list and a block beyond the sequence fail."""
    import pytest
    from pyspark.sql import functions as F

    from alignloom.functions import bases
    from alignloom.operators import scoring
    from alignloom.sources.sequences import chunked

    texts = {"reference": "ACGTé" * 30_000, "query": "AéGTaccN" * 20_000}
    whole = spark.createDataFrame([(side, "s", t) for side, t in texts.items()], "side string, name string, seq string")
    block = "array<struct<r_start:bigint,r_end:bigint,q_start:bigint,q_end:bigint>>"
    lists = [[(3, 90, 4, 91), (95, 70_000, 100, 70_005)], [(65_530, 65_541, 1, 12), (131_000, 131_100, 140_000, 140_100)]]
    rows = spark.createDataFrame([(0, i, "s", "s", len(texts["query"]), sign, a) for i, (a, sign) in enumerate((a, s) for a in lists for s in "+-")], f"file_no int, offset bigint, r_name string, q_name string, q_size bigint, q_strand string, absolute {block}")
    found = scoring.absolute_scored(rows, "absolute", chunked(whole))
    q = F.when(F.col("q_strand") == "-", bases.reverse_complement(F.lit(texts["query"]))).otherwise(F.lit(texts["query"]))
    want = rows.select("offset", scoring.absolute_score(F.lit(texts["reference"]), q, F.col("absolute")).alias("score"))
    assert sorted(map(tuple, found.select("offset", "score").collect())) == sorted(map(tuple, want.collect()))
    for bad in ([(9, 3, 9, 3)], [(149_990, 150_010, 0, 20)]):
        with pytest.raises(Exception):
            scoring.absolute_scored(rows.limit(1).withColumn("absolute", F.expr(f"array(named_struct('r_start', {bad[0][0]}L, 'r_end', {bad[0][1]}L, 'q_start', {bad[0][2]}L, 'q_end', {bad[0][3]}L))")), "absolute", chunked(whole)).collect()


def test_merged_inputs_stay_whole(spark, tmp_path, monkeypatch):
    """Each input is one file whatever its size, also where stretches of it are packed apart, and is read by ranges of its text."""
    import gzip

    from alignloom.operators import files

    monkeypatch.setattr(files, "RANGE_BYTES", 1001)
    paths = [tmp_path / "a.chain", tmp_path / "b.chain"]
    for i, path in enumerate(paths):
        path.write_text((A * (300 + i))[:-2])
    want = [A * 300, (A * 301)[:-2]]
    for gzipped in (False, True):
        out = str(tmp_path / f"out{gzipped}")
        made = sorted(map(tuple, files.merge_files(spark, list(map(str, paths)), out, gzipped).collect()))
        assert [n for _, n in made] == [len(t) for t in want]
        names = [f"{out}/{name}" for name, _ in made]
        got = [(gzip.open(n) if gzipped else open(n, "rb")).read().decode() for n in names]
        assert got == want
        assert chains.read(spark, names, range_bytes=700).count() == 601


def test_digest_of_files_by_steps(spark, tmp_path, monkeypatch):
    import hashlib

    from alignloom.operators import files
    from alignloom.plans import texts

    monkeypatch.setattr(files, "STEP", 1000)
    (tmp_path / "x").write_bytes(b"abc" * 5000)
    (tmp_path / "y").write_bytes(b"")
    assert sorted(map(tuple, texts._content(spark, str(tmp_path)).collect())) == [("x", hashlib.md5(b"abc" * 5000).hexdigest()), ("y", hashlib.md5(b"").hexdigest())]


def test_pieces_are_cut_and_counted_by_vectors(spark, monkeypatch):
    """the rows that reach Python hold pieces only, and counts are the same however few bases are counted at a time."""
    from alignloom.functions import bases
    from alignloom.operators import scoring

    block = "array<struct<size:bigint,gap_reference:bigint,gap_query:bigint>>"
    rows = spark.range(1, 40).selectExpr("0 file_no", "id offset", "'c' r_name", "id r_start", "'q' q_name", "100L q_size", "if(id % 2 = 0, '-', '+') q_strand", "id % 7 q_start", f"cast(array(struct(3L, 3L, 1L), struct(0L, 0L, 0L), struct(20L, 0L, 0L)) as {block}) blocks")
    text = {"reference": "ACGTacgtNn" * 10, "query": "AACCGGTTnN" * 10}
    held = spark.createDataFrame([(s, n, 0, text[s]) for s, n in (("reference", "c"), ("query", "q"))], "side string, name string, bin bigint, seq string")
    found = scoring.counted(rows, held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "transform(" not in plan
    flip = lambda x: x[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))

    def same(r):
        query = flip(text["query"]) if r["q_strand"] == "-" else text["query"]
        pairs = [(text["reference"][r["r_start"] + a + i], query[r["q_start"] + b + i]) for n, a, b in ((3, 0, 0), (20, 6, 4)) for i in range(n)]
        return tuple(sum(x.upper() == y.upper() == c for x, y in pairs) for c in "NACGT") + (sum(x in "acgtn" or y in "acgtn" for x, y in pairs), 23)

    got = found.collect()
    assert len(got) == 39 and all(tuple(r["counts"])[1:] == same(r) for r in got)
    monkeypatch.setattr(bases, "STEP", 5)
    assert {r["offset"]: r["counts"] for r in scoring.counted(rows, held).collect()} == {r["offset"]: r["counts"] for r in got}


def test_a_split_part_is_one_piece_of_a_file(spark, tmp_path, monkeypatch):
    """what a part's task is sent does not grow with its chains; parts that two files share keep their order."""
    from alignloom.operators import files

    texts = ["#first\n" + "".join(A.replace("chain 5", f"chain {n}") + "#n\n" * (n % 2) for n in range(k, k + 500)) for k in (0, 500)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.chain").write_text(text)
    sent, assemble = [], files.assemble
    monkeypatch.setattr(files, "assemble", lambda pieces, *how: (sent.append(pieces.count()), assemble(pieces, *how))[1])
    for how, n in (({"chunks": 300}, 5), ({"files": 7}, 8)):
        out = tmp_path / "-".join(how)
        made = files.split_files(spark, [str(tmp_path / f"{i}.chain") for i in (0, 1)], str(out), **how)
        assert made.rdd.getNumPartitions() > 1
        made.collect()
        names = sorted(p.name for p in out.iterdir() if p.name.startswith("part."))
        assert sent.pop() == n and "".join((out / p).read_text() for p in names) == "".join(texts)
        assert [(out / p).read_text().count("chain ") for p in names] == ([300, 300, 300, 100] if "chunks" in how else [142, 143, 143, 143, 143, 143, 143])


def test_lines_are_shuffled_once(spark, tmp_path):
    """The fixture reads lines once and needs no window; its rows are the SQL's, also where line numbers repeat, orders repeat or lack lines or a customer."""
    import duckdb

    from alignloom.plans import queries, universe

    n, rows = 400, range(4000)
    tables = {
        "customer": {"c_custkey": list(range(0, 60, 2)), "c_nationkey": pa.array([i % 25 for i in range(30)], pa.int32())},
        "orders": {"o_orderkey": [*range(n), 7], "o_custkey": [i * 7 % 62 for i in range(n + 1)], "o_orderstatus": ["FOP"[i % 3] for i in range(n + 1)], "o_totalprice": [i * 997.25 for i in range(n + 1)]},
        "lineitem": {
            "l_orderkey": [i * i // 7 % 390 for i in rows], "l_partkey": [i * 31 % 5 for i in rows], "l_suppkey": [i % 3 for i in rows], "l_linenumber": pa.array([i % 2 for i in rows], pa.int32()), "l_quantity": [float(i * 13 % 50 + 1) for i in rows],
            "l_extendedprice": [i % 7 / 4 for i in rows], "l_discount": [i * 3 % 11 / 100 for i in rows], "l_tax": [i * 5 % 9 / 100 for i in rows], "l_shipdate": pa.array([i % 3 for i in rows], pa.timestamp("us")),
        },
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    found = universe._chains(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Aggregate [") == 1
    db = duckdb.connect()
    for name in tables:
        db.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    body = "(SELECT list({'size': size, 'gap_reference': CAST(gr AS BIGINT), 'gap_query': CAST(gq AS BIGINT)} ORDER BY n) FROM b WHERE b.k = ch.k)"
    want = db.sql(f"{queries.WITH} SELECT id, score, r_name, r_start, r_end, q_name, q_strand, q_start, q_end, CAST({body} AS VARCHAR) FROM ch").fetchall()
    got = [(*r[:-1], str([{f: b[f] for f in ("size", "gap_reference", "gap_query")} for b in r[-1]])) for r in found.select(*queries.HEAD, "blocks").collect()]
    assert len(got) > 100 and sorted(got) == sorted(want)


def test_headers_are_counted_without_gathering(monkeypatch):
    """lines without words are looked through only where they begin with white space; blank lines and headers without an id are found as with words."""
    text = b"".join([b"#n\n\n", *[(b" \t" if i % 7 == 0 else b"") + b"chain 5 c 90 + 0 20 q 90 - 0 20" + (b" %d" % i if i % 3 else b"") + (b" " if i % 2 else b"") + (b" more words" if i % 9 == 1 else b"") + b"\n20\v\n" + [b"\n", b" \r\n", b"\f\n"][i % 3] for i in range(600)]])
    data = np.frombuffer(text, np.uint8)
    bare, worded = scan.lines_of(data, True, with_words=False), scan.lines_of(data, True)
    assert (bare.blank == worded.blank).all() and bare.blank.sum() == 601
    head = np.flatnonzero(~np.concatenate(([False], scan.inside_after(worded, False)[:-1])) & scan.inside_after(worded, False))
    assert scan.without_id(bare) == (worded.n_words[head] < 13).sum() > 100
    seen, dark = [], scan._dark
    monkeypatch.setattr(scan, "_dark", lambda d: (seen.append(len(d)), dark(d))[1])
    again = scan.lines_of(np.frombuffer(A.encode() * 50, np.uint8), True, with_words=False)
    assert again.blank.sum() == 50 and sum(seen) == 100  # the first bytes of lines that are not empty


def test_fetched_opens_a_file_once(spark, tmp_path, monkeypatch):
    """a task that fetches many records opens the text and each file of entries once."""
    from alignloom.sources import index

    path, kept = tmp_path / "a.chain", str(tmp_path / "index")
    path.write_text("".join(A.replace("chain 5", f"chain {n}") for n in range(700)))
    index.write(chains.spans(spark, str(path), range_bytes=5000), kept)
    opened_at, real = spark.sparkContext.accumulator(0), index.text_stream

    def counting(place, stack):
        opened_at.add(1)
        return real(place, stack)

    monkeypatch.setattr(index, "text_stream", counting)
    got = {r["ordinal"]: bytes(r["record"]).decode() for r in index.fetched(spark.range(0, 900, 1, 1).withColumnRenamed("id", "ordinal"), kept, str(path)).collect()}
    assert got == {n: A.replace("chain 5", f"chain {n}") for n in range(700)}
    assert opened_at.value == 1 + len(index._footer(kept))
