"""Chain text cut anywhere, spans, and what a header predicate leaves unread."""

import gzip
import io
import itertools
from collections import defaultdict

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

import plain_text
from alignloom.sources import chains, scan

A = "chain 100 c1 1000 + 10 60 q1 500 - 20 65 7\n20\t5\t0\n25\n\n"
B = "chain 200 c2 900 + 0 30 q2 400 + 5 35\n30\n\n"
TEXTS = [
    A + B + A, "#m\n\n" + A + "#n\n#o\n" + B + "\n \t\n" + A, (A + " " + B + "\t" + A), A + "garbage line\n" + A, A.rstrip("\n") + "\n#in a record\n\n" + B, (A + B).replace("\n", "\r\n"), "#only\n#notes",
    A.rstrip("\n"), A[:-1] + B, "\n\n\n" + A, A + "chain 1 c 9\n\n" + B, "  \n#x\n" + B + "#y", "", "\n", A + "20 5\n", "garbage\n" + A, A.replace("25\n\n", "25\n \r\n") + B,
]


def cut_items(data, step, window=None):
    """The items as ranges of so many bytes give them."""
    out = []
    for low in range(0, max(len(data), 1), step):
        raw = io.BytesIO(data)
        start, inside = chains.begins_inside(raw, low, window=4) if low else (0, False)
        raw.seek(start)
        out += plain(scan.parsed(raw, start, min(low + step, len(data)), inside, window=window))
    return out


def plain(batches):
    """Batches as the plain reader gives their items."""
    rows = [{k: v for k, v in r.items() if v is not None} for b in batches for r in b.to_pylist()]
    for r in rows:
        if "blocks" in r:
            r["blocks"] = [tuple(b.values()) for b in r["blocks"]]
        if "id" in r:
            r["id"] = int(r["id"])
    return rows


def plainly_read(data, start=0, **options):
    return [{k: v for k, v in r.items() if v is not None} for r in plain_text.items(plain_text.lines(io.BytesIO(data[start:]), start), **options)]


def until_fault(items):
    items = sorted(items, key=lambda i: i["offset"])
    fault = next((i for i in items if i["kind"] == "error"), None)
    return [i for i in items if i["kind"] != "error" and (fault is None or i["offset"] < fault["offset"])], fault


@pytest.mark.parametrize("text", TEXTS)
def test_every_cut_gives_what_the_whole_file_gives(text):
    data = text.encode()
    whole = until_fault(plainly_read(data))
    for step in range(1, len(data) + 2):
        found, fault = until_fault(cut_items(data, step, window=step % 40 + 1))
        assert fault == whole[1], step
        if fault is None:
            assert found == whole[0], step
        else:  # records that a fault cuts short began before it
            assert [i for i in whole[0] if i not in found] == [], step


def test_ranges_of_files(spark, tmp_path):
    texts = [t for t in TEXTS if until_fault(chains.parse_bytes(t.encode()))[1] is None and t]
    paths = []
    for i, t in enumerate(texts):
        path = tmp_path / f"{i}.chain{'.gz' if i % 3 == 2 else ''}"
        path.write_bytes(gzip.compress(t.encode()) if i % 3 == 2 else t.encode())
        paths.append(str(path))
    key = lambda r: (r["file_no"], r["offset"])
    want = [(i, x["kind"], x["offset"], x["length"]) for i, t in enumerate(texts) for x in plainly_read(t.encode())]
    for size in (19, 1 << 20):
        rows = sorted(chains.read_items(spark, paths, range_bytes=size).collect(), key=key)
        assert [(r["file_no"], r["kind"], r["offset"], r["length"]) for r in rows] == want
    able = [i for i, t in enumerate(texts) if not isinstance(scanned_plainly(t.encode(), True)[0], int)]  # indented headers are read, not scanned
    paths, texts = [paths[i] for i in able], [texts[i] for i in able]
    index = chains.spans(spark, paths, range_bytes=23).cache()
    records = [t.encode()[x["offset"] : x["offset"] + x["length"]] for t in texts for x in chains.parse_bytes(t.encode()) if x["kind"] == "chain"]
    assert [chains.chain_bytes(spark, paths, index, i) for i in (0, 3, len(records) - 1, len(records))] == [records[0], records[3], records[-1], None]


PARTS = st.sampled_from([
    A, B, "chain", "#x", " ", "\t", "\n", "\n\n", "\r\n", "+", "-", "1", "20", "4294967296", "18446744073709551616", "00000000000000000000012", "-9223372036854775808", "9223372036854775807", "é", "20 5\n", "20 5 0\n", "25\n", "#n\n",
    "chain 1 c 9 + 0 9 q 9 + 0 9 1\n", "chain -5 c 9 + 0 9 q 9 + 0 9\n9\n\n", " chain 5 é 9 + 0 9 q 9 + 0 9 3 z z\n9 1 1 7\n1\n\n", "\v", "\f",
])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join), st.integers(0, 200), st.integers(0, 200), st.integers(1, 60), st.booleans(), st.booleans(), st.sampled_from([None, 1, 7]), st.sampled_from([None, 0, 1, 2]))
def test_any_text_is_read_as_line_by_line(text, low, size, window, metadata, need_id, number, rest):
    data, options = text.encode(), {"metadata": metadata, "need_id": need_id}
    wanted = None if rest is None else lambda h: h["score"] % 3 != rest
    start, inside = chains.begins_inside(io.BytesIO(data), low, window=4) if low else (0, False)
    raw = io.BytesIO(data)
    raw.seek(start)
    got = plain(scan.parsed(raw, start, low + size, inside, scan.Options(**options, wanted=wanted), number, window))
    assert got == plainly_read(data, start, stop=low + size, inside=inside, wanted=wanted, number=number, **options)


def scanned_plainly(data, metadata):
    """(starts, lengths) of records, or (offset, message) of the first fault."""
    starts, lengths, inside = [], [], False
    for at, line, past in plain_text.lines(io.BytesIO(data), 0):
        blank = not plain_text.words(line)
        if inside:
            if line.startswith(b"#") or line.startswith(b"chain "):
                return at, "metadata line inside chain record" if line.startswith(b"#") else "missing blank line between chain records"
            lengths[-1] = past - starts[-1]
            inside = not blank
        elif line.startswith(b"chain "):
            starts.append(at)
            lengths.append(past - at)
            inside = True
        elif not blank and not line.startswith(b"#"):
            return at, "expected a chain header or metadata line"
        elif not blank and not metadata:
            return at, "metadata line"
    return starts, lengths


def composed(data, step, metadata, window):
    """The same from scans of ranges, composed."""
    state, starts = 0, []
    for low in range(0, max(len(data), 1), step):
        raw = io.BytesIO(data)
        at = chains.line_at(raw, low, 4) if low else 0
        raw.seek(at)
        found, *begun = scan.scanned(raw, at, min(low + step, len(data)), metadata, window)
        if found.fault[state]:
            return found.fault[state]
        assert found.starts[state] == len(begun[state]) and found.first[state] == next(iter(begun[state]), -1)
        starts += begun[state].tolist()
        state = found.after[state]
    return (starts,)


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=9).map("".join) | st.sampled_from(TEXTS), st.integers(1, 90), st.integers(1, 60), st.booleans())
def test_scans_of_ranges_compose(text, step, window, metadata):
    data = text.encode()
    want = scanned_plainly(data, metadata)
    assert composed(data, step, metadata, window) == (want if isinstance(want[0], int) else want[:1])


@pytest.mark.parametrize("text, message", [
    (A + B.rstrip("\n") + "\n" + A, "missing blank line between chain records at byte 95"), (A.rstrip("\n") + "\n#note\n\n" + B, "metadata line inside chain record at byte 53"),
    (A + " " + B, "expected a chain header or metadata line at byte 54"), ("chainless\n" + A, "expected a chain header or metadata line at byte 0"),
])
def test_broken_records_are_refused_at_every_cut(spark, tmp_path, text, message):
    path = tmp_path / "broken.chain"
    path.write_text(text)
    for size in (3, 20, 64, 1000):
        with pytest.raises(ValueError, match=message):
            chains.spans(spark, str(path), range_bytes=size)


def test_spans_know_their_neighbours(spark, tmp_path):
    texts = ["#m\n\n" + A + "#n\n" + B + "\n#o\n" + A + "#end", "", A, "\n#only\n", B * 3]
    paths = []
    for i, t in enumerate(texts):
        paths.append(str(tmp_path / f"{i}.chain"))
        (tmp_path / f"{i}.chain").write_text(t)
    for size in (7, 33, 1000):
        rows = [tuple(r) for r in chains.spans(spark, paths, range_bytes=size).collect()]
        assert [r[3] for r in rows] == list(range(7))
        again = defaultdict(str)
        for file_no, offset, length, _, start, reach in rows:
            want = scanned_plainly(texts[file_no].encode(), True)
            assert (offset, length) in list(zip(*want))
            again[file_no] += texts[file_no][start:] if reach is None else texts[file_no][start : start + reach]
        assert all(again[i] == texts[i] for i in again)


def test_unwanted_headers_leave_their_blocks_unread():
    text = A + "chain 5 c2 900 + 0 30 q2 400 + 5 35 9\nnot a block\n\n" + B
    assert [i["kind"] for i in chains.parse_bytes(text.encode())] == ["chain", "error"]
    found = plain(scan.parsed(io.BytesIO(text.encode()), 0, options=scan.Options(wanted=lambda h: h["score"] >= 100)))
    assert [(i["kind"], i.get("blocks")) for i in found] == [("chain", [(20, 5, 0), (25, 0, 0)]), ("chain", None), ("chain", [(30, 0, 0)])]
    assert list(itertools.accumulate(i["length"] for i in found))[-1] == len(text)


def test_header_predicate_of_the_reader_is_the_filters(spark):
    import random

    from pyspark.sql import functions as F

    from alignloom.operators import filters

    rng, rows = random.Random(3), []
    for i in range(300):
        at = rng.randrange(1000)
        rows.append((rng.randint(-50, 300), rng.choice(["c1", "c2_random", "c3_alt"]), rng.choice(["q1", "q2", "q_hap1"]), rng.choice("+-"), at, at + rng.randint(1, 300), at // 2, at // 2 + rng.randint(1, 300), i + 1))
    df = spark.createDataFrame(rows, "score bigint, r_name string, q_name string, q_strand string, r_start bigint, r_end bigint, q_start bigint, q_end bigint, id bigint")
    specs = [
        {"min_score": 0}, {"min_score": 60, "max_score": 200}, {"max_score": 10}, {"query_names": "q1,q2"}, {"query_names": ""}, {"exclude_target_names": "c1"}, {"min_query_start": 100, "max_query_start": 300},
        {"min_target_end": 300, "max_target_end": 900}, {"query_overlap_start": 100, "query_overlap_end": 400}, {"target_overlap_start": 500}, {"min_query_span": 50, "max_query_span": 120}, {"max_target_span": 80},
        {"query_strand": "-"}, {"query_strand": ""}, {"exclude_random": True}, {"exclude_haplotype": True},
    ]
    for s in specs:
        spec = filters.FilterSpec(**s)
        reads = filters.reads_blocks(spec)
        kept = {r["id"] for r in df.filter(filters._all([*filters.header_predicates(spec), F.lit(True)])).collect()}
        table = df.toArrow()
        headers = {c: table[c].combine_chunks() if "name" in c or "strand" in c else table[c].to_numpy() for c in table.column_names}
        assert kept == set(headers["id"][reads(headers)].tolist()), s


def test_pieces_cut_at_chunks(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from alignloom.operators import scoring
    from alignloom.sources import sequences

    monkeypatch.setattr(scoring, "CHUNK", 16)
    monkeypatch.setattr(sequences, "CHUNK", 16)
    rng = random.Random(8)
    bases = {n: "".join(rng.choices("ACGTacgtN", k=400)) for n in ("t", "q")}
    rows = []
    for i in range(40):
        blocks, r, q = [], rng.randrange(100), rng.randrange(100)
        r0, q0 = r, q
        for b in range(rng.randint(1, 5)):
            n, dt, dq = rng.randint(1, 60), rng.randint(0, 9), rng.randint(0, 9)
            if max(r, q) + n + 9 > 400:
                break
            blocks.append([n, dt, dq])
            r, q = r + n + dt, q + n + dq
        if blocks:
            r, q = r - blocks[-1][1], q - blocks[-1][2]
            blocks[-1][1:] = [0, 0]
            rows.append((0, i, "t", r0, r, "q", 400, rng.choice("+-"), q0, q, [tuple(b) for b in blocks]))
    df = spark.createDataFrame(rows, "file_no int, offset bigint, r_name string, r_start bigint, r_end bigint, q_name string, q_size bigint, q_strand string, q_start bigint, q_end bigint, blocks array<struct<size:bigint,gap_reference:bigint,gap_query:bigint>>")
    held = spark.createDataFrame([(s, n, i // 16, bases[n][i : i + 16]) for s, n in (("reference", "t"), ("query", "q")) for i in range(0, 400, 16)], "side string, name string, bin bigint, seq string")
    got = {r["offset"]: r["counts"] for r in scoring.counted(df, held).collect()}
    flip = bases["q"][::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    for _, i, _, r, _, _, _, strand, q, _, blocks in rows:
        pairs = []
        for n, dt, dq in blocks:
            pairs += zip(bases["t"][r : r + n], (flip if strand == "-" else bases["q"])[q : q + n])
            r, q = r + n + dt, q + n + dq
        same = [x.upper() for x, y in pairs if x.upper() == y.upper()]
        assert [got[i][k] for k in ("a", "c", "g", "t", "n", "repeats", "total")] == [*(same.count(b) for b in "ACGTN"), sum(x in "acgtn" or y in "acgtn" for x, y in pairs), len(pairs)], i
    assert scoring.pieces(df).agg(F.max("size")).first()[0] <= 16
    with pytest.raises(Exception, match="missing sequence"):
        scoring.counted(df, held.filter("bin <> 5")).collect()


FASTA = st.lists(st.sampled_from([">a b\n", ">c\n", ">long_name with words\r\n", ">d", "ACGT\n", "acgtn\r\n", "ACG", "\n", " A C\tG\n", "T" * 40, ">e\n>f\n", "\x0b"]), min_size=1, max_size=14).map(lambda x: ">first\n" + "".join(x))


@settings(max_examples=400, deadline=None)
@given(FASTA, st.integers(1, 40), st.integers(1, 9))
def test_fasta_ranges_give_what_the_stream_gives(text, step, chunk):
    from alignloom.sources import fasta, sequences

    data, state, got = text.encode("latin-1"), fasta.State(), {}
    try:
        before, sequences.CHUNK = sequences.CHUNK, chunk
        want = {(r, n, b): s for r, n, b, s in sequences.from_fasta(io.BytesIO(data))}
    except ValueError:
        want = None
    finally:
        sequences.CHUNK = before
    try:
        for low in range(0, len(data), step):
            high = min(low + step, len(data))
            for record, name, number, at, seq, whole in fasta.pieces(io.BytesIO(data), low, high, state, high == len(data), chunk):
                key = (record, name, number)
                assert at == len(got.get(key, "")) and not (whole and key in got)
                got[key] = got.get(key, "") + seq
            state = state.past(fasta.part_of(io.BytesIO(data), low, high))
    except ValueError:
        got = None
    assert got == want


def test_fasta_files_by_ranges(spark, tmp_path):
    import random

    from alignloom.sources import sequences

    rng = random.Random(4)
    held = {f"s{i}": "".join(rng.choices("ACGTacgtN", k=n)) for i, n in enumerate((0, 5, 70_000, 140_000, 65_536, 1))}
    (tmp_path / "a.fa").write_text("".join(f">{n} x\n" + "".join(s[i : i + 61] + "\n" for i in range(0, len(s), 61)) for n, s in held.items()))
    (tmp_path / "b.fa").write_text(">s1 again\nGGGG\n>one\n" + "ACGT" * 30_000)
    held |= {"s1": "GGGG", "one": "ACGT" * 30_000}
    for size in (7_000, 100_000, None):
        rows = sequences.load(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], "query", range_bytes=size).orderBy("name", "bin").collect()
        assert all(len(r["seq"]) <= 65_536 for r in rows)
        assert {n: "".join(r["seq"] for r in rows if r["name"] == n) for n in held} == held
    (tmp_path / "c.fa").write_text(">a\nAC\n> \nGT\n")
    with pytest.raises(Exception, match="without a name"):
        sequences.load(spark, str(tmp_path / "c.fa"), "query", range_bytes=4).collect()


def test_texts_of_a_column(spark):
    texts = [None, *TEXTS] * 9 + [A.rstrip("\n")] * 70 + ["#m", A + "#n", "\n"] * 30
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, body string").repartition(3)
    got = defaultdict(list)
    for r in chains.of_texts(rows, "id", "body").collect():
        got[r["of"]].append({k: v for k, v in r.asDict(recursive=True).items() if v is not None and k != "of"})
    for i, t in enumerate(texts):
        for r in got[i]:
            r |= ({"blocks": [tuple(b.values()) for b in r["blocks"]]} if "blocks" in r else {}) | ({"id": int(r["id"])} if "id" in r else {})
        assert sorted(got[i], key=lambda r: r["offset"]) == plainly_read((t or "").encode()), i


def test_kept_index(spark, tmp_path):
    from alignloom.sources import index

    texts, paths = [A * 5 + B, B, "#m\n" + A + B * 7], []
    for i, t in enumerate(texts):
        paths.append(str(tmp_path / f"{i}.chain"))
        (tmp_path / f"{i}.chain").write_text(t)
    folder = str(tmp_path / "index")
    index.write(chains.spans(spark, paths, range_bytes=60), folder)
    records = [t[x["offset"] : x["offset"] + x["length"]].encode() for t in texts for x in plainly_read(t.encode()) if x["kind"] == "chain"]
    assert index.size(folder) == len(records) == 15
    assert [index.chain_bytes(folder, paths, i) for i in (0, 6, 14, 15)] == [records[0], records[6], records[14], None]
    wanted = spark.createDataFrame([(i,) for i in (3, 14, 7, 99, 3)], "ordinal bigint")
    assert sorted((r["ordinal"], bytes(r["record"])) for r in index.fetched(wanted, folder, paths).collect()) == sorted((i, records[i]) for i in (3, 14, 7, 3))
    assert [(r["ordinal"], bytes(r["record"])) for r in chains.raw(spark, paths, range_bytes=70).orderBy("ordinal").collect()] == list(enumerate(records))


def test_data_source_pushes_filters(spark, tmp_path, capsys):
    from alignloom.sources import datasource

    datasource.register(spark)
    broken = B.replace("30\n\n", "not a block\n\n")
    for i, text in enumerate(("#m\n" + A + broken + A.replace("100 c1", "-7 c9_x", 1), A.replace("100 c1", "300 c2", 1) + broken)):
        (tmp_path / f"{i}.chain").write_text(text)
    rows = spark.read.format("chain").option("range_bytes", 40).load(str(tmp_path))
    kept = rows.filter("score < 200 and r_name like 'c%'")
    assert sorted(r["score"] for r in kept.collect()) == [-7, 100]  # the blocks of others are not looked at
    kept.explain("formatted")
    plan = capsys.readouterr().out
    assert "LessThan(score,200)" in plan and "StringStartsWith(r_name,c)" in plan and "Filter" not in plan.split("\n\n")[0]
    with pytest.raises(Exception, match="block value is not a number"):
        rows.filter("score > 150").collect()
    cases = {"id = 7": 3, "id is null": 2, "id <=> 7": 3, "id > 7": 0, "r_name in ('c1', 'c2')": 4, "r_name not in ('c1')": 4, "r_name rlike 'x$'": 1, "q_strand = '-'": 3, "not (score >= 200)": 2, "r_start between 1 and 10": 3, "r_name like '%_x'": 1, "id is not null and score = 300": 1}
    heads = lambda pushdown="true": spark.read.format("chain").option("pushdown", pushdown).schema("score bigint, r_name string, q_strand string, r_start bigint, id decimal(20,0)").load([str(tmp_path / "0.chain"), str(tmp_path / "1.chain")])
    assert {c: heads().filter(c).count() for c in cases} == cases and heads().count() == 5
    again = heads("false")
    assert [again.filter("score = 300").count(), again.count(), again.filter("id = 7").count()] == [1, 5, 3]
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("chain").schema("scores bigint").load(str(tmp_path)).collect()


def test_gzip_in_blocks(spark, tmp_path, monkeypatch):
    from alignloom.operators import files
    from alignloom.sources import blocked

    monkeypatch.setattr(blocked, "BLOCK", 97)
    monkeypatch.setattr(blocked, "STEP", 300)
    monkeypatch.setattr(blocked, "LISTED", 500)
    text = ("#m\n" + A + B * 3 + "#n\n") * 60
    (tmp_path / "plain.chain").write_text(text)
    rows = files.merge_files(spark, [str(tmp_path / "plain.chain")], str(tmp_path / "packed"), gzipped=True).collect()
    packed = str(tmp_path / "packed" / rows[0]["name"])
    assert gzip.open(packed).read().decode() == text
    spans = chains.ranges_of(packed, 1000)
    assert len(spans) == -(-len(text) // 1000) and len(spans[0][2].offsets) > 10
    key = lambda r: r["offset"]
    for size in (170, 1000, 1 << 20):
        want = sorted(chains.read(spark, str(tmp_path / "plain.chain"), range_bytes=size).collect(), key=key)
        assert sorted(chains.read(spark, packed, range_bytes=size).collect(), key=key) == want
        assert [tuple(r) for r in chains.spans(spark, packed, range_bytes=size).collect()] == [tuple(r) for r in chains.spans(spark, str(tmp_path / "plain.chain"), range_bytes=size).collect()]
    data = bytearray(open(packed, "rb").read())
    data[len(data) // 2] ^= 0xFF
    (tmp_path / "bad.chain.gz").write_bytes(data + b"\0" * 3)
    with pytest.raises(Exception):
        chains.read(spark, str(tmp_path / "bad.chain.gz"), range_bytes=400).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=400), max_size=8), st.integers(1, 200), st.integers(1, 300))
def test_blocks_can_be_entered_anywhere(parts, low, n):
    from alignloom.sources import blocked

    out = io.BytesIO()
    out.close = lambda: None
    before, blocked.BLOCK = blocked.BLOCK, 64
    writer = blocked.Writer(out)
    for p in parts:
        writer.write(p)
    writer.close()
    blocked.BLOCK = before
    data, text = out.getvalue(), b"".join(parts)
    assert gzip.decompress(data) == text
    listed = [m for a in range(0, len(data), 100) for m in blocked.members(io.BytesIO(data), a, min(a + 100, len(data)))]
    assert sum(k for _, k in listed) == len(text) and listed[0][0] == 0
    offsets = tuple(sum(k for _, k in listed[:i]) for i in range(len(listed)))
    reader = blocked.Reader(io.BytesIO(data), blocked.Index(offsets, tuple(p for p, _ in listed), len(text)))
    reader.seek(low)
    assert reader.read(n) == text[low : low + n] and reader.read() == text[low + n :]


def test_only_needed_chunks_are_read(spark, tmp_path, monkeypatch):
    import random

    from alignloom.sources import sequences

    monkeypatch.setattr(sequences, "CHUNK", 64)
    monkeypatch.setattr(sequences, "STRETCH", 3)
    rng = random.Random(5)
    held = {f"s{i}": "".join(rng.choices("ACGTacgtNn", k=n)) for i, n in enumerate((0, 5, 64, 1000, 4001))}
    (tmp_path / "a.2bit").write_bytes(sequences.to_twobit(held))
    (tmp_path / "b.fa").write_text("".join(f">{n}\n{s}\n" for n, s in held.items()))
    wanted = [("s3", 0), ("s3", 15), ("s3", 16), ("s4", 7), ("s4", 62), ("s4", 7), ("s1", 0), ("s0", 0), ("none", 0)]
    needed = spark.createDataFrame(wanted, "name string, bin bigint")
    want = sorted((n, b, held[n][64 * b : 64 * b + 64]) for n, b in set(wanted) if n in held and 64 * b < max(len(held[n]), 1))
    for path in ("a.2bit", "b.fa"):
        rows = sequences.load_bins(spark, str(tmp_path / path), "query", needed).collect()
        assert sorted((r["name"], r["bin"], r["seq"]) for r in rows) == want

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

    data = sequences.to_twobit({"x": "ACGT" * 100_000})
    stream = Counted(data)
    _, [(_, offset)] = sequences.twobit_index(stream)
    assert [k for k, _ in sequences.from_twobit(stream, "<", offset, [3, 900])] == [3, 900] and stream.taken < 200 and len(data) > 100_000
