"""Conversation repair, exact duplicates and runs of words against brute-force versions, over awkward rows."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from alignloom.llm import conversations, exactdedup, periodic, queries

SPACE = " \t\n\v\f\r"


def brute_repair(rows):
    """Of sorted rows (turn, role, text): the result columns, by a search over all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    heap, done, final = [(0, "", 0, 0)], set(), None
    moves = {0: "su", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}
    while heap:
        cost, audit, i, g = heapq.heappop(heap)
        if i == len(rows) and g in (0, 3):
            final = cost, audit
            break
        if (i, g) in done:
            continue
        done.add((i, g))
        out = [(3, "I", 0, x) for x in moves[g] if x != "s"]
        if i < len(rows):
            out.append((4, "D", 1, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if rows[i][1][:1] and rows[i][1][:1] in moves[g]:
                    out.append((more, "K", 1, rows[i][1][:1]))
                out += [(3 + more, "R", 1, x) for x in moves[g] if x != "s"]
        for c, label, step, x in out:
            heapq.heappush(heap, (cost + c, audit + label, i + step, to[x] if x else g))
    lines, i, g = [], 0, 0
    for label in final[1]:
        role, text = ("", "") if label == "I" else rows[i][1:]
        i += label != "I"
        if label != "D":
            x = role[:1] if label == "K" else "a" if g == 2 else "u"
            lines.append(f"{role if label == 'K' else {'u': 'user', 'a': 'assistant'}[x]}:{text}")
            g = to[x]
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), final[0], final[1], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


CONVERSATION = "conv_id bigint, turn bigint, role string, text string, Text string, copy int, part int, first boolean"


def chat(seed, conv, n, turns=None):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"], ["hello.", "well", "  ", "", None, "so? \n", "ends!\t", " ", "no end\v"]
    return [(conv, rng.choice([None, *range(turns or n)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.randrange(n)}{rng.choice(['.', '', '!'])}") for _ in range(n)]


def full(rows):
    return [(*r, "x", 1, 2, True) for r in rows]


def want_of(rows):
    held = defaultdict(list)
    for c, t, r, x in rows:
        held[c].append((t, " " if r is None else r, " " if x is None else x))
    return sorted(repr((c, *brute_repair(in_order(rs)))) for c, rs in held.items())


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_conversation_repair(spark, monkeypatch, block_rows):
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block_rows)
    rows = [r for i in range(40) for r in chat(i, i if i else None, i % 9 + 1)] + chat(99, 77, 150) + chat(98, 78, 90, turns=1)
    rows += [(79, 1, "user", "same.")] * 30 + [(80, None, None, None)] * 3 + [(81, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(full(rows), CONVERSATION).repartition(4)
    assert sorted(repr(tuple(r)) for r in conversations.assess(df).collect()) == want_of(rows)
    assert conversations.assess(df.limit(0)).count() == 0


def test_conversation_repair_of_one_hot_conversation(spark, monkeypatch):
    """Without AQE, which would read small partitions as one."""
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 50)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = chat(5, 1, 900, turns=2000) + [r for i in range(2, 40) for r in chat(i, i, 5)]
    df = spark.createDataFrame(full(rows), CONVERSATION).repartition(6)
    assert sorted(repr(tuple(r)) for r in conversations.assess(df).collect()) == want_of(rows)
    found = conversations.blocks(conversations.laid_out(df))
    assert found.filter("conv_id = 1").count() >= 900 // 50 and found.filter("conv_id = 1").select("part").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("-suaxSUAX"), max_size=9), st.data())
def test_weights_of_pieces_compose(symbols, data):
    text, at = "".join(symbols), data.draw(st.integers(0, len(symbols)))
    whole, found = conversations.shortest(text, 0), {}
    for middle, (cost, labels) in conversations.shortest(text[:at], 0).items():
        for to, (more, rest) in conversations.shortest(text[at:], middle).items():
            found[to] = min(found.get(to, (10**9, "")), (cost + more, labels + rest))
    assert found == whole


def test_damage(spark, tmp_path):
    rows = [(c, t, r, x) for c in [None, *range(12)] for t, r, x in [(None, None, "a. b!"), (0, "user", None), (1, "assistant", "c?"), (2, "system", "d.")]]
    spark.createDataFrame(full(rows), CONVERSATION).toDF("conv_id", "turn", "role", "text", "TEXT2", "copy", "part", "first").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, r, x in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if case:
            damaged += [(c, t, "user" if case == 4 else r, "" if case == 1 else x.translate({ord(p): None for p in ".!?"}) if case == 2 else x)] * (2 if case == 3 else 1)
    got = conversations.damaged(spark.createDataFrame(full(rows), CONVERSATION))
    assert Counter(map(tuple, got.collect())) == Counter(damaged)
    want = {eval(w)[0]: w for w in want_of(damaged)}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert sorted(repr(tuple(r)) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()) == sorted(want.get(c, repr((c, *nothing))) for c in {r[0] for r in rows})


DOCS = "doc_id bigint, text string, Text string, digest string, keep int, n_runs int, runs string"
TEXTS = [None, "", " ", "a", "a", "é", "é", "é", "x" * 300_000, "x" * 300_000, "same"]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "other", "x", 1, 2, "own") for d, t in rows], DOCS)


def brute_groups(rows):
    held = defaultdict(list)
    for d, t in rows:
        held[t or ""].append(d)
    out = Counter()
    for text, ids in held.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        for k, d in enumerate(ids):
            out[(d, keep, len(ids), d == keep and keep not in ids[:k], hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_exact_dedup(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "SHARD_KEYS", 40)
    rows = [(i if i % 7 else None, t) for i, t in enumerate(TEXTS)] + [(5, "same")] * 20 + [(i, f"text {i % 90}") for i in range(300)]
    docs = docs_of(spark, rows).repartition(5)
    assert Counter(map(tuple, exactdedup.assess(docs).collect())) == brute_groups(rows)
    assert exactdedup.assess(docs.limit(0)).count() == 0
    kept = exactdedup.deduplicated(docs)
    assert kept.columns == docs.columns and Counter(tuple(r)[2:] for r in kept.collect()) == {("other", "x", 1, 2, "own"): len({t or "" for _, t in rows})}
    assert {r[0] for r in kept.collect() if r[1] == "same"} == {10}


def test_index_of_digests(spark, monkeypatch):
    """Rows come and go; shards split as the index grows."""
    monkeypatch.setattr(exactdedup, "SHARD_KEYS", 30)
    rng, index, live = random.Random(3), exactdedup.empty(spark), Counter()
    for turn in range(4):
        new = [(rng.choice([None, *range(40)]), f"t{rng.randrange(30 * (turn + 1))}") for _ in range(60)]
        before = index.bits
        index, decided = exactdedup.added(index, docs_of(spark, new))
        live.update(new)
        groups = defaultdict(list)
        for (d, t), n in live.items():
            groups[t] += [d] * n
        most = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in decided.collect()) == Counter((d, most[t], len(groups[t])) for d, t in new)
        gone = rng.sample(sorted(live.elements(), key=repr), 25) + [(999, "t1"), (1, "never")]
        index = exactdedup.removed(index, docs_of(spark, gone))
        live = +(live - Counter(gone))
        groups = defaultdict(list)
        for (d, t), n in live.items():
            groups[t] += [d] * n
        most = {t: max((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
        asked = [(i, f"t{i}") for i in range(130)]
        assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exactdedup.looked_up(index, docs_of(spark, asked)).collect()} == {(i, most.get(t), len(groups[t])) for i, t in asked}
        assert index.filters.count() == len(+Counter({t: len(g) for t, g in groups.items()})) and index.bits >= before
    assert index.bits > 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 400)), max_size=900))
def test_cuckoo_filter(steps):
    found, live = exactdedup.Cuckoo(2), {}
    for add, k in steps:
        key = (hashlib.sha256(b"%d" % k).digest(), k)
        place = found.find(key)
        assert (place >= 0) == (key in live) and (place < 0 or found.entries[place] == (*key, k))
        if add and place < 0:
            found.insert((*key, k))
            live[key] = k
        elif not add and place >= 0:
            found.delete(place)
            del live[key]
    assert found.live == len(live) and all(found.find(k) >= 0 for k in live)


def test_cuckoo_filter_verifies_and_grows():
    found = exactdedup.Cuckoo(1)
    like = [(bytes(8) + b"\x01\x01" + bytes(14) + bytes([i]) * 8, 1) for i in range(20)]  # one fingerprint and bucket for all
    for key in like[:4]:
        found.insert((*key, 0))
    assert found.find(like[9]) == -1 and found.false_hits == 4 and found.resized == 0
    for i in range(5000):
        found.insert((hashlib.sha256(b"%d" % i).digest(), 1, i))
    assert found.resized > 5 and all(found.find((hashlib.sha256(b"%d" % i).digest(), 1)) >= 0 for i in range(5000)) and found.live == 5004


def brute_runs(words, least=6, times=4):
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


words = st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abcd"), max_size=40)
repeated = st.tuples(words, st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9), words).map(lambda x: x[0] + x[1] * x[2] + x[3])


@settings(max_examples=400, deadline=None)
@given(st.lists(words | repeated, max_size=5), st.sampled_from([(6, 4), (1, 2), (2, 3)]))
def test_runs(texts, how):
    texts = [[w.encode() for w in t] for t in texts]
    assert periodic.runs_of_texts(texts, *how) == [brute_runs(t, *how) for t in texts]
    for t in texts:
        assert [(a, b - a, q) for a, b, q in periodic.runs(t, *how)] == brute_runs(t, *how)


@settings(max_examples=100, deadline=None)
@given(words | repeated)
def test_factors(s):
    at = 0
    for start, end, source in periodic.factors(s):
        assert start == at and (source < start and all(s[source + i] == s[start + i] for i in range(end - start)) if source >= 0 else s[start] not in s[:start])
        longer = s[start : end + 1]
        assert end == len(s) or source < 0 or not any(s[i : i + len(longer)] == longer for i in range(start))
        at = end
    assert at == len(s)


def brute_digest(text, found=None):
    ws = [w for w in (text or "").translate({ord(c): " " for c in SPACE}).split(" ") if w]
    rs = brute_runs(ws) if found is None else found
    best = max(rs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, n, q in rs for i in range(s + q, s + n)}
    return (len(rs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in rs).encode()).hexdigest(), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest())


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 400)
    rng = random.Random(8)
    texts = [None, "", " \n", "a " * 5, "a " * 6, "a b " * 9, "x\x1cy \x85 " * 8, "one two three " * 4 + "one", "ha " * 30_000, "É é\t" * 4 + "E"] + [" ".join(rng.choices("ab", k=60)) for _ in range(40)] + ["a a a a a a b b b b b b"] * 3
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    docs = docs_of(spark, rows)
    found = periodic.detect(docs)
    assert found.columns == [*docs.columns, "runs_", "collapsed"] and [tuple(r)[:7] for r in found.collect()] == [tuple(r) for r in docs.collect()]
    assert [len(r["collapsed"]) for r in found.filter("doc_id = 8").collect()] == [2]
    got = Counter(tuple(r) for r in queries.periodic_runs(docs.toDF("doc_id", "text", *"abcde").select("doc_id", "text")).collect())
    assert got == Counter((d, *brute_digest(t)) for d, t in rows) and periodic.detect(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.detect(docs, times=1)


def test_planted_runs(spark, tmp_path):
    texts = [None, "", "one", *(" ".join(random.Random(s).choices("abcdefghijklm", k=80 + s)) for s in range(120))]
    docs_of(spark, list(enumerate(texts)) + [(None, "x y")]).toDF("doc_id", "text", *"abcde").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, text in [*enumerate(texts), (None, "x y")]:
        ws = (text or "").split()
        h, n = 1 if d is None else zlib.crc32(str(d).encode()), len(ws)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        want[(d, *brute_digest(" ".join(ws)))] += 1
    assert Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()) == want
    assert sum(bool(w[1]) for w in want) > 5


def test_registered_exact_dedup(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs_of(spark, rows).toDF("doc_id", "text", *"abcde").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, queries.op12_exact_dedup(spark, str(tmp_path)).collect())) == brute_groups(rows)
