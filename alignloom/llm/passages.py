"""Repeated passages: paragraph MinHash banding, exact Jaccard, components of paragraphs.

Paragraphs are lines, compared for similarity, and windows of PASSAGE words, which may
begin anywhere and cross lines, compared for equality: those find passages inside
longer lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alignloom.llm.common import checkpointed, hidden, lent, released, written
from alignloom.llm.graph import connected_components
from alignloom.llm.tokens import blocks

SHINGLE, SIMILARITY = 5, 0.8
#: A passage has so many words.
PASSAGE = 50
#: Lines that are compared: one of PASSAGE words has 46 shingles, and what is similar to it 0.8 times as many, so 41 words.
LEAST_WORDS = 41
#: A window's anchor is the rightmost of least hash among its runs of GRAM words.
GRAM = 20
#: Bands of four rows: a pair at the threshold collides with probability 1 - (1 - 0.8**4)**12 = 0.998.
BANDS, ROWS = 12, 4
#: In crowded buckets, bands of eight rows: 1 - (1 - 0.8**8)**40 = 0.999; a pair at 0.5 meets with probability 0.14.
FINE_BANDS, FINE_ROWS = 40, 8
#: Buckets of so many paragraphs at most compare all pairs, which fetches two texts a pair; fine ones, of which a paragraph
#: has many, are few enough to do so at a smaller size.
CROWDED, FINE_CROWDED = 32, 4
#: Bits of the filter that sifts anchors: 32 MB.
SIEVE_BITS = 1 << 28
#: Up to so many paragraphs' names (8 bytes each) are broadcast to fetch their texts; beyond, the join shuffles.
BROADCAST_NAMES = 100_000

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_FOLDED = np.array([32 if _BLANK[b] else b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_BYTES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(22).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_BLOCK = 1 << 15

Units = Callable[[str | None], Iterator[tuple[int, int, str, list[bytes]]]]
_SEEDS = np.random.default_rng(20).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FINE_SEEDS = np.random.default_rng(24).integers(1, 1 << 63, (2, FINE_BANDS * FINE_ROWS), dtype=np.uint64)


def shingles(words: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    plain, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(plain)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    stops, digest = (starts + lengths)[SHINGLE - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(plain[a:b]) for a, b in zip(starts.tolist(), stops)], dtype=np.uint64))


def bands(hashes: np.ndarray, seeds: np.ndarray = _SEEDS, rows: int = ROWS) -> list[int]:
    """A signed 64-bit value for each band of the MinHash signature, the band's number included."""
    least = np.full(seeds.shape[1], np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            mixed = hashes[at : at + 4096, None] * (seeds[0] | np.uint64(1)) + seeds[1]
            least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(len(least) // rows)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def lines(text: str | None) -> Iterator[tuple[int, int, str, list[bytes]]]:
    """(paragraph number, its first code point, line, lower-cased words) of the lines that are long enough."""
    at = 0
    for number, line in enumerate((text or "").split("\n")):
        if len(line) >= 2 * LEAST_WORDS - 1:  # as many words as that need so many characters
            words = line.encode().lower().split()
            if len(words) >= LEAST_WORDS:
                yield number, at, line, words
        at += len(line) + 1


def named(words: list[bytes]) -> int:
    """A paragraph's name: a 64-bit hash of its words. Paragraphs of equal words are one class before any are compared."""
    return _named(b" ".join(words))


def _named(plain: bytes) -> int:
    return xxhash.xxh3_64_intdigest(plain) - (1 << 63)


def _word_hashes(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word of the folded bytes, in blocks of words."""
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), _BLOCK):
        at, sizes = starts[a : a + _BLOCK] - starts[a], lengths[a : a + _BLOCK] + 1
        part = folded[starts[a] : starts[a] + at[-1] + sizes[-1]]
        within = np.arange(len(part)) - np.repeat(at, sizes)[: len(part)]
        out[a : a + _BLOCK] = np.add.reduceat(_BYTES[part] * _PLACES[within & 63], at)
    return out


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of each run of `size` words, by doubling."""
    whole, length, known, width = None, 0, words, 1
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                part = known if whole is None else whole[: len(known) - length] * np.uint64(pow(_BASE, width, 1 << 64)) + known[length:]
                whole, length = part, length + width
            if 2 * width > size:
                break
            known = known[: len(known) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + known[width:]
            width *= 2
        whole = whole[: len(words) - size + 1]
        return (whole ^ (whole >> np.uint64(31))) * _MIX


def banded(plains: list[bytes]) -> list[list[int]]:
    """Of each paragraph (words with one blank between them, SHINGLE at least) its bands, as bands() makes them, by rolled hashes of its shingles.

    One vector for all. Equal shingles have equal hashes, so no band is lost; what
    meets is compared by shingles() anyway.
    """
    raw = np.frombuffer(b" ".join(plains) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = np.searchsorted(np.cumsum([len(p) + 1 for p in plains]), starts, "right")
    with np.errstate(over="ignore"):
        hashes = _rolled(_word_hashes(raw, starts, ends - starts), SHINGLE)
        inside = of[: len(hashes)] == of[SHINGLE - 1 :]  # shingles that lie in one paragraph
        hashes = hashes[inside]
        firsts = np.searchsorted(of[: len(inside)][inside], np.arange(len(plains)))
        least, mixed, part = np.empty((len(plains), BANDS, ROWS), dtype=np.uint64), np.empty_like(hashes), np.empty_like(hashes)
        for k in range(BANDS * ROWS):
            np.multiply(hashes, _SEEDS[0, k] | np.uint64(1), out=mixed)
            mixed += _SEEDS[1, k]
            np.right_shift(mixed, np.uint64(29), out=part)
            mixed ^= part
            mixed *= _MIX
            least[:, k // ROWS, k % ROWS] = np.minimum.reduceat(mixed, firsts)
        keys = (least * _PLACES[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)
        return ((keys ^ (keys >> np.uint64(31))) * _MIX).view(np.int64).tolist()


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Of each `width` consecutive values, the place of the least, the rightmost of equal ones."""
    found, low = [], np.uint64(0xFFFF)
    for a in range(0, len(hashes) - width + 1, _BLOCK):
        part = hashes[a : a + _BLOCK + width - 1]
        least, seen = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64)), 1
        while seen < width:
            step = min(seen, width - seen)
            least, seen = np.minimum(least[:-step], least[step:]), seen + step
        found.append(a + (low - (least & low)).astype(np.int64))
    return np.concatenate(found)


def windows(texts: list[str | None]) -> dict[str, np.ndarray] | None:
    """The windows of PASSAGE words of each text, by anchor; None if no text has one. One vector for all texts.

    Over anchors: owner (the text's number), word (of the first window, from 0), lead
    (its place relative to the anchor), id (the anchor's hash), counts (how many windows
    follow each other). Over windows: windows (32-bit hashes; windows are told apart by
    anchor's hash, place and this). Over words of texts that have windows: whose, begins
    and ends (code points). Words are those of lines(), counted through the text.
    """
    parts = [(t or "").encode() + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    bases = np.cumsum([0, *map(len, parts)])
    solid = ~_BLANK[raw]
    edges = np.diff(np.concatenate(([0], solid.view(np.int8))))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(begins)
    if n < PASSAGE:
        return None
    of = np.searchsorted(bases, begins, "right") - 1
    solid[ends] = True  # one blank after each word
    folded, lengths = _FOLDED[raw[solid]], ends - begins
    starts = np.flatnonzero(of[: n - PASSAGE + 1] == of[PASSAGE - 1 :])  # windows that lie in one text
    if not len(starts):
        return None
    with np.errstate(over="ignore"):
        words = _word_hashes(folded, np.cumsum(lengths + 1) - lengths - 1, lengths)
    grams = _rolled(words, GRAM)
    at, owner = _anchors(grams, PASSAGE - GRAM + 1)[starts], of[starts]
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    hashes = (_rolled(words, PASSAGE)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    heads = np.searchsorted(of, np.arange(len(texts)))  # each text's first word
    has = np.zeros(len(texts), dtype=bool)
    has[owner] = True
    listed = has[of]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    place = lambda at: (points[at] - points[bases[of]])[listed]
    return {
        "owner": owner[first], "word": starts[first] - heads[owner[first]], "lead": starts[first] - at[first], "id": grams[at[first]].view(np.int64), "counts": np.diff(np.append(first, len(at))),
        "windows": hashes, "whose": of[listed], "begins": place(begins), "ends": place(ends),
    }


def occurrences(docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, word, lead, start, stop, n_words, id, bands, windows, gaps, lengths) of docs (doc_id, text).

    Three kinds of rows: lines that are long enough (with bands); the anchors of windows
    (with windows: their hashes; id is the anchor's hash, word the first window's, lead
    its place relative to the anchor); and for each row with windows one with the code
    points of its words (lengths, and gaps before them).
    """
    long, number = pa.int64(), pa.int32()
    schema = pa.schema([("row", long), ("doc_id", long), ("paragraph", number), ("word", number), ("lead", number), ("start", long), ("stop", long), ("n_words", number), ("id", long), ("bands", pa.list_(long)), *[(c, pa.list_(number)) for c in ("windows", "gaps", "lengths")]])

    def batch_of(columns: dict) -> pa.RecordBatch:
        n = len(columns["row"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def listed(counts: list[int], values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), number), pa.array(values.astype(np.int32)))

    def anchored(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        owner, heads = pa.array(found["owner"]), np.searchsorted(found["whose"], found["owner"])
        low = heads + found["word"]
        return batch_of({
            "row": part.column(0).take(owner), "doc_id": part.column(1).take(owner), **{c: found[c] for c in ("word", "lead", "id")},
            "start": found["begins"][low], "stop": found["ends"][low + found["counts"] + PASSAGE - 2], "windows": listed(found["counts"], found["windows"]),
        })

    def placed(part: pa.RecordBatch, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        owners, counts = np.unique(found["whose"], return_counts=True)
        before = np.concatenate(([0], found["ends"][:-1]))
        before[np.cumsum(counts)[:-1]] = 0
        return batch_of({"row": part.column(0).take(pa.array(owners)), "gaps": listed(counts, found["begins"] - before), "lengths": listed(counts, found["ends"] - found["begins"])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out, missing = batch.slice(at, 128), [], {}
                rows, doc_ids, bodies = (c.to_pylist() for c in part.columns)
                if len(known) >= 20_000:
                    known.clear()
                for row, doc_id, text in zip(rows, doc_ids, bodies):
                    for number_of, start, line, words in lines(text):
                        plain = b" ".join(words)
                        name = _named(plain)
                        if name not in known:
                            missing[name] = plain
                        out.append((row, doc_id, number_of, start, start + len(line), len(words), name))
                if missing:
                    known.update(zip(missing, banded(list(missing.values()))))
                if out:
                    columns = dict(zip(("row", "doc_id", "paragraph", "start", "stop", "n_words", "id"), zip(*out)))
                    yield batch_of(columns | {"bands": [known[name] for name in columns["id"]]})
                for block in blocks(bodies, 500_000):
                    some = part.slice(block.start, len(block))
                    if (found := windows(bodies[block.start : block.stop])) is not None:
                        yield anchored(some, found)
                        yield placed(some, found)

    ddl = "row bigint, doc_id bigint, paragraph int, word int, lead int, start bigint, stop bigint, n_words int, id bigint, bands array<bigint>, windows array<int>, gaps array<int>, lengths array<int>"
    return docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def _of_texts(docs: DataFrame, names: DataFrame, units: Units, column: str, of: Callable[[list[bytes]], list[int]]) -> DataFrame:
    """(id, column) of the named paragraphs, each once: what `of` makes of their words."""
    schema = pa.schema([("id", pa.int64()), (column, pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [of(line.encode().lower().split()) for line in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], schema=schema)

    return texts(docs, names, units).mapInArrow(run, f"id bigint, {column} array<bigint>")


def sets(docs: DataFrame, names: DataFrame, units: Units) -> DataFrame:
    """(id, shingles) of the named paragraphs, each once: the distinct hashes of their shingles."""
    return _of_texts(docs, names, units, "shingles", lambda words: shingles(words).view(np.int64).tolist())


def fine(docs: DataFrame, names: DataFrame, units: Units) -> DataFrame:
    """(id, bands, times) of the named paragraphs: finer bands, for those that crowd."""
    return _of_texts(docs, names, units, "bands", lambda words: bands(shingles(words), _FINE_SEEDS, FINE_ROWS)).withColumn("times", F.lit(1))


def texts(docs: DataFrame, names: DataFrame, units: Units = lines) -> DataFrame:
    """(id, line) of the named paragraphs, each once."""
    schema = pa.schema([("id", pa.int64()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = {named(words): line for text in batch.column(0).slice(at, 256).to_pylist() for _, _, line, words in units(text)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], schema=schema)

    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    every = docs.select("text").mapInArrow(run, "id bigint, line string")
    return every.join(F.broadcast(names) if few else names, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line"))


def verified(pairs: DataFrame, docs: DataFrame, units: Units = lines) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of SIMILARITY or more."""
    pairs = checkpointed(pairs.distinct())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for a, b, line_a, line_b in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if len(sets) > 5_000:
                        sets.clear()
                    for k, line in ((a, line_a), (b, line_b)):
                        if k not in sets:
                            sets[k] = shingles(line.encode().lower().split())
                    x, y = sets[a], sets[b]
                    if min(len(x), len(y)) >= SIMILARITY * max(len(x), len(y)):
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        if 9 * shared >= 4 * (len(x) + len(y)):  # shared / union >= 4 / 5
                            out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        sets.clear()
        released()

    with lent(texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), units), "texts") as named_texts:
        first, second = (named_texts.select(F.col("id").alias(k), F.col("line").alias(f"line_{k}")) for k in "ab")
        both = pairs.join(first, "a").join(second, "b").select("a", "b", "line_a", "line_b")
        return checkpointed(both.mapInArrow(run, "a bigint, b bigint"))


def similar(distinct: DataFrame, docs: DataFrame, units: Units = lines, again: bool = False) -> DataFrame:
    """(node, label): the components of all colliding pairs that are similar, without single ones.

    distinct: (id, bands, times), each id once; units: what cuts a text into what is
    compared. A bucket of up to CROWDED paragraphs compares all pairs. In a larger one
    all first compare with the paragraph that occurs most times, as edited copies are
    near what they are copies of. What is in one component by then needs no further
    comparison with each other; where others are left, all of the bucket meet again
    by finer bands, which keep apart what is less alike. In a fine bucket (again) that
    still crowds, those outside its largest component are compared with members of
    other components, exactly, in the join itself: only links leave it. No pair within
    a component is compared or listed there.
    """
    rows = distinct.select("id", "times", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("times", "id"))["id"].alias("most")).filter("n > 1")
    most = min(CROWDED, FINE_CROWDED) if again else CROWDED
    with lent(rows.drop("times").join(buckets, "bucket"), "members") as members:
        calm, crowded = members.filter(F.col("n") <= most).select("bucket", "id"), members.filter(F.col("n") > most)
        pairs = calm.select("bucket", F.col("id").alias("a")).join(calm.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b").select("a", "b")
        edges = verified(pairs.unionAll(crowded.filter("id <> most").select(F.least("most", "id").alias("a"), F.greatest("most", "id").alias("b"))), docs, units)
        labels = checkpointed(connected_components(edges))
        if crowded.isEmpty():
            return labels
        placed = checkpointed(crowded.select("bucket", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label")))
    sizes = placed.groupBy("bucket", "label").count()
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("bucket", "main")
    open_rows = checkpointed(placed.join(main, "bucket"))
    if open_rows.isEmpty():
        return labels
    if not again:
        known = open_rows.select("id", "label").distinct()
        met = similar(checkpointed(fine(docs, known.select("id"), units)), docs, units, True)
        cross = met.join(known.toDF("node", "a"), "node").join(known.toDF("label", "b"), "label").select("a", "b")
    else:
        cross = _crossed(open_rows, checkpointed(sets(docs, open_rows.select("id").distinct(), units)))
    joined = checkpointed(connected_components(cross))  # of components, each named by its label
    renamed = joined.select(F.col("node").alias("label"), F.col("label").alias("final"))
    alone = joined.join(labels, "node", "left_anti")  # single paragraphs that are linked only now
    return labels.join(renamed, "label", "left").select("node", F.coalesce("final", "label").alias("label")).unionByName(alone)


def _crossed(members: DataFrame, shingled: DataFrame) -> DataFrame:
    """(a, b): labels of components that similar paragraphs of a bucket link; members: (bucket, id, label, main)."""
    carried = members.join(shingled, "id").withColumn("n", F.size("shingles"))
    a, b = (carried.select("bucket", "main", *[F.col(c).alias(f"{c}_{k}") for c in ("id", "label", "n", "shingles")]) for k in "ab")
    a, shared = a.filter("label_a <> main"), F.size(F.array_intersect("shingles_a", "shingles_b"))
    apart = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == b["main"]) | (F.col("id_a") < F.col("id_b")))
    close = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & (9 * shared >= 4 * (F.col("n_a") + F.col("n_b")))
    return a.drop("main").join(b, (a["bucket"] == b["bucket"]) & apart & close).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def repeated_lines(every: DataFrame, docs: DataFrame) -> DataFrame:
    """(row, doc_id, paragraph, start, stop, n_words, component, kept_doc_id, removed) of the lines that another row repeats or nearly repeats.

    Components without a line of PASSAGE words are left out.
    """
    distinct = every.groupBy("id").agg(F.first("bands").alias("bands"), F.count("*").alias("times"))
    labels = checkpointed(similar(distinct, docs))
    placed = every.drop("bands").join(labels.withColumnRenamed("node", "id").hint("shuffle_hash"), "id", "left").withColumn("component", F.coalesce("label", "id"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "paragraph")
    groups = placed.groupBy("component").agg(F.min(order).alias("kept"), F.min("row").alias("low"), F.max("row").alias("high"), F.max("n_words").alias("most")).filter((F.col("low") < F.col("high")) & (F.col("most") >= PASSAGE)).select("component", "kept")
    out = placed.join(groups.hint("shuffle_hash"), "component")
    return out.select("row", "doc_id", "paragraph", "start", "stop", "n_words", "component", F.col("kept.doc_id").alias("kept_doc_id"), ((F.col("row") != F.col("kept.row")) | (F.col("paragraph") != F.col("kept.paragraph"))).alias("removed"))


def _beside(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """hits with `inside` (2: in a removed line, 1: in a kept one, 0: in none) and `line`, the component of a kept line."""
    spans = listed.select("row", "start", "stop", "removed", F.col("component").alias("of"), F.lit(True).alias("of_line"))
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), F.desc("of_line"))
    line = F.max(F.when(F.col("of_line"), F.struct("stop", "removed", "start", "of"))).over(before)
    marked = hits.withColumn("of_line", F.lit(False)).unionByName(spans, allowMissingColumns=True).withColumn("line", line).filter("not of_line")
    inside = F.when(F.col("line.stop") >= F.col("stop"), F.when(F.col("line.removed"), 2).otherwise(1)).otherwise(0)
    return marked.withColumn("inside", inside).drop("of_line", "removed", "of").withColumn("line", F.when(F.col("inside") == 1, F.col("line.of")))


def _segments(placed: DataFrame) -> DataFrame:
    """(class, low, high, kept_row, kept_doc_id, kept_at, kept_line): which windows of a class of anchors repeat, and where each is kept.

    Anchors of one hash, place and windows are a class, whatever their number. The
    windows of an anchor's hash that has one class only repeat if the class does;
    those of others are looked at one by one. low, high: the first and last window
    that one kept place has.
    """
    occurrence = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row", "word", "line")).alias("kept")
    with lent(placed.groupBy("class", "id", "lead", "windows").agg(occurrence, F.min("inside").alias("least"), F.min("row").alias("low_row"), F.max("row").alias("high_row")), "passages-classes") as classes:
        counts = classes.groupBy("id").agg(F.count("*").alias("n"))
        counted = classes.join(counts, "id")
        place = lambda kept: [F.col(f"{kept}.row").alias("kept_row"), F.col(f"{kept}.doc_id").alias("kept_doc_id"), F.col(f"{kept}.line").alias("kept_line")]
        repeats = (F.col("low_row") < F.col("high_row")) & (F.col("least") == 0)
        single = counted.filter("n = 1").filter(repeats).select("class", F.lit(0).alias("low"), (F.size("windows") - 1).alias("high"), *place("kept"), (F.col("kept.word") - F.col("lead")).alias("kept_at"))
        each = counted.filter("n > 1").select("class", "id", "lead", "kept", "least", "low_row", "high_row", F.posexplode("windows").alias("i", "w"))
        at = F.struct("kept.unknown", "kept.doc_id", "kept.row", (F.col("kept.word") + F.col("i")).alias("word"), "kept.line")
        each = each.select("class", "id", (F.col("lead") + F.col("i")).alias("place"), "i", "w", at.alias("kept"), "least", "low_row", "high_row")
        kept = each.groupBy("id", "place", "w").agg(F.min("kept").alias("kept"), F.min("least").alias("least"), F.min("low_row").alias("low_row"), F.max("high_row").alias("high_row")).filter(repeats).select("id", "place", "w", "kept")
        several = each.select("class", "id", "place", "i", "w").join(kept, ["id", "place", "w"])
        several = several.select("class", "i", *place("kept"), (F.col("kept.word") - F.col("place")).alias("kept_at")).groupBy("class", "kept_row", "kept_doc_id", "kept_line", "kept_at").agg(F.min("i").alias("low"), F.max("i").alias("high"))
        return written(single.unionByName(several), "passages-segments")


@contextmanager
def sifted(names: DataFrame, n: int):
    """A join with names, n rows, made and run inside sifts its wide side by a Bloom filter of them before it is shuffled.

    That leaves the join's result as it is. The filter has ten bits a name, SIEVE_BITS at most.
    """
    conf, bloom, bits = names.sparkSession.conf, "spark.sql.optimizer.runtime.bloomFilter", min(max(10 * n, 1 << 16), SIEVE_BITS)
    sizes = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 50), "expectedNumItems": str(n), "maxNumItems": str(n), "numBits": str(bits), "maxNumBits": str(bits)}
    wanted = {f"{bloom}.{k}": v for k, v in sizes.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1"}  # what could be broadcast gets no filter
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def hits_of(every: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """The anchors whose hash is among the n names (id, low, high), those of two rows or more; sifted() where they are many."""
    known = names.filter("low < high").select("id")  # without a condition Spark makes no filter of them
    return every.join(F.broadcast(known) if n <= BROADCAST_NAMES else known.hint("shuffle_hash"), "id")


def repeated_windows(every: DataFrame, listed: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, edges): the same columns as repeated_lines for passages of repeated windows that lie in no listed line; paragraph is null.

    every: the anchors; points: (row, gaps, lengths) of the words. Of each window one
    occurrence is kept: the least among those in no listed line or in a kept one.
    Overlapping windows of a row whose kept occurrences are in one row are one passage.
    component names the passage alone; edges (a, b) link it to the kept passages and the
    components of kept lines that have its windows.
    """
    twice = every.groupBy("id").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high")
    with ExitStack() as held:
        with lent(twice, "passages-names") as names:
            n = names.count()
            with sifted(names, max(1, n)):
                placed = held.enter_context(lent(_beside(hits_of(every, names, n), listed).filter("inside < 2").withColumn("class", F.xxhash64("id", "lead", "windows")), "passages-placed"))
        segments = _segments(placed.select("class", "id", "lead", "windows", "row", "doc_id", "word", "inside", "line"))
        met = placed.filter("inside = 0").select("class", "row", "doc_id", "word", "lead").join(segments.hint("shuffle_hash"), "class")
        found = met.select(
            "row", "doc_id", "kept_row", "kept_doc_id", "kept_line", "kept_at", (F.col("word") - F.col("lead")).alias("own_at"), (F.col("word") + F.col("low")).alias("word"), (F.col("word") + F.col("high") + PASSAGE).alias("past"),
        )
        along = Window.partitionBy("row").orderBy("kept_row", "word", "past", "kept_at")
        here = Window.partitionBy("row", "kept_row").orderBy("word", "past", "kept_at")
        first = ~F.coalesce(F.col("word") < F.max("past").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        chained = found.withColumn("first", first).withColumn("passage", F.count(F.when(F.col("first"), 1)).over(along)).drop("first")
        chained = written(chained.withColumn("label", F.xxhash64("row", F.min("word").over(Window.partitionBy("row", "passage")))), "passages-chained")
    own = chained.filter("row = kept_row and own_at = kept_at").select(F.col("row").alias("kept_row"), "kept_at", F.col("label").alias("kept_label")).distinct()
    edges = chained.join(own.hint("shuffle_hash"), ["kept_row", "kept_at"], "left").select(F.col("label").alias("a"), F.coalesce("kept_line", "kept_label").alias("b"))
    whole = chained.groupBy("row", "passage").agg(
        F.first("doc_id").alias("doc_id"), F.min("word").alias("word"), F.max("past").alias("past"),
        F.first("label").alias("component"), F.first("kept_doc_id").alias("kept_doc_id"), F.first("kept_row").alias("kept_row"),
    )
    fields = ["doc_id", "word", "past", "component", "kept_doc_id", "kept_row"]
    by_row = whole.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("passages"))  # few of one row: at most its words
    spread = located(by_row.join(points, "row").select("row", "gaps", "lengths", "passages"))
    found = spread.select("row", "doc_id", F.lit(None).cast("int").alias("paragraph"), "start", "stop", (F.col("past") - F.col("word")).alias("n_words"), "component", "kept_doc_id", (F.col("row") != F.col("kept_row")).alias("removed"))
    return found, edges.filter("b is not null")


def located(rows: DataFrame) -> DataFrame:
    """Each of the passages of rows (row, gaps, lengths, passages) with start and stop, the code points of its words from word to past."""
    inside = rows.schema["passages"].dataType.elementType
    names = inside.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gaps, lengths, passages = batch.columns
            first = gaps.offsets.to_numpy()
            gap, length = (c.values.to_numpy()[: first[-1]].astype(np.int64) for c in (gaps, lengths))
            past = np.concatenate(([0], np.cumsum(gap + length)))  # code points before each word, from the batch's first
            held, of = passages.flatten(), np.repeat(np.arange(len(row)), np.diff(passages.offsets.to_numpy()))
            columns = dict(zip(names, held.flatten()))
            head, base = first[of], past[first[of]]
            low, high = (head + columns[c].to_numpy() for c in ("word", "past"))
            made = [row.take(pa.array(of)), *(columns[c] for c in names), pa.array(past[low] + gap[low] - base), pa.array(past[high] - base)]
            yield pa.RecordBatch.from_arrays(made, names=["row", *names, "start", "stop"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inside.fields)
    return rows.mapInArrow(run, f"row bigint, {fields}, start bigint, stop bigint")


def repeats(docs: DataFrame) -> DataFrame:
    """Every occurrence of a passage of PASSAGE words or more that another row of docs repeats, exactly or nearly.

    (doc_id, paragraph, start, stop, n_words, component, kept_doc_id, removed): lines
    whose shingles of five words are similar by 0.8 or more, in components of which
    one line has PASSAGE words, and (paragraph null) passages outside those lines that
    begin and end anywhere: all PASSAGE consecutive words (A-Z lower-cased) that two
    rows share lie in one or the other. start, stop: code points, stop exclusive. The
    occurrence of the least doc_id (null last), then row and place, is kept, all others
    are removed; component names what repeats one another, a passage and all those that
    have windows of it included. A passage repeated within one row only is not listed. Null and empty
    texts have no paragraphs, very long ones are read whole; repeated rows repeat each
    other; an empty table gives no rows; other columns are not looked at, whatever
    their names.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    docs = inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = written(occurrences(docs), "passages")
    of_lines = every.filter("paragraph is not null").select("row", "doc_id", "paragraph", "start", "stop", "n_words", "id", "bands")
    listed = checkpointed(repeated_lines(of_lines, docs))
    anchors = every.filter("word is not null").select("row", "doc_id", "word", "lead", "start", "stop", "id", "windows")
    points = every.filter("lengths is not null").select("row", "gaps", "lengths")
    inside, edges = repeated_windows(anchors, listed, points)
    linked = checkpointed(connected_components(edges)).withColumnRenamed("node", "component")
    both = listed.unionByName(inside).join(linked.hint("shuffle_hash"), "component", "left")
    return both.select("doc_id", "paragraph", "start", "stop", "n_words", F.coalesce("label", "component").alias("component"), "kept_doc_id", "removed")
