"""Faults of conversations and their cheapest repair, by weighted finite-state composition.

A conversation's rows are an input acceptor, a symbol a row; an edit transducer keeps,
reroles, deletes and inserts; an acceptor of role initials holds the grammar
(s?(ua)+)?. The three are composed as states are reached, and the shortest path is
found in topological order over weights (cost, labels), compared in that order. Weights
of consecutive pieces compose, so a conversation of any length is cut into blocks, each
with its weights from every grammar state to every other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm.common import hidden, released, written

#: Costs of the edits, and of a truncated row that stays.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: The grammar: states 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a); it accepts in 0 and 3.
GRAMMAR, FINAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: In a row: more inserts lead from any state back to one that fewer reach.
MOST_INSERTS = 2
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20

Weights = dict[int, tuple[int, str]]


def symbol(initial: str, must_go: bool, truncated: bool) -> str:
    """A row as the input acceptor has it: - (only deletion is left), else its role's initial (x: any other), a capital if truncated."""
    known = initial if initial in ("s", "u", "a") else "x"
    return "-" if must_go else known.upper() if truncated else known


def edits(read: str | None) -> list[tuple[str, str, int]]:
    """The edit transducer's arcs that read a symbol, or none: (label, initial written or '', cost)."""
    if read is None:
        return [("I", "u", INSERT), ("I", "a", INSERT)]
    if read == "-":
        return [("D", "", DELETE)]
    more = TRUNCATED if read.isupper() else 0
    return [("D", "", DELETE), ("K", read.lower(), more), ("R", "u", REROLE + more), ("R", "a", REROLE + more)]


_EDITS = {read: edits(read) for read in [None, *"-suaxSUAX"]}


def stepped(here: Weights, read: str | None) -> Weights:
    """The least weights of the composed states that arcs reading `read` lead to."""
    out: Weights = {}
    for state, (cost, labels) in here.items():
        for label, wrote, more in _EDITS[read]:
            to = GRAMMAR[state].get(wrote) if wrote else state
            if to is not None:
                weight = (cost + more, labels + label)
                if to not in out or weight < out[to]:
                    out[to] = weight
    return out


def inserted(here: Weights) -> Weights:
    """here and what insertions reach from it before the next row: the transducer counts them, so the states have an order."""
    out, layer = dict(here), here
    for _ in range(MOST_INSERTS):
        layer = stepped(layer, None)
        for state, weight in layer.items():
            if state not in out or weight < out[state]:
                out[state] = weight
    return out


@lru_cache(1 << 15)
def shortest(symbols: str, entry: int) -> Weights:
    """The least weight of each grammar state after the rows, from `entry` before them."""
    here: Weights = {entry: (0, "")}
    for read in symbols:
        here = stepped(inserted(here), read)
    return here


def accepted(here: Weights) -> tuple[int, str, int]:
    """(cost, labels, grammar state before the last insertions) of the least weight that ends in an accepting state."""
    found = [(*weight, state) for state, before in here.items() for to, weight in inserted({state: before}).items() if to in FINAL]
    return min(found)


def rendered(labels: str, rows: Iterator[tuple[str, str]], state: int) -> list[str]:
    """The lines `role:text` that the labels make of the rows, from a grammar state: what is written is always the one initial that fits."""
    out = []
    for label in labels:
        role, text = ("", "") if label == "I" else next(rows)
        if label == "D":
            continue
        initial = role[:1] if label == "K" else "a" if state == 2 else "u"
        out.append(f"{role if label == 'K' else ROLES[initial]}:{text}")
        state = GRAMMAR[state][initial]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after faults are planted by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops a row, 1 empties its text, 2 takes its [.!?], 3 repeats it, 4 makes its role user."""
    inner, _, (conv, turn, role, text) = hidden(conversations, "conv_id", "turn", "role", "text")
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(spelled(conv), F.lit(":"), spelled(turn)).cast("binary")) % 20
    rows = inner.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), case.alias("case")).filter("case <> 0")
    body = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


_COUNTS = ["n", "distinct", "blank", "duplicate", "truncated", "illegal"]
_SPACE = " \t\n\v\f\r"


def laid_out(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, first) in the order of conv_id and turn (null first), then role and MD5 of the text, through partitions by range.

    first marks the first row of a (conv_id, role, text). Which that is comes from
    digests alone, summed up before they are shuffled, as a mark that sorts right before
    its row; so texts are shuffled once, and neither a long conversation nor a row that
    is often repeated has to be in one partition.
    """
    inner, _, (conv, turn, role, text) = hidden(rows, "conv_id", "turn", "role", "text")
    spelled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    kept = written(inner.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), spelled(role).alias("role"), spelled(text).alias("text"), F.monotonically_increasing_id().alias("place")), "conversations")
    keyed = kept.withColumn("digest", F.md5("text"))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "place")).alias("f")
    marks = keyed.groupBy("conv_id", "role", "digest").agg(first).select("conv_id", "f.turn", "role", F.lit(None).cast("string").alias("text"), "f.place", "digest")
    order = ["conv_id", "turn", "role", "digest", "place"]
    return keyed.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").isNotNull()).select("conv_id", "turn", "role", "text")


def blocks(laid: DataFrame) -> DataFrame:
    """Blocks of conversations, in their order by (part, block); one that surely is a whole conversation comes repaired, the others with their rows and weights.

    A partition's first and last conversation may go on in the next one.
    """
    conv_type = laid.schema["conv_id"].dataType.simpleString()
    weight = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
    fields = [("part", pa.int32()), ("block", pa.int64()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in _COUNTS], *[(c, pa.int64()) for c in ("first_turn", "last_turn")], ("first_initial", pa.string()), ("last_initial", pa.string())]
    fields += [("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("weights", pa.list_(weight)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]

    def summed(part: int, number: int, rows: list[tuple]) -> dict:
        """A block of rows (turn, role, text, first)."""
        symbols, counts, before = [], dict.fromkeys(_COUNTS, 0), None
        for _, role, text, first in rows:
            end = text.rstrip(_SPACE)[-1:]
            cut = end not in (".", "!", "?")
            fault = "blank" if not end else "duplicate" if not first else "truncated" if cut else None
            if fault:
                counts[fault] += 1
            symbols.append(symbol(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            if before is not None:
                counts["illegal"] += before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
        turns = [t for t, *_ in rows if t is not None]
        counts |= {"n": len(rows), "distinct": len(set(turns))}
        ends = {"first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "first_initial": rows[0][1][:1], "last_initial": before}
        return {"part": part, "block": number, "symbols": "".join(symbols), **counts, **ends}

    def closed(block: dict, rows: list[tuple], whole: bool) -> dict:
        symbols = block.pop("symbols")
        if whole:
            cost, audit, _ = accepted(shortest(symbols, 0))
            lines = rendered(audit, ((r, t) for _, r, t, _ in rows), 0)
            return block | {"whole": True, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        weights = [{"entry": g, "exit": to, "cost": c, "labels": x} for g in range(len(GRAMMAR)) for to, (c, x) in shortest.__wrapped__(symbols, g).items()]
        return block | {"whole": False, "weights": weights, "roles": [r for _, r, _, _ in rows], "texts": [t for _, _, t, _ in rows]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, first, made, chars, out = None, False, 0, 0, []
        conv, rows, opened = object(), [], 0  # opened: conversations begun in this partition

        def flushed(whole: bool) -> None:
            nonlocal rows, made, chars
            if rows:
                out.append((conv, closed(summed(part, made, rows), rows, whole)))
            rows, made, chars = [], made + 1, 0

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([c for c, _ in out], schema.field(0).type)] + [pa.array([b.get(f.name) for _, b in out], f.type) for f in list(schema)[1:]]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        split = False  # the conversation has an earlier block here
        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(1).type), *fields])
            for part, now, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text is None:
                    first = True
                    continue
                if not opened or now != conv:
                    flushed(opened > 1 and not split)
                    conv, opened, split = now, opened + 1, False
                elif len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    flushed(False)
                    split = True
                rows.append((turn, role, text, first))
                first, chars = False, chars + len(text)
                if len(out) >= 2000 or out and not out[-1][1]["whole"]:
                    yield batch_of()
        flushed(False)
        if out:
            yield batch_of()
        released(tokenizers=False)

    longs = ", ".join(f"`{c}` bigint" for c in [*_COUNTS, "first_turn", "last_turn"])
    ddl = f"conv_id {conv_type}, part int, block bigint, whole boolean, {longs}, first_initial string, last_initial string, cost bigint, audit string, repaired_sha256 string, weights array<struct<entry:int,exit:int,cost:bigint,labels:string>>, roles array<string>, texts array<string>"
    return laid.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text").mapInArrow(run, ddl)


_FOUND = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def composed(parts: DataFrame) -> DataFrame:
    """Of conversations in blocks: a row with their counts, cost and audit (block null), and for each block its labels and the grammar state before it.

    Blocks of a conversation pass through one task in order, without their texts; what
    is held is a label a row for each of the four grammar states.
    """
    conv_type = parts.schema["conv_id"].dataType.simpleString()
    fields = [("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32()), ("labels", pa.string()), *[(c, pa.int64()) for c in _FOUND[1:7]], ("audit", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, conv, begun = None, None, False
        here, totals, last = {}, {}, None

        def ended() -> Iterator[pa.RecordBatch]:
            cost, audit, state = accepted({g: (c, x) for g, (c, x, _) in here.items()})
            path, pieces, tail = here[state][2], [], audit[len(here[state][1]) :]
            while path:
                path, (part, block, entry, labels) = path
                pieces.append({"part": part, "block": block, "entry": entry, "labels": labels + tail})
                tail = ""
            span = 0 if totals["first"] is None else last["last_turn"] - totals["first"] + 1 - totals["distinct"]
            row = {c: totals[c] for c in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": span, "cost": cost, "audit": audit}
            for at in range(0, len(pieces), 256):
                yield made(pieces[at : at + 256])
            yield made([row])

        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(rows), schema.field(0).type)] + [pa.array([r.get(f.name) for r in rows], f.type) for f in list(schema)[1:]], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field(0).type), *fields])
            for row in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                if not begun or row["conv_id"] != conv:
                    if begun:
                        yield from ended()
                    conv, begun, last = row["conv_id"], True, None
                    here, totals = {0: (0, "", None)}, dict.fromkeys(_COUNTS, 0) | {"first": None}
                for c in _COUNTS:
                    totals[c] += row[c]
                if last is not None:
                    totals["illegal"] += last["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
                    totals["distinct"] -= row["first_turn"] is not None and row["first_turn"] == last["last_turn"]
                    if row["last_turn"] is None:
                        row["last_turn"] = last["last_turn"]
                totals["first"] = row["first_turn"] if totals["first"] is None else totals["first"]
                there = {}
                for w in row["weights"]:
                    if w["entry"] in here:
                        cost, labels, path = here[w["entry"]]
                        weight = (cost + w["cost"], labels + w["labels"])
                        if w["exit"] not in there or weight < there[w["exit"]][:2]:
                            there[w["exit"]] = (*weight, (path, (row["part"], row["block"], w["entry"], w["labels"])))
                here, last = there, row
        if begun:
            yield from ended()

    ddl = f"conv_id {conv_type}, part int, block bigint, entry int, labels string, {', '.join(f'{c} bigint' for c in _FOUND[1:7])}, audit string"
    needed = ["conv_id", "part", "block", *_COUNTS, "first_turn", "last_turn", "first_initial", "last_initial", "weights"]
    return parts.select(needed).repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(run, ddl)


def digested(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired conversations in pieces (conv_id, part, block, labels, entry, roles, texts): the pieces of one pass through a task in order, as SHA-256 needs, one held at a time."""
    conv_type = pieces.schema["conv_id"].dataType.simpleString()

    def rendering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                body = "\n".join(rendered(r["labels"], zip(r["roles"], r["texts"]), r["entry"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"]], batch.schema.field(0).type), pa.array([r["part"]], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([body])], names=["conv_id", "part", "block", "body"])

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(batch.num_rows):
                one, body = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                if now is None or one != conv:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])
                    conv, now, any_yet = one, hashlib.sha256(), False
                if body:
                    now.update(b"\n" * any_yet + body.encode())
                    any_yet = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([now.hexdigest()])], names=["conv_id", "repaired_sha256"])

    lines = pieces.mapInArrow(rendering, f"conv_id {conv_type}, part int, block bigint, body string")
    order = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "body")
    return order.mapInArrow(hashing, f"conv_id {conv_type}, repaired_sha256 string")


def assess(rows: DataFrame) -> DataFrame:
    """For every conversation of rows (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, null first; those of one turn by role, then by MD5 of the
    text; a null role or text counts as one space, a null conv_id is a conversation of
    its own. A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated. audit: the labels of the cheapest edits (K R D I), the least string among
    equals; ties have one repair only. Repeated rows are duplicates; texts and
    conversations of any length are taken whole; an empty table gives no rows; other
    columns are not looked at, whatever their names.
    """
    found = written(blocks(laid_out(rows)), "conversation-blocks")
    parts = found.filter("not whole")
    paths = written(composed(parts), "conversation-paths")
    pieces = parts.select("part", "block", "roles", "texts").join(paths.filter("block is not null").select("conv_id", "part", "block", "entry", "labels"), ["part", "block"])
    hashes = digested(pieces.select("conv_id", "part", "block", "labels", "entry", "roles", "texts"))
    totals = paths.filter("block is null").alias("t")
    cut = totals.join(hashes.alias("h"), F.col("t.conv_id").eqNullSafe(F.col("h.conv_id"))).select(*[f"t.{c}" for c in _FOUND], "h.repaired_sha256")
    span = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")
    whole = found.filter("whole").select("conv_id", span, *_FOUND[2:], "repaired_sha256")
    return whole.unionByName(cut)
