"""Secret scanning: a trigram inverted index narrows each rule to candidate texts.

Only DataFrame functions touch rows; regexes are analysed on the driver.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.functions.blocks import let, running
from alignloom.llm.common import free_name, has_column, hidden

#: Fixed values. A finite set of strings larger than this is no longer followed when trigrams are derived.
MOST_STRINGS = 64
#: Code points of the pieces that masking cuts a text into.
CHUNK = 1024


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: valid in both Java and Python; group, least: a match counts if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds as the contract of the scan lists them. `hex` and `access` state their least length in the
#: pattern, which is the same: their matches are maximal runs.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of further credentials.
EXTRA = (
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |)PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A Boolean trigram query: True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def _join(kind: str, parts: list[Query]) -> Query:
    flat = list(dict.fromkeys(p for p in parts if p is not True))
    if kind == "or" and len(flat) < len(parts) or not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _of_strings(strings: set[str]) -> Query:
    """One of the strings occurs: of each, trigrams that cover it are asked for (every third and the last)."""
    covers = {frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), *([len(s) - 3] if len(s) > 2 else [])}) for s in strings}
    least = [c for c in covers if not any(other < c for other in covers)]  # A or (A and B) is A
    return _join("or", [_join("and", sorted(c)) for c in sorted(least, key=sorted)])


def _chars(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < MOST_STRINGS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """All strings that the nodes match, if they are few, and a query that every match fulfils."""
    known: set[str] = {""}
    exact, needs = True, []

    def cut():
        needs.append(_of_strings(known))
        known.clear()
        known.add("")

    for op, arg in nodes:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN:
            strings = _chars(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is sre.BRANCH:
            found = [_analyse(x) for x in arg[1]]
            query = _join("or", [q for _, q in found])
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            own, inner_query = _analyse(inner)
            if own is not None and low <= high <= 2:
                strings = {"".join(p) for n in range(low, high + 1) for p in product(own, repeat=n)}
            elif low:
                query = inner_query if own is None else _of_strings({"".join(p) for p in product(own, repeat=min(low, 3))})
        if strings is not None and len(known) * len(strings) <= MOST_STRINGS:
            whole = {a + b for a in known for b in strings}
            known.clear()
            known |= whole
        else:
            exact = False
            cut()
            needs.append(query if strings is None else _of_strings(strings))
    if exact:
        return set(known), _of_strings(known)
    cut()
    return None, _join("and", needs)


def trigram_query(pattern: str) -> Query:
    """The Boolean query over lower-case trigrams that the lower-cased form of any match fulfils; True: the pattern has no mandatory trigram."""
    return _analyse(sre_parser.parse(pattern))[1]


def _trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _holds(query: Query, postings: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(postings, query)
    parts = [_holds(q, postings) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def text_key(text: Column) -> Column:
    """What postings name a text by. Texts of equal keys share their candidacy, which verification makes good."""
    return F.xxhash64(text)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of column `text` for the named lower-case trigrams: rows (trigram, key), each once."""
    lower = texts.select(text_key(F.col("text")).alias("key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return lower.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): for each text that fulfils a query, the kinds it is a candidate for.

    Intersects the postings of a key; a key has as many as there are trigrams in the queries at most.
    """
    lists = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("held")), F.lit(k)) for k, q in queries.items()]))
    return lists.select("key", kinds.alias("kinds")).filter(F.size("kinds") > 0)


SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """SPANS in code points: leftmost non-overlapping matches that count.

    The pattern cuts the text into gaps; running sums of gaps' and matches' lengths
    give the places, so time is linear in the matches.
    """
    def placed(matches):
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
        steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("own")))
        return let(steps, lambda x: let(running(F.transform(x, lambda y: y["gap"] + y["own"])), lambda ahead: F.transform(x, lambda y, i: span(y, F.get(ahead, i), F.get(matches, i)))))

    def span(step, ahead, match):
        start = ahead + step["gap"]
        found = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + step["own"]).alias("stop"), F.lit(rule.kind).alias("kind"))
        return F.when(F.length(F.regexp_extract(match, rule.pattern, rule.group)) >= rule.least, found) if rule.least else found

    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), placed)
    return F.when(text.rlike(rule.pattern), (F.array_compact(found) if rule.least else found).cast(SPANS)).otherwise(F.array().cast(SPANS))


def _scanned(docs: DataFrame, text: str, kept: list[str], into: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The kept columns of docs, and SPANS of column `text` as column `into`; names are private ones."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    body = F.coalesce(F.col(text), F.lit(""))
    if queries:
        index = postings(docs.select(F.col(text).alias("text")).filter("text is not null"), sorted(set().union(*map(_trigrams, queries.values()))))
        found = candidates(index, queries).select(F.col("key").alias("__key"), F.col("kinds").alias("__kinds"))
        keyed = docs.select("*", text_key(F.col(text)).alias("__key"))
        joined = keyed.join(found.hint("shuffle_hash"), "__key", "left")
    else:
        joined = docs.select("*", F.lit(None).cast("array<string>").alias("__kinds"))
    each = []
    for rank, rule in enumerate(rules):
        spans = _spans(body, rule, rank)
        each.append(F.when(F.array_contains("__kinds", rule.kind), spans).otherwise(F.array().cast(SPANS)) if rule.kind in queries else spans)
    return joined.select(*kept, F.array_sort(F.concat(*each)).alias(into))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, into: str = "spans") -> DataFrame:
    """Every row of docs with SPANS of all secrets of its whole text, in a last column named `into`.

    Texts' trigrams that the rules ask for are indexed; a rule with mandatory trigrams
    runs only over the texts that its postings leave, one without over all texts.
    start, stop: code points, stop exclusive; sorted by start, then the rules' order.
    A null or empty text has no spans (an empty array); a very long one takes time
    linear in its length and matches. Repeated rows each get theirs; a text that a
    third of all rows share meets its candidates in a join that AQE splits. An empty
    table gives no rows. Columns of docs stay as they are, whatever their names; where
    one is named `into` already (in any case), the new one gets underscores after it.
    """
    inner, own, (text,) = hidden(docs, "text")
    return _scanned(inner, text, own, "__spans", rules).toDF(*docs.columns, free_name(docs, into))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _stretch(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop of a text cut into chunks of CHUNK, without walking through what is before."""
    first = F.floor(start / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, F.floor(stop / CHUNK).cast("int") - first + 1), "")
    return F.substring(part, (start - first * CHUNK + 1).cast("int"), (stop - start).cast("int"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, mask: str = "[SECRET]", length: str | None = None) -> DataFrame:
    """docs with each run of overlapping spans in `text` replaced by the mask; length: a column that gets the text's new length where the table has it.

    Columns keep order, names and values, whatever they are called. Null and empty
    texts stay as they are, repeated rows are each masked, an empty table stays empty;
    time is linear in a text's length and secrets.
    """
    inner, own, (text,) = hidden(docs, "text")
    marked, spans = _scanned(inner, text, own, "__spans", rules), F.col("__spans")
    reach = running(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
    pieces = lambda chunks, ends: F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(_stretch(chunks, F.get(ends, i), s["start"]), F.lit(mask))).otherwise(""))
    last = F.array_max(F.transform(spans, lambda s: s["stop"]))
    joined = let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0)), lambda chunks: let(reach, lambda ends: F.concat(F.array_join(pieces(chunks, ends), ""), _stretch(chunks, last, F.length(text).cast("long")))))
    clean = F.when(F.size(spans) > 0, joined).otherwise(F.col(text))
    out = marked.select(*[clean.alias(c) if c == text else F.col(c) for c in own])
    if length is not None and has_column(docs, length):
        place = own.index(hidden(docs, length)[2][0])
        kind = docs.schema[place].dataType
        out = out.select(*[F.length(text).cast(kind).alias(c) if i == place else F.col(c) for i, c in enumerate(own)])
    return out.toDF(*docs.columns)
