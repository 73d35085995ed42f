"""Document fingerprints by winnowing: k-gram hashes, the minimum of each window, with positions.

Only DataFrame functions touch rows.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alignloom.llm.common import hidden

#: Tokens are runs of other characters than white space, cut after so many characters, so texts without spaces have tokens
#: too. A run's cuts count from its start: two runs longer than that match only where they are shared from their starts.
TOKEN_CHARS = 8
#: k-grams of K tokens; any run of K + WINDOW - 1 tokens that two texts share gives them a common fingerprint.
K, WINDOW = 3, 6
#: Fixed values of the rolling polynomial hash: a prime below 2**31 and a base below 2**30.
PRIME, BASE = 2_147_483_647, 911_382_323
#: Documents of a bucket on average, and the most buckets; beyond, buckets grow and their sorts spill.
BUCKET_DOCS, MOST_BUCKETS = 512, 65_536
#: Keys sampled for each range.
SAMPLED = 8


def selected(text: Column) -> Column:
    """array<bigint>: each selected k-gram once, by position: hash * 2**32 + (2**32 - 1 - position), position in tokens.

    The least such value of a window is the least hash at its rightmost place. Fewer
    than K tokens: the whole sequence is one k-gram; fewer than WINDOW k-grams: one
    window; no token: empty.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"\S{1,%d}" % TOKEN_CHARS), F.lit(0))
    hashed = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(PRIME)))
    return _let(_let(hashed, _grams), _windows)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(hashed: Column) -> Column:
    """The polynomial hash of each run of K token hashes, with its place; each value below PRIME, so no product exceeds a long."""
    n, k = F.size(hashed), F.least(F.size(hashed), F.lit(K))
    powers = [pow(BASE, K - 1 - j, PRIME) for j in range(K)]

    def gram(i):
        total = None
        for j, p in enumerate(powers):
            term = F.pmod(F.try_element_at(hashed, i + j) * F.lit(p), F.lit(PRIME))
            total = term if total is None else total + F.coalesce(term, F.lit(0))
        return F.shiftleft(F.pmod(total, F.lit(PRIME)), 32) + F.lit((1 << 32) - 1) - (i - 1).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), gram)).otherwise(F.array().cast("array<bigint>"))


def _windows(grams: Column) -> Column:
    n = F.size(grams)
    least = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.array_min(F.slice(grams, i, WINDOW)))
    return F.when(n > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda c: F.shiftright(c, 32)))


def spelled(chosen: Column) -> Column:
    """hash:position in hex of each selected k-gram, comma-joined."""
    return F.array_join(F.transform(chosen, lambda c: F.concat(F.hex(F.shiftright(c, 32)), F.lit(":"), F.hex(F.lit((1 << 32) - 1) - c.bitwiseAND(F.lit((1 << 32) - 1))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; 1 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def _edges(rows: DataFrame) -> list[tuple[tuple[bool, int, int], int]]:
    """Keys of rows that begin a range, ascending, and how many ranges each gets; the first is the least key of all.

    A sample of the keys, bounded by MOST_BUCKETS, sets the ranges' sizes only; what is
    computed does not depend on it. A key that many rows share gets several ranges.
    """
    total, least = rows.agg(F.count("*"), F.min("key")).first()
    if not total:
        return []
    n = min(MOST_BUCKETS, -(-total // BUCKET_DOCS))
    picked = rows.select("key").sample(min(1.0, SAMPLED * n / total), 1).collect() if n > 1 else []
    keys = sorted(tuple(r["key"]) for r in picked)[::SAMPLED]
    return sorted(Counter([tuple(least), *keys[1:]]).items())


def _bucketed(docs: DataFrame) -> DataFrame:
    """key, doc_id, body, h, __bucket, __late, __alike: rows dealt into ranges of descending doc_id and ascending h, null doc_ids last.

    The rows that begin a range also go to the range before it as its end (__late).
    Rows of one key are alike; where they take several ranges they are dealt at random,
    and what follows one of those that end a range but the last is its like (__alike).
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("body"))
    key = F.struct(F.col("doc_id").isNull().alias("unknown"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("rank"), F.xxhash64("body").alias("h"))
    rows = read.select("*", key.alias("key"))
    edges, base = [], 0
    for edge, times in _edges(rows):
        edges.append((edge, base, times))
        base += times
    kind = "array<struct<key:struct<unknown:boolean,rank:bigint,h:bigint>,base:int,times:int>>"
    array = F.from_json(F.lit(json.dumps([{"key": dict(zip(("unknown", "rank", "h"), k)), "base": b, "times": t} for k, b, t in edges])), kind)
    steps, step = [], 1
    while step <= len(edges):
        steps.insert(0, step)
        step *= 2

    def further(at, s):
        there = F.try_element_at(array, at + s)
        return F.when(there["key"] <= F.col("key"), at + s).otherwise(at)

    place = F.aggregate(F.lit(steps or [1]).cast("array<int>"), F.lit(0), further)
    found = rows.select("*", F.element_at(array, F.greatest(place, F.lit(1))).alias("e")) if edges else rows.select("*", F.lit(None).cast(kind[6:-1]).alias("e"))
    first = F.col("key") == F.col("e.key")
    part = F.when(first, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("e.times")).cast("int")).otherwise(F.col("e.times") - 1)
    dealt = found.select("*", first.alias("first"), part.alias("part"))
    before = F.when(F.col("e.base") == 0, F.lit(base - 1)).otherwise(F.col("e.base") - 1)
    at = lambda bucket, late: F.struct(bucket.alias("__bucket"), F.lit(late).alias("__late"))
    own = at(F.col("e.base") + F.col("part"), False)
    places = F.when(F.col("first") & (F.col("part") == 0), F.array(own, at(before, True))).otherwise(F.array(own))
    return dealt.select("key", "doc_id", "body", "key.h", (F.col("part") < F.col("e.times") - 1).alias("__alike"), F.inline(places))


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its edited text, and their likeness to each other and to the next document's.

    Edited: the last floor(n_chars / 3) code points are replaced by the first as many
    of the next document, in descending doc_id (rows of one doc_id by their texts'
    hash, null doc_ids last; after the last comes the first). Null texts count as
    empty; an empty text has an empty fingerprint. Rows are dealt by ranges of (doc_id,
    hash) in one shuffle of the texts, and each range is sorted; a doc_id or a row that
    very many repeat takes several ranges. A table of one row is its own next; an empty
    table gives no rows; other columns are not looked at, whatever their names.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    along = Window.partitionBy("__bucket").orderBy("__late", "key")
    follows = lambda column: F.coalesce(F.lead(column).over(along), F.when(F.col("__alike"), F.col(column)))
    rows = _bucketed(inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).withColumn("next", follows("body"))
    n, tail = F.length("body"), F.floor(F.length("body") / 3).cast("int")
    changed = F.concat(F.substring(F.col("body"), F.lit(1), n - tail), F.substring(F.coalesce("next", F.lit("")), F.lit(1), tail))
    printed = rows.select("__bucket", "__late", "__alike", "doc_id", "key", n.cast("long").alias("n_chars"), F.sha2(changed, 256).alias("edited_sha256"), selected(F.col("body")).alias("own"), selected(changed).alias("other"))
    beside = printed.withColumn("next", follows("own")).filter(~F.col("__late"))
    own = hashes(F.col("own"))
    return beside.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("other")).alias("edited_fingerprint"), likeness(own, hashes(F.col("other"))).alias("near_edited"), likeness(own, hashes(F.col("next"))).alias("near_next"))
