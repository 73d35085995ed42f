"""Benchmark decontamination: a prefix-filtered set join of item-sized windows.

Only DataFrame functions touch rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.functions.blocks import let
from alignloom.llm.common import ascii_lower, checkpointed, hidden

#: Fixed value of the contract: what separates words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a shingle.
SHINGLE = 3
#: Up to so many distinct shingles are inlined into the scan as a hash set; beyond, all shingles are joined.
INLINE_TOKENS = 100_000
#: Up to so many bytes of windows are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null: none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window, n): runs of `size` consecutive words, or all words of a shorter item; each once."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.least(n, F.lit(size))))).alias("window")).distinct().withColumn("n", F.size("window"))


def _few(tokens: DataFrame) -> list[int] | None:
    """The shingles' hashes, if they are few enough to be inlined."""
    found = [r[0] for r in tokens.limit(INLINE_TOKENS + 1).collect()]
    return found if len(found) <= INLINE_TOKENS else None


def shingle(w: Column, at: Column, size: int) -> Column:
    """The 64-bit hash of `size` words from place `at` (from 0) on."""
    return F.xxhash64(*[F.get(w, at + j) for j in range(size)])


def shingles(w: Column, sizes: list[int], few: list[int] | None) -> Column:
    """array<struct<token, at>> of the runs of each of the sizes in words w, their hashes and places; few: only these hashes."""
    def of(size):
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        found = F.transform(places, lambda i: F.struct(shingle(w, i, size).alias("token"), i.alias("at")))
        found = F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<struct<token:bigint,at:int>>"))
        return found if few is None else F.filter(found, lambda x: x["token"].isin(few))

    return F.concat(*[of(s) for s in sizes]) if sizes else F.array().cast("array<struct<token:bigint,at:int>>")


def prefixes(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(token, at, item_id, window, n): of each window the shingle that is rarest in all docs, and its first place.

    Shingles are runs of SHINGLE words, of a shorter window all its words. A window
    that must be contained whole has a prefix of one shingle in the order of rarity:
    where that shingle is not, the window is not.
    """
    found = windows(items, size).withColumn("s", F.least("n", F.lit(SHINGLE)))
    sizes = sorted(r[0] for r in found.select("s").distinct().collect())  # SHINGLE values at most
    own = F.coalesce(*[F.when(F.col("s") == k, shingles(F.col("window"), [k], None)) for k in sizes]) if sizes else shingles(F.col("window"), [], None)
    placed = found.select("*", F.inline(own))
    tokens = placed.select("token").distinct()
    few = _few(tokens)
    seen = docs.select(F.explode(let(words(F.col("text")), lambda w: F.transform(shingles(w, sizes, few), lambda x: x["token"]))).alias("token"))
    counts = seen.groupBy("token").count() if few is not None else seen.join(tokens, "token").groupBy("token").count()
    rarest = placed.join(counts, "token", "left").groupBy("item_id", "window", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "at")).alias("p"))
    return rarest.select("p.token", "p.at", "item_id", "window", "n")


def matches(docs: DataFrame, items: DataFrame, size: int = 10, keep: str = "doc_id") -> DataFrame:
    """Of every row of docs its column `keep`, n_words, hits (array<struct<start, stop>>, words) and item_ids (array<string>).

    docs: the columns `keep` and text are used. A document's places of prefix shingles,
    each with the words around it, are joined with the windows on the shingle's hash; a
    window must fit between the document's ends (position and length) and equal its
    words. Rows meet again by a row number, so repeated rows and null doc_ids each get
    a result. Null or empty texts have no words; long ones are read whole. Items of
    null id make hits but are not named.
    """
    inner, _, (item_id, item_text) = hidden(items, "item_id", "text")
    items = inner.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    known = checkpointed(prefixes(docs, items, size))
    few = _few(known.select("token").distinct())
    bound, sizes = known.agg(F.sum(F.octet_length(F.concat_ws(" ", "window")) + 64 + 24 * F.col("n")), F.collect_set(F.least("n", F.lit(SHINGLE)))).first()
    wide = size - 1
    base = docs.select(keep, words(F.col("text")).alias("w")).withColumn("__row", F.monotonically_increasing_id())
    places = F.transform(shingles(F.col("w"), sorted(sizes), few), lambda x: F.struct(
        x["token"].alias("token"), x["at"].alias("pos"), F.greatest(x["at"] - wide, F.lit(0)).alias("low"),
        F.slice("w", F.greatest(x["at"] - wide, F.lit(0)) + 1, F.least(x["at"], F.lit(wide)) + size).alias("around"),
    ))
    alone = F.xxhash64("__row")  # rows without a place meet no window, wherever they go
    spread = base.select("__row", keep, F.size("w").cast("long").alias("n_words"), F.explode_outer(places).alias("c")).select("__row", keep, "n_words", F.coalesce("c.token", alone).alias("token"), "c.pos", "c.low", "c.around")
    right = known.select("token", "at", F.struct(F.col("item_id").cast("string").alias("item_id")).alias("item"), "window", "n")
    right = F.broadcast(right) if (bound or 0) <= BROADCAST_BYTES else right
    start = F.col("pos") - F.col("at")
    fits = (start >= F.col("low")) & (start + F.col("n") <= F.col("n_words"))
    joined = spread.join(right, "token", "left")
    ok = F.when(F.col("n").isNotNull() & fits, F.slice("around", F.when(fits, start - F.col("low") + 1).otherwise(1), F.coalesce("n", F.lit(0))) == F.col("window")).otherwise(False)
    return joined.withColumn("__ok", ok).groupBy("__row", keep, "n_words").agg(
        F.collect_set(F.when(F.col("__ok"), F.struct(start.alias("start"), (start + F.col("n")).alias("stop")))).alias("hits"),
        F.collect_set(F.when(F.col("__ok"), F.col("item")["item_id"])).alias("item_ids"),
    ).drop("__row")


def covered(hits: Column) -> Column:
    """How many words lie in any hit."""
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def step(s, h):
        stop = F.greatest(h["stop"].cast("long"), s["end"])
        return F.struct(stop.alias("end"), (s["total"] + stop - F.greatest(h["start"].cast("long"), s["end"])).alias("total"))

    return F.aggregate(F.array_sort(hits), state, lambda s, h: F.when(h["stop"] > s["end"], step(s, h)).otherwise(s), lambda s: s["total"])


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs; an empty benchmark hits nothing.

    Null and empty texts have no words, repeated rows each get a row, an empty table
    gives none; other columns of docs are not looked at, whatever their names.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    found = matches(inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, size)
    ids = F.array_sort("item_ids")
    return found.select("doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs in which no window of an item occurs; columns keep names and values, whatever they are called.

    Null and empty texts hold no window and stay, as do all rows of texts without one,
    repeated ones too; an empty table stays empty.
    """
    inner, own, (text,) = hidden(docs, "text")
    keyed = inner.withColumn("__text", F.md5(F.coalesce(text, F.lit(""))))
    found = matches(keyed.select("__text", F.col(text).alias("text")), items, size, "__text").filter(F.size("hits") > 0).select("__text").distinct()
    return keyed.join(found, "__text", "left_anti").select(*own).toDF(*docs.columns)
