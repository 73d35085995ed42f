"""Exact duplicates by an index of live digests: cuckoo filters, sharded by digest, over the keys bucketed with them.

The index holds each different text once, by SHA-256 and length. A filter's slot has a
16-bit fingerprint; the key it stands for is stored in the same bucket, so a hit is
verified there, a digest that lives no longer is deleted, and a filter that overflows
is built anew, twice as large, from the stored keys.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alignloom.llm.common import hidden, written

#: Live digests of a shard on average, at most; slots of a bucket; moves before a filter counts as full.
SHARD_KEYS, SLOTS, KICKS = 20_000, 4, 500
#: A digest of more than one in so many rows is met by broadcast: there are fewer than that of them.
HOT = 1000

_KEEP = "struct<known:boolean,doc_id:bigint,batch:bigint,row:bigint>"
_MEMBERS = "digest binary, size bigint, doc_id bigint, copies bigint, first struct<batch:bigint,row:bigint>"
_ENTRY = "digest binary, size bigint, known boolean, doc_id bigint, batch bigint, row bigint, rows bigint"
_FILTERS = f"shard bigint, buckets bigint, place bigint, print int, {_ENTRY}"


class Cuckoo:
    """A cuckoo filter with its keys: entries are tuples whose first two fields (digest, length of the text) are the key."""

    def __init__(self, buckets: int = 64):
        self.buckets, self.live, self.false_hits, self.resized = buckets, 0, 0, 0
        self.prints, self.entries = array("H", bytes(2 * SLOTS * buckets)), [None] * (SLOTS * buckets)

    def _home(self, digest: bytes) -> tuple[int, int]:
        """A digest's fingerprint (not 0) and first bucket."""
        return int.from_bytes(digest[8:10]) or 1, int.from_bytes(digest[10:18]) & (self.buckets - 1)

    def _other(self, bucket: int, print_: int) -> int:
        """The second bucket from the first, or the first from the second, by the fingerprint alone."""
        return (bucket ^ print_ * 0x5BD1E995) & (self.buckets - 1)

    def find(self, key: tuple) -> int:
        """The place of the key's entry, or -1. Fingerprints say where to look, the keys there decide."""
        print_, home = self._home(key[0])
        other = self._other(home, print_)
        for bucket in (home, other) if other != home else (home,):
            for place in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[place] == print_:
                    if self.entries[place][:2] == key:
                        return place
                    self.false_hits += 1
        return -1

    def _put(self, bucket: int, print_: int, entry: tuple) -> bool:
        for place in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.prints[place]:
                self.prints[place], self.entries[place] = print_, entry
                return True
        return False

    def insert(self, entry: tuple) -> None:
        """Adds an entry whose key is not there yet; others make room in turn, and if that does not end, the filter grows."""
        self.live += 1
        print_, bucket = self._home(entry[0])
        if self._put(bucket, print_, entry):
            return
        for turn in range(KICKS):
            bucket = self._other(bucket, print_)
            if self._put(bucket, print_, entry):
                return
            place = SLOTS * bucket + turn % SLOTS
            self.prints[place], print_ = print_, self.prints[place]
            self.entries[place], entry = entry, self.entries[place]
        self._grow(entry)

    def delete(self, place: int) -> None:
        self.prints[place], self.entries[place] = 0, None
        self.live -= 1

    def _grow(self, homeless: tuple) -> None:
        keys, resized, false_hits = [*filter(None, self.entries), homeless], self.resized + 1, self.false_hits
        self.__init__(2 * self.buckets)
        for entry in keys:
            self.insert(entry)
        self.resized, self.false_hits = self.resized + resized, false_hits


@dataclass(frozen=True)
class Index:
    """members: each (text, doc_id) with its copies; filters: the shards' slots; bits: how many bits of a digest name its shard."""

    members: DataFrame
    filters: DataFrame
    bits: int = 0
    batches: int = 0


def empty(spark: SparkSession) -> Index:
    return Index(spark.createDataFrame([], _MEMBERS), spark.createDataFrame([], _FILTERS))


def digests(docs: DataFrame) -> DataFrame:
    """(digest, size, doc_id, row) of every row: SHA-256 and bytes of the text (null: empty), row telling repeated rows apart; kept, as row is given by where a row is read."""
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = inner.select(F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).cast("long").alias("size"), F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    return written(rows, "digests")


def _shard(bits: int) -> Column:
    """The digest's first bits."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), 48 - bits)


def _changed(index: Index, rows: DataFrame, sign: int) -> Index:
    """The index after rows came or went: rows and members are summed up by text before they meet the filters, so no task sees a text's copies."""
    batch = index.batches
    delta = rows.groupBy("digest", "size", "doc_id").agg((F.sum("n") * sign).alias("copies"), F.struct(F.lit(batch).cast("long").alias("batch"), F.min("row").alias("row")).alias("first"))
    delta = written(delta, "delta") if batch else delta
    both = delta if not batch else index.members.unionByName(delta).groupBy("digest", "size", "doc_id").agg(F.sum("copies").alias("copies"), F.min("first").alias("first"))
    members = written(both.filter("copies > 0").select("digest", "size", "doc_id", "copies", "first"), "members")
    # of repeated rows the first is the greatest here, as its batch and row are negated
    keep = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("first.batch")).alias("batch"), (-F.col("first.row")).alias("row"))
    marked = members.select("digest", "size", "copies", keep.alias("keep"), F.lit(not batch).alias("touched"))
    if batch:
        marked = marked.unionByName(delta.select("digest", "size", F.lit(0).cast("long").alias("copies"), F.lit(None).cast(_KEEP).alias("keep"), F.lit(True).alias("touched")))
    summed = marked.groupBy("digest", "size").agg(F.max("keep").alias("keep"), F.sum("copies").alias("rows"), F.max("touched").alias("touched")).filter("touched")
    # a filter's rows hold no nulls, which pandas would make floats of
    plain = [F.coalesce("keep.known", F.lit(False)).alias("known"), *[F.coalesce(f"keep.{c}", F.lit(0)).cast("long").alias(c) for c in ("doc_id", "batch", "row")]]
    changes = written(summed.select("digest", "size", *plain, "rows"), "changes")
    live = changes.count() + (index.filters.count() if batch else 0)
    bits = max(index.bits, (max(live - 1, 0) // SHARD_KEYS).bit_length())
    state = index.filters.withColumn("shard", _shard(bits))
    if bits != index.bits:
        state = state.withColumn("buckets", F.lit(None).cast("long"))  # shards split: their filters come from the keys
    filters = state.groupBy("shard").cogroup(changes.withColumn("shard", _shard(bits)).groupBy("shard")).applyInPandas(_applied, _FILTERS)
    return Index(members, written(filters, "filters"), bits, batch + 1)


def loaded(state: pd.DataFrame) -> Cuckoo:
    """The filter of a shard's rows, as it was kept; from its keys alone where the shard has been split."""
    entries = list(state[["digest", "size", "known", "doc_id", "batch", "row", "rows"]].itertuples(index=False, name=None))
    if not entries or pd.isna(state["buckets"].iloc[0]):
        found = Cuckoo()
        for entry in entries:
            found.insert(entry)
        return found
    found = Cuckoo(int(state["buckets"].iloc[0]))
    for place, print_, entry in zip(state["place"], state["print"], entries):
        found.prints[place], found.entries[place] = print_, entry
    found.live = len(entries)
    return found


def _applied(state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's slots after its changes: a digest that nothing has any more is deleted, one that lives is replaced, a new one is inserted."""
    shard = (state if len(state) else changes)["shard"].iloc[0]
    found = loaded(state)
    for entry in changes[["digest", "size", "known", "doc_id", "batch", "row", "rows"]].itertuples(index=False, name=None):
        place = found.find(entry[:2])
        if place < 0 and entry[-1] > 0:
            found.insert(entry)
        elif place >= 0 and entry[-1] > 0:
            found.entries[place] = entry
        elif place >= 0:
            found.delete(place)
    out = [(shard, found.buckets, place, found.prints[place], *entry) for place, entry in enumerate(found.entries) if entry]
    return pd.DataFrame(out, columns=["shard", "buckets", "place", "print", "digest", "size", "known", "doc_id", "batch", "row", "rows"])


def _keep_id() -> Column:
    """Of an entry `e`: the doc_id that stays."""
    return F.when(F.col("e.known"), F.col("e.doc_id")).alias("keep_id")


def _met(rows: DataFrame, index: Index, how: str) -> DataFrame:
    """rows with the index's entry of their text as `e`: entries of hot texts, fewer than HOT, are broadcast, the others meet fewer than one in HOT rows each."""
    entries = index.filters.select("digest", F.struct("size", "known", "doc_id", "batch", "row", "rows").alias("e"))
    hot = F.col("e.rows") * HOT > (index.members.agg(F.sum("copies")).first()[0] or 0)
    marked = rows.join(F.broadcast(entries.filter(hot)), "digest", "left")
    rest = marked.filter("e is null").drop("e").join(entries.filter(~hot), "digest", how)
    return marked.filter("e is not null").unionByName(rest)


def added(index: Index, docs: DataFrame) -> tuple[Index, DataFrame]:
    """The index with docs in it, and for every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of all rows of one text that the index holds then, one stays: that of the largest
    doc_id (null last), of repeated rows the one that came first; keep_id is its doc_id,
    kept says whether this row is it. Null and empty texts are equal; a text of any
    length is one digest; an empty table gives no rows; other columns are not looked at,
    whatever their names.
    """
    rows = digests(docs)
    after = _changed(index, rows.withColumn("n", F.lit(1).cast("long")), 1)
    stays = (F.col("e.batch") == -index.batches) & (F.col("e.row") == -F.col("row"))
    decided = _met(rows, after, "inner").select("doc_id", _keep_id(), F.col("e.rows").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return after, decided


def removed(index: Index, docs: DataFrame) -> Index:
    """The index without the rows of docs, each one copy of its (doc_id, text); a text that no row has any more leaves its filter. Rows that are not in it count for nothing."""
    rows = digests(docs)
    known = rows.groupBy("digest", "size", "doc_id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    told = lambda df: df.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc", F.coalesce("doc_id", F.lit(0)))
    held = told(index.members).select("digest", "size", "known", "doc", "copies")
    gone = told(known).join(held, ["digest", "size", "known", "doc"]).select("digest", "size", "doc_id", "row", F.least("n", "copies").alias("n"))
    return _changed(index, gone, -1)


def looked_up(index: Index, docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, keep_id and group_size as the index has them for its text (0 rows: not in it), text_sha256."""
    return _met(digests(docs), index, "left").select("doc_id", _keep_id(), F.coalesce("e.rows", F.lit(0)).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))


def assess(docs: DataFrame) -> DataFrame:
    """What added() says of docs alone, in an index of their own."""
    return added(empty(docs.sparkSession), docs)[1]


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, as added() chooses it; columns keep names and values, whatever they are called."""
    kept = assess(docs).filter("kept").select(F.col("doc_id").isNotNull().alias("__known"), F.coalesce("doc_id", F.lit(0)).alias("__doc"), F.unhex("text_sha256").alias("__digest"))
    inner, own, (doc_id, text) = hidden(docs, "doc_id", "text")
    doc = F.col(doc_id).cast("long")
    keyed = inner.select("*", doc.isNotNull().alias("__known"), F.coalesce(doc, F.lit(0)).alias("__doc"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("__digest"))
    keys = ["__known", "__doc", "__digest"]
    copies = keyed.join(kept, keys, "left_semi").groupBy(*keys).agg(F.first(F.struct(*own)).alias("r"))
    return copies.select("r.*").toDF(*docs.columns)
