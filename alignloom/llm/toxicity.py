"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. A bounded sample of labelled training rows is drawn; its texts stay on the executors.
2. Lexicons of four families (words, stems, endings, letter groups) are mined from it
   by an aggregate. Each is a voter, as are fixed lists of insults and patterns of
   shouting, exclaiming and repetition.
3. The label model is a tree-augmented Bayes net fitted by EM: it estimates how each
   voter votes given the class and the voter that it depends on most, and which one
   that is. The given label is one more voter of modest fixed accuracy.
4. A logistic classifier is fitted to the posterior labels and scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignloom.llm.common import free_name, hidden, released, written

#: Labelled training rows of either class that the model is fitted on, at most: the smallest hashes of doc_id.
SAMPLE_ROWS = 2000
#: Terms of the lexicons, at most: those of most evidence.
MOST_TERMS = 20_000
#: Every FOLDS-th row by checksum of its doc_id is held out.
FOLDS = 5
#: Common insults, English, then German, French and Spanish.
INSULTS = (
    ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "bastard", "bitch", "asshole", "retard", "imbecile", "cretin", "filth", "vermin", "freak"),
    ("arschloch", "dummkopf", "trottel", "abschaum", "versager", "connard", "salaud", "ordure", "crétin", "pourriture", "imbécil", "basura", "escoria", "cabrón", "inútil", "asqueroso"),
)
FAMILIES = ("word", "stem", "ending", "letters")

_WORD = re.compile(r"[^\W\d_]+")
EVIDENCE = 20.0
#: How often a label is taken to be right; it anchors the label model.
LABEL_ACCURACY = 0.9
#: Longer words are one term, known by their hash.
LONG_WORD = 40


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; a null doc_id is none."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def counted(text: str | None) -> tuple[Counter, list[float]]:
    """Lower-cased words with counts, and (upper-case share, exclamation marks a word, share of the commonest word)."""
    text = text or ""
    words = Counter(_WORD.findall(text.lower()))
    n = max(1, words.total())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return words, [upper / max(1, len(text)), min(3.0, text.count("!") / n), max(words.values(), default=0) / n if n > 20 else 0.0]


def terms(word: str) -> list[tuple[str, ...]]:
    """Of each family, a word's terms; words of one or two letters have none."""
    n = len(word)
    if n < 3:
        return [(), (), (), ()]
    if n > LONG_WORD:
        return [(xxhash.xxh64_hexdigest(word),), (), (), ()]
    return [(word,), tuple(word[:k] for k in range(4, 8) if k < n), tuple(word[-k:] for k in range(4, 7) if k < n), tuple({word[i : i + 4] for i in range(n - 3)})]


def _families(words: Counter) -> list[set[str]]:
    """Of each family, the distinct terms of the words."""
    out = [set() for _ in FAMILIES]
    for w in words:
        for known, some in zip(out, terms(w)):
            known.update(some)
    return out


def bands(words: Counter) -> list[int]:
    """Six values, each of six MinHash values over the words: nearly all rows that share nine words of ten share one, few that share half."""
    factors = np.random.default_rng(7).integers(1, 1 << 63, 36, dtype=np.uint64) | np.uint64(1)
    least = np.full(36, np.iinfo(np.uint64).max, dtype=np.uint64)
    hashed = np.array([xxhash.xxh64_intdigest(w) for w in words] or [0], dtype=np.uint64)
    for at in range(0, len(hashed), 1 << 14):
        with np.errstate(over="ignore"):
            mixed = hashed[at : at + (1 << 14), None] * factors
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    return [xxhash.xxh64_intdigest(least[6 * k : 6 * k + 6].tobytes(), k) - (1 << 63) for k in range(6)]


def unlike(rows: list[list[int]]) -> list[int]:
    """Of rows that share a band, the first: copies would make each other's words look telling."""
    known, out = set(), []
    for i, keys in enumerate(rows):
        if not known.intersection(keys):
            out.append(i)
            known.update(keys)
    return out


def log_odds(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Of a term in a of n1 toxic and b of n0 clean rows, its log odds if toxic rows have it surely more often, else null; a, b are longs."""
    a, b, n1, n0 = a.cast("double"), b.cast("double"), max(1, n1), max(1, n0)
    odds = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    return F.when((a >= 3) & (odds >= 1) & (evidence(a, b, n1, n0) >= EVIDENCE), odds)


def evidence(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Twice the log likelihood ratio of two rates against one."""
    share = (a + b) / (n1 + n0)
    return 2 * (a * F.log(F.when(a > 0, a / (share * n1)).otherwise(1.0)) + b * F.log(F.when(b > 0, b / (share * n0)).otherwise(1.0)))


#: family -> term -> log odds.
Lexicon = list[dict[str, float]]


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str | None, memo: dict[str, tuple[float, ...]]) -> float:
        words, patterns = counted(text)
        x = (np.array(figures(words, patterns, self.lexicon, memo)) - self.mean) / self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ self.weights[1:] + self.weights[0])))))


def _weights(word: str, lexicon: Lexicon, memo: dict[str, tuple[float, ...]]) -> tuple[float, ...]:
    """The word's weight in each family; empty if it has none."""
    found = memo.get(word)
    if found is None:
        each = tuple(max((known[t] for t in some if t in known), default=0.0) for known, some in zip(lexicon, terms(word)))
        found = each if any(each) else ()
        if len(memo) < 200_000 and len(word) <= LONG_WORD:
            memo[word] = found
    return found


def _hits(words: Counter, lexicon: Lexicon, memo: dict[str, tuple[float, ...]]) -> list[list[tuple[int, float]]]:
    """Of each family, (count, weight) of the words that it has."""
    out = [[] for _ in lexicon]
    for w, c in words.items():
        for k, v in enumerate(_weights(w, lexicon, memo)):
            if v:
                out[k].append((c, v))
    return out


def figures(words: Counter, patterns: list[float], lexicon: Lexicon, memo: dict[str, tuple[float, ...]]) -> list[float]:
    """The classifier's inputs: the fixed lists, the length and patterns, and of each family how many, how heavy and how dense its words are."""
    n = max(1, words.total())
    out = [math.log1p(sum(words[w] for some in INSULTS for w in some)), math.log1p(n), *patterns]
    for hits in _hits(words, lexicon, memo):
        heavy = sum(c * v for c, v in hits)
        out += [math.log1p(100 * heavy / n), math.log1p(sum(v for _, v in hits)), math.log1p(len(hits)), max((v for _, v in hits), default=0.0)]
    return out


WIDTH = 5 + 4 * len(FAMILIES)


def votes(words: Counter, patterns: list[float], lexicon: Lexicon, memo: dict[str, tuple[float, ...]]) -> list[int]:
    """Each voter's 1 (toxic), -1 (clean) or 0 (abstains): each family by its density and by its number of words, the fixed lists, shouting, exclaiming, repetition."""
    n, out, (upper, marks, common) = max(1, words.total()), [], patterns
    for hits in _hits(words, lexicon, memo):
        density = 100 * sum(c * v for c, v in hits) / n
        out += [1 if density > 1.5 else -1 if density < 0.4 else 0, 1 if len(hits) > 2 else -1 if not hits else 0]
    out += [1 if any(words[w] for w in some) else 0 for some in INSULTS]
    return out + [1 if upper > 0.5 and n > 3 else 0, 1 if marks > 0.3 else 0, 1 if common > 0.6 else 0]


def spanning(related: np.ndarray) -> list[int]:
    """For each voter the one before it in the heaviest spanning tree from voter 0 (-1 for that one)."""
    k = len(related)
    parent, inside, best = [-1] * k, [0], {j: (related[0, j], 0) for j in range(1, k)}
    while best:
        j = max(best, key=lambda x: (best[x][0], -x))
        parent[j] = best.pop(j)[1]
        inside.append(j)
        for i in best:
            if related[j, i] > best[i][0]:
                best[i] = (related[j, i], j)
    return parent


def together(seen: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[j, i, class, vote of j + 1, vote of i + 1]: weighted counts, each 1/9 at least; seen: rows x voters, p: P(toxic)."""
    sides = np.concatenate([seen == v for v in (-1, 0, 1)], axis=1).astype(float)
    k = seen.shape[1]
    counts = np.stack([(sides * q[:, None]).T @ sides for q in (1 - p, p)])
    return counts.reshape(2, 3, k, 3, k).transpose(2, 4, 0, 1, 3) + 1 / 9


def dependence(pairs: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the class."""
    joint = pairs / pairs.sum(axis=(2, 3, 4), keepdims=True)
    side = joint.sum(axis=(3, 4), keepdims=True)
    alone = joint.sum(axis=4, keepdims=True) * joint.sum(axis=3, keepdims=True) / side
    return (joint * np.log(joint / alone)).sum(axis=(2, 3, 4))


def posterior(seen: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The label model by EM: P(toxic) of each row, P(vote | class, parent's vote) [voter, class, parent's vote + 1, vote + 1], the parents.

    The voters' votes given the class form a tree: each depends on the class and on
    one other voter, chosen by conditional mutual information (so voters that repeat
    each other do not add up). The label depends on the class alone, by LABEL_ACCURACY.
    """
    p = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    anchor = math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * np.where(labels == 1, 1, -1)
    k = seen.shape[1]
    for _ in range(rounds):
        pairs = together(seen, p)
        parent = spanning(dependence(pairs))
        tables = np.zeros((k, 2, 3, 3))
        for j, i in enumerate(parent):
            own = pairs[j, j].sum(axis=1) if i < 0 else None  # [class, vote]
            joint = np.repeat(own[:, None, :], 3, axis=1) if i < 0 else pairs[i, j]
            tables[j] = joint / joint.sum(axis=2, keepdims=True)
        prior = min(max(float(p.mean()), 1e-3), 1 - 1e-3)
        z = math.log(prior / (1 - prior)) + anchor
        for j, i in enumerate(parent):
            above = np.ones(len(seen), dtype=int) if i < 0 else seen[:, i] + 1
            z = z + np.log(tables[j, 1, above, seen[:, j] + 1] / tables[j, 0, above, seen[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p, tables, parent


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (intercept first) that fit soft labels y, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def untaught() -> Model:
    """Without labels of both classes to learn from: the fixed lists alone."""
    weights = np.zeros(WIDTH + 1)
    weights[0], weights[1] = -4.0, 8.0
    return Model([{} for _ in FAMILIES], np.zeros(WIDTH), np.ones(WIDTH), weights)


def sampled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, bands, terms, text) of at most SAMPLE_ROWS rows of either class of known (doc_id, toxic); terms: array<struct<family, term>>."""
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.join(F.broadcast(picked), "doc_id")  # 2 x SAMPLE_ROWS at most
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    pair = pa.struct([("family", pa.int32()), ("term", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("bands", pa.list_(pa.int64())), ("terms", pa.list_(pair)), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                keys, ends, families, found = [], [0], [], []
                for text in part.column(2).to_pylist():
                    words, _ = counted(text)
                    keys.append(bands(words))
                    for k, some in enumerate(_families(words)):
                        families += [k] * len(some)
                        found += some
                    ends.append(len(found))
                pairs = pa.StructArray.from_arrays([pa.array(families, pa.int32()), pa.array(found, pa.string())], fields=list(pair))
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.list_(pa.int64())), listed, part.column(2)], schema=schema)
        released()

    return once.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id bigint, toxic int, bands array<bigint>, terms array<struct<family:int,term:string>>, text string")


def mined(sample: DataFrame, folds: DataFrame, counts: dict[tuple[int, int], int]) -> list[Lexicon]:
    """Three lexicons: of the rows of fold 1, of fold 0, of all; folds: (doc_id, fold), counts: rows by (fold, toxic).

    Only terms whose evidence over all of the sample or half of it suffices leave the
    aggregate, MOST_TERMS at most.
    """
    each = sample.join(F.broadcast(folds), "doc_id").select("toxic", "fold", F.inline("terms"))
    a, b = ([F.count(F.when((F.col("fold") == f) & (F.col("toxic") == y), 1)) for f in (0, 1)] for y in (1, 0))
    sums = each.groupBy("family", "term").agg(*[c.alias(f"{s}{f}") for s, cs in (("a", a), ("b", b)) for f, c in enumerate(cs)]).filter("a0 + a1 >= 3")
    n = lambda y, fs: sum(counts.get((f, y), 0) for f in fs)
    side = lambda s, fs: sum((F.col(f"{s}{f}") for f in fs[1:]), F.col(f"{s}{fs[0]}"))
    made = [log_odds(side("a", fs), side("b", fs), n(1, fs), n(0, fs)).alias(f"w{i}") for i, fs in enumerate(((1,), (0,), (0, 1)))]
    strength = evidence((F.col("a0") + F.col("a1")).cast("double"), (F.col("b0") + F.col("b1")).cast("double"), max(1, n(1, (0, 1))), max(1, n(0, (0, 1))))
    kept = sums.select("family", "term", *made, strength.alias("e")).filter("w0 is not null or w1 is not null or w2 is not null").orderBy(F.desc("e"), "family", "term").limit(MOST_TERMS)
    out = [[{} for _ in FAMILIES] for _ in range(3)]
    for r in kept.collect():
        for i in range(3):
            if r[f"w{i}"] is not None:
                out[i][r["family"]][r["term"]] = r[f"w{i}"]
    return out


def _cast(sample: DataFrame, folds: DataFrame, lexicons: list[Lexicon]) -> list:
    """Rows (doc_id, votes, figures), in doc_id order; a row's lexicon is that of the other fold, so it does not know the row."""
    schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.list_(pa.int64())), ("figures", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        memos = [{}, {}]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, fold, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    words, patterns = counted(text)
                    rows.append({"doc_id": doc_id, "votes": votes(words, patterns, lexicons[fold], memos[fold]), "figures": figures(words, patterns, lexicons[fold], memos[fold])})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    placed = sample.join(F.broadcast(folds), "doc_id").select("doc_id", "fold", "text")
    return sorted(placed.mapInArrow(run, "doc_id bigint, votes array<bigint>, figures array<double>").collect(), key=lambda r: r["doc_id"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most SAMPLE_ROWS rows of either class that are labelled and not held out.

    Of repeated doc_ids the toxic label and the least text count; null doc_ids and
    labels teach nothing, null texts are texts without words. What comes to the driver
    is bounded: six numbers a sampled row, then MOST_TERMS terms, then the row's votes
    and figures; texts and words stay on the executors, whatever their length. Columns
    other than doc_id, text and toxic are not looked at.
    """
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    told, _, (label_id, toxic) = hidden(labels, "doc_id", "toxic")
    known = told.select(F.col(label_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sample = written(sampled(inner.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), known), "toxicity-sample")
    rows = sorted(sample.select("doc_id", "toxic", "bands").collect(), key=lambda r: r["doc_id"])
    rows = [rows[i] for i in unlike([r["bands"] for r in rows])]
    counts = Counter((i % 2, r["toxic"]) for i, r in enumerate(rows))
    if not sum(counts[f, 1] for f in (0, 1)) or not sum(counts[f, 0] for f in (0, 1)):
        return untaught()
    folds = docs.sparkSession.createDataFrame([(r["doc_id"], i % 2) for i, r in enumerate(rows)], "doc_id bigint, fold int")
    lexicons = mined(sample, folds, counts)
    cast = _cast(sample, folds, lexicons)
    y, x = np.array([r["toxic"] for r in rows]), np.array([r["figures"] for r in cast])
    soft, _, _ = posterior(np.array([r["votes"] for r in cast]), y)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weights = logistic((x - mean) / scale, soft)
    share, rate = float(y.mean()), totals.get(1, 0) / max(1, totals.get(0, 0) + totals.get(1, 0))
    weights[0] += math.log(rate / (1 - rate)) - math.log(share / (1 - share)) if 0 < rate < 1 else 0
    return Model(lexicons[2], mean, scale, weights)


def _scores(text: str, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        released()
        memo: dict[str, tuple[float, ...]] = {}
        for texts in batches:
            found = []
            for at in range(0, len(texts), 256):
                found += [model.score(t, memo) for t in texts.slice(at, 256).to_pylist()]
            yield pa.array(found, pa.float64())
        memo.clear()
        released()

    return score(text)


def scored(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with two last columns, score and predicted, by the names given; the text alone decides.

    Null and empty texts are scored as texts without words, long ones whole, repeated
    rows each. Columns of docs stay as they are, whatever they are called; where one is
    named so already (in any case), the new one gets underscores after it.
    """
    inner, own, (text,) = hidden(docs, "text")
    out = inner.select(*own, _scores(text, model).alias("__score"))
    return out.select("*", (F.col("__score") >= 0.5).cast("int")).toDF(*docs.columns, *(free_name(docs, n) for n in names))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not call toxic; columns keep names and values, whatever they are called.

    Null and empty texts are judged as texts without words; repeated rows each; an
    empty table stays empty.
    """
    inner, own, (text,) = hidden(docs, "text")
    return inner.select(*own, _scores(text, model).alias("__score")).filter("__score < 0.5").select(*own).toDF(*docs.columns)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Repeated rows are each scored and equal texts alike; null and empty texts as texts
    without words; long ones whole; a null doc_id is not held out; an empty table gives
    no rows; other columns of docs are not looked at, whatever their names.
    """
    model = train(docs, labels)
    inner, _, (doc_id, text) = hidden(docs, "doc_id", "text")
    rows = inner.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return scored(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
