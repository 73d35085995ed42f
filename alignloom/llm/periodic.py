"""Runs of repeated words, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words of smallest period q, at least `least` words and `times`
periods long, that no neighbouring word extends. A suffix automaton of the words gives
their Lempel-Ziv factors; Main's algorithm finds the runs that touch a border between
two factors; all others lie strictly inside a factor and are copied from its earlier
occurrence. Work is linear in the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignloom.llm.common import free_name, hidden, released

#: Bytes of text and texts that a task holds at a time.
SLICE_BYTES, SLICE_DOCS = 4 << 20, 2000


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start) of the Lempel-Ziv factors of s: each the longest stretch that also occurs further left, overlapping or not, or one word seen first (earlier start -1)."""
    follow, link, length, first = [{}], [-1], [0], [-1]  # states of the suffix automaton; first: where a state's strings end first
    last = 0
    for i, c in enumerate(s):
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(follow[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                link[q] = link[new] = copy
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
        last = new
    out, at, n = [], 0, len(s)
    while at < n:
        state, end = 0, at
        while end < n:
            ahead = follow[state][s[end]]
            if first[ahead] >= end:  # seen nowhere before
                break
            state, end = ahead, end + 1
        out.append((at, end, first[state] - (end - at) + 1) if end > at else (at, at + 1, -1))
        at = max(end, at + 1)
    return out


def prefixes(s: list[int]) -> list[int]:
    """For each place the length of the longest stretch from there that s begins with."""
    n = len(s)
    out, low, high = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(out[i - low], high - i) if i < high else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > high:
            low, high = i, i + k
    return out


def touching(s: list[int], before: int, at: int, end: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of maximal repetitions of `times` periods or more that reach from the border `at` or before it into s[at:end], and of those that end at `at` and start after `before`.

    before and end: the start of the factor that ends at the border, the end of the one
    that begins there. Had a repetition begun a period or more before the first of
    them, that factor would have been longer; so neither the part on the left nor the
    period is longer than both factors (Main's lemma), and windows of that size do.
    """
    right, n = end - at, len(s)
    most = max(1, (at - before + right) // (times - 1))
    left = min(at, at - before + most)
    back, ahead = s[at - left : at][::-1], s[at : min(end + 1, n)]
    far = s[at : min(at + most, n)][::-1]
    own_ahead, own_back = prefixes(ahead) if ahead else [], prefixes(back) if back else []
    of_far = prefixes([*back, -1, *far, *back])[left + 1 :] if far else []  # how far back the words agree with those that end a period later
    of_back = prefixes([*ahead, -1, *s[at - left : end + 1]])[len(ahead) + 1 :] if ahead else []
    for p in range(1, most + 1):
        if p <= len(far):  # a whole period on the right
            more = of_far[len(far) - p] if left else 0
            start, stop = at - more, at + p + (own_ahead[p] if p < len(ahead) else 0)
            if stop - start >= times * p and stop <= end and (more < left or left == at):
                yield start, stop, p
        if p <= left:  # a whole period on the left
            more = own_back[p] if p < left else 0
            start, stop = at - p - more, at + (of_back[left - p] if ahead else 0)
            if stop - start >= times * p and stop <= end and (p + more < left or left == at) and (stop > at or start > before):
                yield start, stop, p


def runs(s: list[int], least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of s, by start and period; times is 2 or more."""
    n, found = len(s), [{} for _ in range(len(s) + 1)]  # found[start]: end -> smallest period
    parts, before = factors(s), 0
    for start, end, source in [*parts, (n, n, -1)]:
        if start:
            for a, b, p in touching(s, before, start, end, times):
                found[a][b] = min(p, found[a].get(b, p))
        shift = start - source
        if source >= 0:
            for a in range(source + 1, source + end - start):  # in this order, so that copies of copies are there in time
                for b, p in found[a].items():
                    if b + shift < end:
                        found[a + shift][b + shift] = p
        before = start
    return [(a, b, p) for a in range(n) for p, b in sorted((p, b) for b, p in found[a].items()) if b - a >= least]


def stretches(ids: np.ndarray, ends: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, end) of disjoint stretches outside which no run can be, for many texts in one vector; ends: where each text ends.

    In a run of period q every word but the last q is followed by the same word within q
    words, and those are (times - 1) * q in a row at least. So for q from 2**k up to
    2**(k+1) - 1 only a stretch of (times - 1) * 2**k words whose next like words are
    that near can hold one. Such stretches are taken whole, so a run in one is maximal
    in its text too.
    """
    n = len(ids)
    texts = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort((ids, texts))
    same = (ids[order[1:]] == ids[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]])
    ahead = np.full(n + 1, n + 1, np.int64)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    out, low = [], 1
    while low * times <= max(longest, times):
        near = (times - 1) * low if low > 1 else max(times - 1, least - 1)
        breaks = np.flatnonzero(ahead >= 2 * low)  # the vector's end is one
        starts = np.concatenate(([0], breaks[:-1] + 1))
        wide = breaks - starts >= near
        begin, stop = starts[wide], breaks[wide]
        # a text's last words have no like ones ahead, so no stretch crosses an end
        out.append(np.stack((begin, np.minimum(stop + 2 * low, ends[texts[begin]])), 1))
        low *= 2
    found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    if not len(found):
        return found
    reach = np.maximum.accumulate(found[:, 1])
    first = np.concatenate(([True], found[1:, 0] >= reach[:-1]))
    return np.stack((found[first, 0], np.maximum.reduceat(found[:, 1], np.flatnonzero(first))), 1)


def runs_of_texts(texts: list[list[bytes]], least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start and period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    ends = np.cumsum([len(words) for words in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in stretches(ids, ends, least, times).tolist() if len(ids) else []:
        text = int(np.searchsorted(ends, start, side="right"))
        base = start - (int(ends[text - 1]) if text else 0)
        out[text] += [(base + a, b - a, p) for a, b, p in runs(ids[start:end].tolist(), least, times)]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that a run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, x in zip(words, np.cumsum(gone).tolist()) if not x])


def _few(texts: pa.Array, at: int) -> int:
    """How many texts from `at` on are SLICE_BYTES or less together, one at least and SLICE_DOCS at most."""
    sizes = np.cumsum(pa.compute.binary_length(texts.slice(at, SLICE_DOCS)).fill_null(0).to_numpy(zero_copy_only=False))
    return max(1, int(np.searchsorted(sizes, SLICE_BYTES, side="right")))


def detect(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words by start and period, and `collapsed`, the text without repetitions.

    Words are stretches of other characters than ASCII white space. A null text has no
    words, as an empty one; very long ones are taken whole, in time and memory linear in
    their repeated stretches; repeated rows are each searched; an empty table gives no
    rows. Columns keep names and values; where `runs` or `collapsed` is taken, underscores
    follow. No rows are shuffled.
    """
    if times < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    inner, own, (text,) = hidden(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, place = 0, own.index(text)
            while at < batch.num_rows:
                part = batch.slice(at, _few(batch.column(place), at))
                at += part.num_rows
                texts = [(x or "").encode().split() for x in part.column(place).to_pylist()]
                found = runs_of_texts(texts, least, times)
                flat = [r for rs in found for r in rs]
                values = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(rs) for rs in found]))), pa.int32()), values)
                texts_out = pa.array([collapsed(w, rs).decode() for w, rs in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists, texts_out], names=[*own, "runs", "collapsed"])
        released()

    taken = free_name(docs, "runs")
    other = free_name(docs, "collapsed")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return inner.mapInArrow(run, ddl).toDF(*docs.columns, taken, other)
