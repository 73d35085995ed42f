"""Token ids of whole texts by public tokenizers, with a bounded cache of pieces."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa

#: Pretokens and units that a worker remembers: the first it meets, so the common ones.
CACHED_UNITS = 400_000
#: Longer ones are encoded but not remembered.
CACHED_CHARS = 64
#: So many texts of an Arrow batch become Python strings at a time.
SLICE_DOCS = 1000

#: The pretokenizers whose cuts Pretokens makes; the byte-level pattern is the library's own.
_WORDS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
#: Characters of other texts: these alone have one lower case of one character, no other NFC, and a class below.
_OTHER = re.compile("[^\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]")
_LETTER, _DIGIT, _SIGN, _SPACE, _LINE, _END = range(6)
_CLASS = np.array([_END if b == 0 else _LINE if b == 10 else _SPACE if b == 32 else _DIGIT if 48 <= b <= 57 else _LETTER if b >= 128 or chr(b).isalpha() else _SIGN for b in range(256)], dtype=np.uint8)
#: The characters that byte-level tokenizers write bytes as: printable ones as they are, the rest from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SHOWN_AND_END = {b: c for b, c in _SHOWN.items() if b}  # a zero byte stays, to be cut at


def pretokens(raw: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bytes) of the pretokens of texts of plain characters, each text followed by a zero byte, which is a pretoken.

    words: those of _WORDS, letters in lower case, and white space is left out of the
    bytes; else those of the byte-level pattern. Starts are places in the bytes.
    """
    raw = np.concatenate((raw, np.zeros(3, np.uint8)))  # so each byte has three after it
    kind = _CLASS[raw]
    white = (kind == _SPACE) | (kind == _LINE)
    run = np.where(white, np.uint8(_SPACE), kind)
    first = np.concatenate(([True], run[1:] != run[:-1])) | (kind == _END)
    solid = kind < _SPACE
    if words:
        first |= kind == _DIGIT
    else:
        first[:-1] |= white[:-1] & solid[1:]  # the last of white space before something else; a single space goes with that
        first[1:] &= ~(solid[1:] & (kind[:-1] == _SPACE))
    quotes = np.flatnonzero(raw == 39)
    before = kind[quotes - 1]  # of a quote in the first place: that of the end
    quotes = quotes[(before != _SIGN) & (words | (before != _SPACE))]
    one, two = raw[quotes + 1], raw[quotes + 2]
    short = quotes[np.isin(one, list(b"stmd"))]
    long = quotes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]  # re, ve, ll
    first[np.concatenate((short, long)) + 1] = False
    first[np.concatenate((short + 2, long + 3))] = True
    raw, first = raw[:-3], first[:-3]
    if words:
        raw, first = raw[~white[:-3]], first[~white[:-3]]
    return np.flatnonzero(first), raw


class Encoder:
    """Encodes a text as the tokenizer does, by units that cannot affect each other.

    Texts of plain characters (_OTHER names the others) that spell no added token, for
    the two kinds of tokenizers that pretokens() knows: all at once, cut into pretokens
    by vectors; the library's model encodes each different one. All other texts: by
    units. Which units those are depends on the tokenizer's file. Byte-level, without
    normalizer: a single space between two characters that are no white space always
    begins a token, so a text is cut before such spaces. Words split by a pattern that
    drops white space: spaces and line ends are never in a token, and no normalisation
    reaches across them. Where neither holds, or white space is of another kind, or
    the text spells an added token (which the library cuts out before all else), the
    whole text is the unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        normal = [n["type"] for n in ((spec.get("normalizer") or {}).get("normalizers") or [])]
        parts = [p["type"] for p in pre.get("pretokenizers") or []]
        self._by_space = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self._by_word = normal == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0].get("invert") and pre["pretokenizers"][0]["behavior"] == "Removed"
        added = spec.get("added_tokens") or []
        self._added = [t["content"] for t in added]
        if any(t.get("normalized") or t.get("lstrip") or t.get("rstrip") for t in added):  # may reach beyond its own spelling
            self._by_space = self._by_word = False
        self._cache: dict[str, bytes] = {}
        plain = spec["model"].get("type") == "BPE" and not any(spec.get(k) for k in ("truncation", "padding"))
        level = (pre.get("pretokenizers") or [None, {}])[1:]
        word_level = [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}] == [{k: v for k, v in x.items() if k != "trim_offsets"} for x in level]
        self._words = bool(self._by_word and spec["normalizer"]["normalizers"] == _NORMAL and pre["pretokenizers"][0] == _WORDS and word_level)
        self._plain = plain and (self._words or self._by_space)
        self._codes = {b"\0": 0}  # of each pretoken its number; its ids are _ids[_ends[number]:_ends[number + 1]]
        self._ends, self._ids = np.zeros(2, dtype=np.int64), np.zeros(0, dtype="<u4")
        vocabulary = self._tokenizer.get_vocab()
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self._edge = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids that begin (by space) or end (by word) a unit
        for token, i in vocabulary.items():
            self._edge[i] = token.startswith("\u0120") if self._by_space else bool(suffix) and token.endswith(suffix)

    def units(self, text: str) -> list[str]:
        if any(t in text for t in self._added):
            return [text]
        if self._by_word:
            return [w for w in text.replace("\n", " ").split(" ") if w]
        if self._by_space:
            words = text.split(" ")
            if all(words) and list(map(str.strip, words)) == words:
                return [words[0], *[" " + w for w in words[1:]]]
        return [text] if text else []

    def _encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit. Units that surely show their edges in their ids are encoded as one text."""
        if self._by_space:
            together = [u[:1] == " " and u.rfind(" ") == 0 and not any(t in u for t in self._added) for u in units]
        elif self._by_word:
            together = [u.isascii() and u.isalpha() and u not in self._added for u in units]
        else:
            together = [False] * len(units)
        out: dict[str, bytes] = {}
        joined = [u for u, t in zip(units, together) if t]
        for at in range(0, len(joined), 2048):
            block = joined[at : at + 2048]
            ids = np.array(self._tokenizer.encode_batch_fast([("" if self._by_space else " ").join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            edges = np.flatnonzero(self._edge[ids])
            if len(edges) != len(block):
                together = [t and u not in block for u, t in zip(units, together)]
                continue
            cuts = [*(4 * edges).tolist(), 4 * len(ids)] if self._by_space else [0, *(4 * (edges + 1)).tolist()]
            body = ids.tobytes()
            out.update((u, body[a:b]) for u, a, b in zip(block, cuts, cuts[1:]))
        alone = [u for u, t in zip(units, together) if not t]
        for at in range(0, len(alone), 4096):
            block = alone[at : at + 4096]
            out.update((u, array("I", x.ids).tobytes()) for u, x in zip(block, self._tokenizer.encode_batch_fast(block, add_special_tokens=False)))
        return [out[u] for u in units]

    def _room(self) -> bool:
        return len(self._cache) + len(self._codes) < CACHED_UNITS

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """The ids of each of these texts of plain characters."""
        whole = "\0".join([*texts, ""])
        starts, raw = pretokens(np.frombuffer((whole.lower() if self._words else whole).encode(), dtype=np.uint8), self._words)
        bounds = np.append(starts, len(raw))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        distinct, at = found.dictionary.to_pylist(), found.indices.to_numpy()
        get, ends, ids = self._codes.get, self._ends, self._ids
        codes = np.array([get(u, -1) for u in distinct], dtype=np.int64)
        missing = np.flatnonzero(codes < 0).tolist()
        if missing:
            missing.sort(key=lambda i: len(distinct[i]) > CACHED_CHARS)  # those to remember come first
            new = [distinct[i] for i in missing]
            tokenize = self._tokenizer.model.tokenize
            made = [[x.id for x in tokenize(u)] for u in b"\0".join(new).decode("latin-1").translate(_SHOWN_AND_END).split("\0")]
            codes[missing] = np.arange(len(ends) - 1, len(ends) - 1 + len(new))
            ids = np.concatenate((ids, np.array(list(chain.from_iterable(made)), dtype="<u4")))
            ends = np.concatenate((ends, ends[-1] + np.cumsum(list(map(len, made)))))
            if self._room():
                kept = sum(len(u) <= CACHED_CHARS for u in new)
                first = len(self._ends) - 1
                self._codes.update(zip(new[:kept], range(first, first + kept)))
                self._ends = ends[: first + kept + 1].copy()
                self._ids = ids[: self._ends[-1]].copy()
        which = codes[at]
        lows, counts = ends[which], ends[which + 1] - ends[which]
        past = np.cumsum(counts)
        body = ids[np.arange(past[-1]) + np.repeat(lows - past + counts, counts)].tobytes()
        cuts = [0, *(4 * past[which == 0]).tolist()]
        return [body[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, 4 bytes each, little-endian; null: none."""
        texts = [t or "" for t in texts]
        plain = [self._plain and not _OTHER.search(t) and not any(a in t for a in self._added) for t in texts]
        if not any(plain):
            return self._encode_others(texts)
        some = iter(self._encode_plain([t for t, p in zip(texts, plain) if p]))
        others = iter([] if all(plain) else self._encode_others([t for t, p in zip(texts, plain) if not p]))
        return [next(some) if p else next(others) for p in plain]

    def _encode_others(self, texts: list[str]) -> list[bytes]:
        """The ids of each of these texts, by units."""
        cut = [self.units(t) for t in texts]
        cache = self._cache
        missing = list(set(chain.from_iterable(cut)).difference(cache))
        found = dict(zip(missing, self._encode_units(missing)))
        if self._room():
            cache.update((u, b) for u, b in found.items() if len(u) <= CACHED_CHARS)
            if all(len(u) <= CACHED_CHARS for u in missing):
                return [b"".join([cache[u] for u in units]) for units in cut]
        return [b"".join([found[u] if u in found else cache[u] for u in units]) for units in cut]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = sys.modules.setdefault("_alignloom_worker", ModuleType("_alignloom_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def blocks(texts: list[str | None], most_chars: int = 2_000_000) -> Iterator[range]:
    """Consecutive index ranges whose texts have about most_chars characters together, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most_chars:
            yield range(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))
