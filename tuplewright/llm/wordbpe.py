"""Ids of many distinct words at once for a byte-pair vocabulary with word ends.

Most words are letters of Latin-1 and perhaps trailing punctuation.  For those the
merges run over all words together in numpy, one merge of every word at a time, in
the tokenizer's order: lowest rank first, leftmost first.  All other words go to the
tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
_NO_RANK = np.iinfo(np.int32).max


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class Merger:
    def __init__(self, vocabulary: str, word_end: str = "</w>"):
        model = json.load(open(vocabulary))["model"]
        ids = model["vocab"]
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + word_end] for s in symbols], np.int32)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([(ids[a] << 16) | ids[b] for a, b in pairs], np.uint32)
        made = np.array([ids[a + b] for a, b in pairs], np.int32)
        rank = np.arange(len(pairs), dtype=np.int32)
        o = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[o], rank[o], made[o]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == key, self.rank[at], _NO_RANK), self.made[at]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids end to end in some order, where each word's begin, how many they are); the words are non-empty and in lower case."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths)
        flat, size = [np.zeros(0, "<u4")], np.zeros(len(words), np.int64)
        for at in range(0, len(order), 4096):
            rows = order[at : at + 4096]
            symbols, size[rows] = self._encode(words, rows, lengths)
            flat.append(symbols[np.arange(symbols.shape[1])[None, :] < size[rows][:, None]].astype("<u4"))
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(flat), start, size

    def _encode(self, words, rows, lengths) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(rows), lengths[rows]
        width = int(size[-1])
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows.tolist()]), np.uint8).reshape(n, width)
        every = np.arange(n)
        symbols = self.inner[raw]
        symbols[every, size - 1] = self.last[raw[every, size - 1]]
        rank = np.full((n, width), _NO_RANK, np.int32)
        if width > 1:
            live = np.arange(width - 1)[None, :] < size[:, None] - 1
            rank[:, :-1][live] = self._ranks(symbols[:, :-1][live], symbols[:, 1:][live])[0]
        work, s, r = every, symbols, rank
        columns = np.arange(width)[None, :]
        while True:
            at = r.argmin(1)
            some = np.flatnonzero(r[np.arange(len(work)), at] < _NO_RANK)
            if len(some) < len(work):
                done = np.setdiff1d(np.arange(len(work)), some, assume_unique=True)
                symbols[work[done]] = s[done]
                work, at, s, r = work[some], at[some], s[some], r[some]
            if not len(work):
                break
            here = np.arange(len(work))
            made = self._ranks(s[here, at], s[here, at + 1])[1]
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            s = np.take_along_axis(s, shift, 1)
            r = np.take_along_axis(r, shift, 1)
            r[:, -1] = _NO_RANK
            s[here, at] = made
            size[work] -= 1
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self._ranks(s[left, at[left] - 1], s[left, at[left]])[0]
            r[here, at] = _NO_RANK
            right = np.flatnonzero(at < size[work] - 1)
            r[right, at[right]] = self._ranks(s[right, at[right]], s[right, at[right] + 1])[0]
        return symbols, size


class WordIds:
    """Ids of white-space-separated words, known by their keys, in one flat array."""

    def __init__(self, vocabulary: str, keep: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merger = Merger(vocabulary)
        self.keep = keep
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _by_tokenizer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = [np.zeros(0, "<u4")]
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in out[1:]], np.int64)
        return np.concatenate(out), np.cumsum(size) - size, size

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        matches = [_PLAIN.fullmatch(w) for w in words]
        parts = [m.groups() if m else ("", w) for w, m in zip(words, matches)]  # what isn't plain is all tail
        cores = {c: i for i, c in enumerate(dict.fromkeys([c.lower() for c, _ in parts]))}
        tails = {t: i for i, t in enumerate(dict.fromkeys([t for _, t in parts]))}
        ids_a, start_a, size_a = self.merger.encode([c.encode() or b" " for c in cores])
        if "" in cores:
            size_a[cores[""]] = 0
        ids_b, start_b, size_b = self._by_tokenizer(list(tails))
        c = np.array([cores[c.lower()] for c, _ in parts], np.int64)
        t = np.array([tails[t] for _, t in parts], np.int64)
        start = np.stack([start_a[c], len(ids_a) + start_b[t]], 1)
        size = np.stack([size_a[c], size_b[t]], 1)
        new = np.concatenate([ids_a, ids_b])[ragged(start.ravel(), size.ravel())]
        length = size.sum(1)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, new])
        keys = np.concatenate([self.keys, keys])
        place = np.concatenate([self.place, np.arange(len(keys) - len(words), len(keys))])
        o = np.argsort(keys)
        self.keys, self.place = keys[o], place[o]

    def find(self, keys: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in ``flat`` of every word's ids, given words' keys and places in ``data``."""
        o = np.argsort(keys)
        unique = keys[o]
        new = np.ones(len(keys), bool)
        new[1:] = unique[1:] != unique[:-1]
        of = np.empty(len(keys), np.int64)
        of[o] = np.cumsum(new) - 1
        unique, first = unique[new], o[new]
        if len(self.keys) > self.keep:
            self._forget()
        at = np.searchsorted(self.keys, unique)
        missing = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != unique[inside]
        if missing.any():
            text = data.tobytes()
            where = first[missing]
            self._learn(unique[missing], [text[a:b].decode() for a, b in zip(begins[where].tolist(), ends[where].tolist())])
            at = np.searchsorted(self.keys, unique)
        row = self.place[at]
        return self.start[row][of], self.length[row][of]


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start .. start + length - 1 of every row, end to end."""
    n = int(length.sum())
    out = np.ones(n, np.int64)
    full = length > 0
    s, k = start[full], length[full]
    if not len(s):
        return out
    at = np.cumsum(k) - k
    out[at[1:]] = s[1:] - (s[:-1] + k[:-1] - 1)
    out[0] = s[0]
    return np.cumsum(out)
