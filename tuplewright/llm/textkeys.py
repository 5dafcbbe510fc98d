"""Vectorised word, n-gram and shingle keys over Arrow text columns.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
lower-casing A-Z; everything else of UTF-8 stays as it is.  A word's key is a
64-bit polynomial hash over a fixed random byte table, taken from one prefix sum
for a whole block of texts, so no Python code runs per word.  Two different keys
mean different words; equal keys of different words have odds of about 2**-64 a
pair, which every user of this module accepts and documents.

Defined results: a null text counts as empty; an empty text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(1, 2**64 - 1, 256, dtype=np.uint64)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE_KEYS[_c] = _BYTE_KEYS[_c + 32]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_M = 0x9E3779B97F4A7C15
_M_INVERSE = pow(_M, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes of text hashed at once; longer single texts are hashed alone.
BLOCK_BYTES = 96 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit keys (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow_powers(n: int) -> None:
    global _powers, _inverses
    if len(_powers) >= n:
        return
    n = max(n, 2 * len(_powers))
    with np.errstate(over="ignore"):
        for name, base in (("_powers", _M), ("_inverses", _M_INVERSE)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, where, data = texts.buffers()
    if not len(texts) or where is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    starts = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def _block(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64), none, none
    _grow_powers(n + 1)
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = np.unique(starts[(starts > 0) & (starts < n)])
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * _powers[:n], out=sums[1:])
    keys = mix((sums[b] - sums[a]) * _inverses[a])
    return keys, np.diff(np.searchsorted(a, starts)), a, b


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all words in order, number of words of each text)."""
    return word_spans(*buffers(texts))[:2]


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all words, number of words of each text, where each word begins in ``data``, where it ends)."""
    keys, counts, first, last, i, n = [], [], [], [], 0, len(starts) - 1
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_BYTES, "right")) - 1)
            k, c, a, b = _block(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            keys.append(k)
            counts.append(c)
            first.append(a + starts[i])
            last.append(b + starts[i])
            i = j
    if not keys:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(n, np.int64), none, none
    return np.concatenate(keys), np.concatenate(counts), np.concatenate(first), np.concatenate(last)


_PLACES = _RNG.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)


def shingle_keys(keys: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all ``width``-word shingles, the text of each, the place of its first word in ``keys``.

    A text of fewer words (but one at least) has its whole sequence as its only
    shingle; a text without words has none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(keys)
    with np.errstate(over="ignore"):
        if n >= width:
            total = np.zeros(n - width + 1, np.uint64)
            for j in range(width):
                total += keys[j : n - width + 1 + j] * _PLACES[j]
            at = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
            out, of = mix(total[at]), doc[at]
        else:
            out, of, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(width - 1):
                has = counts[short] > j
                whole[has] += keys[begins[short][has] + j] * _PLACES[j]
            whole = mix(whole + counts[short].astype(np.uint64) * _PLACES[width])
            out, of, at = np.concatenate([out, whole]), np.concatenate([of, short]), np.concatenate([at, begins[short]])
    return out, of, at


def distinct_by_text(keys: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct keys in rising order, texts in order; and the number of them by text."""
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    k, d = keys[order], of[order]
    if not len(k):
        return k, np.zeros(n, np.int64)
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return k[new], np.bincount(d[new], minlength=n)


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys as differences in byte planes, which compress well."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2**64 in byte planes, as many as the largest needs (one at least); the first byte tells how many."""
    v = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel()


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal ranges of the key space begins in rising ``keys`` (n + 1 places)."""
    edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))
