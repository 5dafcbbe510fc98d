"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces has a probability for each piece and language.  The
probability of a word is the sum over all its segmentations into pieces, from a forward
pass over its bytes; a text's is the product over its words.  Piece probabilities come
from labelled texts by expectation maximisation over the same lattice, words of any length
counting (a clause is one word in languages without spaces).  Single bytes are always pieces,
so every text has a segmentation.

Forward passes run over all distinct words of a batch together in numpy, and the values
of words met lately are kept.

Bounded fit: about ``ROWS_A_LANGUAGE`` rows of each language, drawn by hash, are used to
learn; that is the documented sample.  Prediction reads the text alone.

Defined results: ``und`` and score 0 where a text is null or has no letter, or nothing
could be learnt; score is the posterior of the predicted language, with learnt priors;
ties go to the first language by name; repeated rows and null ids are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .textkeys import buffers, word_spans

ROWS_A_LANGUAGE = 600
EM_ROUNDS = 2
KEPT_WORDS = 500_000
#: Added to every piece's expected count.
SMOOTHING = 0.05

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(77).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def _fold_case(word: bytes) -> bytes:
    return b" " + word.lower()


class Pieces:
    """Pieces of a sentencepiece vocabulary as bytes, a space for its word mark; keys of pieces by length."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        found = {bytes([b]) for b in range(256)}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                found.add(sp.id_to_piece(i).replace("▁", " ").encode().lower())
        self.pieces = sorted(p for p in found if p and b" " not in p[1:])
        self.longest = max(map(len, self.pieces))
        self.by_length = {}
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(self.longest, _BASE, np.uint64), dtype=np.uint64)
            for n in range(1, self.longest + 1):
                own = [i for i, p in enumerate(self.pieces) if len(p) == n]
                if own:
                    raw = np.frombuffer(b"".join(self.pieces[i] for i in own), np.uint8).reshape(-1, n)
                    keys = (_BYTES[raw] * powers[:n]).sum(1, dtype=np.uint64)
                    o = np.argsort(keys)
                    self.by_length[n] = (keys[o], np.array(own)[o])

    def lattice(self, words: list[bytes]):
        """(padded lengths, edges): for each end place, (length, rows, pieces) of the pieces that end there."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        edges = []
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(width, _BASE, np.uint64), dtype=np.uint64)
            sums = np.zeros((len(words), width + 1), np.uint64)
            np.cumsum(_BYTES[raw] * powers, axis=1, out=sums[:, 1:])
            for t in range(1, width + 1):
                rows = np.flatnonzero(size >= t)
                here = []
                for n, (keys, ids) in self.by_length.items():
                    if n > t:
                        break
                    # the sum of a piece at place t - n is its key times the base to the t - n
                    key = (sums[rows, t] - sums[rows, t - n]) * _inverse_power(t - n)
                    at = np.searchsorted(keys, key)
                    at[at == len(keys)] = 0
                    hit = keys[at] == key
                    if hit.any():
                        here.append((n, rows[hit], ids[at[hit]]))
                edges.append(here)
        return size, edges


_INVERSES: list[np.uint64] = [np.uint64(1)]


def _inverse_power(n: int) -> np.uint64:
    step = pow(int(_BASE), -1, 2**64)
    while len(_INVERSES) <= n:
        _INVERSES.append(np.uint64(int(_INVERSES[-1]) * step % 2**64))
    return _INVERSES[n]


def forward(size: np.ndarray, edges: list, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha [words, places, languages] scaled by word and language, log of the whole words' probabilities)."""
    n, width, languages = len(size), len(edges), p.shape[1]
    alpha = np.zeros((n, width + 1, languages))
    alpha[:, 0] = 1
    scale = np.zeros((n, languages))
    total = np.zeros((n, languages))
    for t in range(1, width + 1):
        for k, rows, ids in edges[t - 1]:
            alpha[rows, t] += alpha[rows, t - k] * p[ids]
        if t % 32 == 0:  # against underflow in long words; places longer ago than a piece no longer count
            top = alpha[:, max(0, t - 64) : t + 1].max(1)
            top[top == 0] = 1
            alpha[:, max(0, t - 64) : t + 1] /= top[:, None]
            scale += np.log(top)
        done = size == t
        if done.any():
            total[done] = np.log(alpha[done, t]) + scale[done]
    return alpha, total


def batches_of(words: list[bytes]) -> Iterator[np.ndarray]:
    """The places of all words, rising by length, in batches that a lattice holds."""
    order = np.argsort([len(w) for w in words], kind="stable")
    a = 0
    while a < len(order):
        b = a + max(1, min(4096, 400_000 // len(words[order[min(a + 4095, len(order) - 1)]])))
        yield order[a:b]
        a = b


def expected_counts(size: np.ndarray, edges: list, weight: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words of these weights, from forward and backward passes over logarithms, so of any length."""
    n, width = len(size), len(edges)
    alpha, beta = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -np.inf)
    alpha[:, 0] = 0
    beta[np.arange(n), size] = 0
    for t in range(1, width + 1):
        for k, rows, ids in edges[t - 1]:
            alpha[rows, t] = np.logaddexp(alpha[rows, t], alpha[rows, t - k] + log_p[ids])
    whole = alpha[np.arange(n), size]
    expected = np.zeros(len(log_p))
    for t in range(width, 0, -1):
        for k, rows, ids in edges[t - 1]:
            after = beta[rows, t] + log_p[ids]
            beta[rows, t - k] = np.logaddexp(beta[rows, t - k], after)
            np.add.at(expected, ids, weight[rows] * np.exp(alpha[rows, t - k] + after - whole[rows]))
    return expected


def learn(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Piece probabilities that make ``words``, met ``counts`` times, likely."""
    chunks = list(batches_of(words))
    p = np.full(len(pieces.pieces), 1.0 / len(pieces.pieces))
    kept: dict[int, tuple] = {}
    for r in range(rounds + 1):
        expected = np.full(len(p), SMOOTHING)
        for i, c in enumerate(chunks):
            size, edges = kept[i] if i in kept else pieces.lattice([words[j] for j in c])
            if len(edges) <= 48:  # lattices of longer words are made anew, as they take much memory
                kept[i] = size, edges
            weight = counts[c].astype(float)
            if r == 0:  # begin with how often each piece occurs, longer ones counting for more
                for here in edges:
                    for k, rows, ids in here:
                        np.add.at(expected, ids, weight[rows] * k)
            else:
                expected += expected_counts(size, edges, weight, np.log(p))
        p = expected / expected.sum()
    return p


class WordScores:
    """log probabilities of words in each language; those of words met lately are kept by key."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self._forget()

    def _forget(self) -> None:
        self.keys, self.scores = np.zeros(0, np.uint64), np.zeros((0, self.p.shape[1]))

    def of(self, keys, data, begins, ends) -> tuple[np.ndarray, np.ndarray]:
        """(scores of distinct words, the distinct word of each word)."""
        unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.keys, unique)
        missing = np.ones(len(unique), bool)
        inside = at < len(self.keys)
        missing[inside] = self.keys[at[inside]] != unique[inside]
        if missing.any():
            text, where = data.tobytes(), first[missing]
            words = [_fold_case(text[a:b]) for a, b in zip(begins[where].tolist(), ends[where].tolist())]
            new = np.empty((len(words), self.p.shape[1]))
            for c in batches_of(words):
                new[c] = forward(*self.pieces.lattice([words[i] for i in c]), self.p)[1]
            keys = np.concatenate([self.keys, unique[missing]])
            o = np.argsort(keys)
            self.keys, self.scores = keys[o], np.concatenate([self.scores, new])[o]
            at = np.searchsorted(self.keys, unique)
        return self.scores[at], of


_loaded: dict = {}


def _predicted(shared, path: str | None, batch_bytes: int = 2 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prior, p, tag = shared.value
        if tag not in _loaded:
            _loaded.clear()
            _loaded[tag] = WordScores(Pieces(path), p)
        scores: WordScores = _loaded[tag]
        for whole in batches:
            data, starts = buffers(whole.column("text"))
            has = whole.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            total = np.zeros((whole.num_rows, len(languages)))
            a, n = 0, whole.num_rows
            while a < n:
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + batch_bytes, "right")) - 1)
                part = data[starts[a] : starts[b]]
                keys, counts, begins, ends = word_spans(part, starts[a : b + 1] - starts[a])
                if len(keys):
                    value, of = scores.of(keys, part, begins, ends)
                    doc = np.repeat(np.arange(b - a), counts)
                    for k in range(len(languages)):
                        total[a:b, k] = np.bincount(doc, value[of, k], b - a)
                a = b
            total += prior
            best = total.argmax(1)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [whole.column("doc_id"), whole.column("held_out"), pa.array([languages[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())]), pa.array(np.where(has, score, 0.0))],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def predict(documents: DataFrame, train, rows_a_language: int = ROWS_A_LANGUAGE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; learns from rows where ``train`` holds and lang is known."""
    spark = documents.sparkSession
    known = documents.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (~train).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), letter.alias("letter"))
    if not have:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    share = F.create_map(*[x for k, c in have.items() for x in (F.lit(k), F.lit(min(1.0, rows_a_language / c)))])
    drawn = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = drawn.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").count().toArrow()
    pieces = Pieces(vocabulary)
    languages = list(have)
    columns = []
    lang, word, count = counted["lang"].to_pylist(), counted["word"].to_pylist(), counted["count"].to_numpy()
    for k in languages:
        own = [i for i, x in enumerate(lang) if x == k]
        columns.append(learn(pieces, [_fold_case(word[i].encode()) for i in own], count[own]) if own else np.full(len(pieces.pieces), 1 / len(pieces.pieces)))
    prior = np.log(np.array([have[k] for k in languages]) / sum(have.values()))
    import uuid

    shared = spark.sparkContext.broadcast((languages, prior, np.stack(columns, 1), uuid.uuid4().hex))
    return rows.mapInArrow(_predicted(shared, vocabulary), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) != 1)
