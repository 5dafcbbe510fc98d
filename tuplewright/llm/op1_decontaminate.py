"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

A text holds an item if their best local alignment word by word (match +1, mismatch and gap
-1) reaches ``ratio`` of the item's length, so edited and paraphrased copies score below exact
ones.  The seeds lose none of these: an alignment of score s has at most one more run of
matches than errors, so at least s - 1 of the item's pairs of adjacent words are in the text,
within the stretch that such an alignment can span.  An item's commonest pairs (by its words'
corpus frequencies) are no seeds, which leaves ``need`` of that number to be met among the
others.  What is a seed thus depends neither on the corpus size nor on how often an item leaked.

The benchmark goes to the executors in blocks of bounded size (``BLOCK_CHARS``), however
large it is; texts are never shuffled.

Defined results: null or empty texts and items match nothing; an item of one or two words
must be met whole, and any other share two adjacent words at least; repeated items and rows are
reported each, with a row for (text row, item row); null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkeys import shingle_keys, word_keys

RATIO = 0.4
BLOCK_CHARS = 8 << 20
#: Seeds met that are held at once, more only for a single text.
HITS = 1 << 20


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word keys: (best score, begin, end in ``text``)."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        n = len(b)
        slope = np.arange(n + 1, dtype=np.int32)
        row = np.zeros(n + 1, np.int32)
        top, i_end, j_end = 0, 0, 0
        for i, w in enumerate(a):
            new = np.zeros(n + 1, np.int32)
            new[1:] = np.maximum(row[:-1] + np.where(b == w, 1, -1), row[1:] - 1)
            np.maximum(new, 0, out=new)
            new = np.maximum.accumulate(new + slope) - slope  # gaps along the text
            j = int(new.argmax())
            if new[j] > top:
                top, i_end, j_end = int(new[j]), i + 1, j
            row = new
        return top, i_end, j_end

    score, i_end, j_end = best(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = best(item[:i_end][::-1], text[:j_end][::-1])
    return score, j_end - back, j_end


class Items:
    """A block of test items: word keys, and their seeds in rising order."""

    def __init__(self, ids: list, texts: list):
        keys, counts = word_keys(pa.array(texts, pa.string()))
        self.ids, self.counts = ids, counts
        self.ends = np.cumsum(counts)
        self.keys = keys
        self.words = np.unique(keys)

    def words_of(self, i: int) -> np.ndarray:
        return self.keys[self.ends[i] - self.counts[i] : self.ends[i]]

    def choose_seeds(self, frequency: np.ndarray, total: int, ratio: float) -> None:
        """``frequency``: of ``self.words`` in a corpus of ``total`` words.

        ``need``: of each item's seeds, how many places an alignment meets at least; ``around``: the words it can span.
        """
        log = np.log(np.maximum(frequency, 1) / max(total, 1))[np.searchsorted(self.words, self.keys)]
        least = np.maximum(1, np.ceil(ratio * self.counts - 1e-9).astype(np.int64))  # the score to reach
        pairs = least - 1
        self.need = np.maximum(1, np.maximum(np.minimum(2, pairs), pairs // 3))
        self.around = np.maximum(2 * self.counts - least, self.counts)
        seeds = np.where(self.counts > 2, self.counts - 1 - np.maximum(0, pairs - self.need), 1)
        found = []
        for w in (1, 2):
            keys, of, at = shingle_keys(self.keys, self.counts, w)
            right = self.counts[of] == 1 if w == 1 else self.counts[of] >= 2
            found.append([keys[right], of[right], at[right], sum(log[at[right] + j] for j in range(w))])
        self.widths = [w for w, f in zip((1, 2), found) if len(f[0])]
        keys, of, at, common = (np.concatenate(x) for x in zip(*found))
        o = np.lexsort((common, of))
        rank = np.arange(len(o)) - np.searchsorted(of[o], of[o])
        o = o[rank < seeds[of[o]]]
        o = o[np.argsort(keys[o], kind="stable")]
        self.seeds = [keys[o], of[o], at[o] - (self.ends - self.counts)[of[o]]]


def _word_counts(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = 0, np.zeros(len(words), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                keys, _ = word_keys(batch.column("text").slice(a, 512))
                total += len(keys)
                at = np.minimum(np.searchsorted(words, keys), len(words) - 1)
                counts += np.bincount(at[words[at] == keys], minlength=len(words))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([total, *counts[some].tolist()], pa.int64())], ["word", "n"])

    return run


def _windows(places: np.ndarray, around: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``size`` words that hold every alignment of up to ``around`` words over one of the seeds."""
    places = np.unique(places)
    cuts = np.flatnonzero(np.diff(places) > around) + 1
    return [(max(0, int(g[0]) - around), min(size, int(g[-1]) + around)) for g in np.split(places, cuts)]


def _met(items: Items, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, place in the keys, place in the item) of all seeds in some texts, a group of texts at a time."""
    seeds, of, item_at = items.seeds
    met = []
    for w in items.widths:
        s, doc, at = shingle_keys(keys, counts, w)
        whole = counts[doc] >= w
        s, doc, at = s[whole], doc[whole], at[whole]
        low = np.searchsorted(seeds, s, "left")
        some = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == s)
        low, high = low[some], np.searchsorted(seeds, s[some], "right")
        met.append((doc[some], at[some], low, high - low))
    doc, at, low, n = (np.concatenate(x) for x in zip(*met))
    o = np.argsort(doc, kind="stable")
    doc, at, low, n = doc[o], at[o], low[o], n[o]
    total = np.cumsum(n)
    a = 0
    while a < len(doc):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right"))
        b = int(np.searchsorted(doc, doc[b], "left")) if b < len(doc) else b
        if b <= a:
            b = int(np.searchsorted(doc, doc[a], "right"))
        m = n[a:b]
        seed = np.repeat(low[a:b], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        yield np.repeat(doc[a:b], m), of[seed], np.repeat(at[a:b], m), item_at[seed]
        a = b


def _matched(shared, ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        longest = int(items.counts.max())
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "item", "score", "ratio", "first", "last")}
            for a in range(0, batch.num_rows, 512):
                keys, counts = word_keys(batch.column("text").slice(a, 512))
                ends = np.cumsum(counts)
                for doc, item, at, place in _met(items, keys, counts):
                    pair = doc * (len(items.ids) + 1) + item
                    some, n = np.unique(np.unique(pair * longest + place) // longest, return_counts=True)
                    use = np.flatnonzero(np.isin(pair, some[n >= items.need[some % (len(items.ids) + 1)]]))
                    o = use[np.argsort(pair[use], kind="stable")]
                    for g in np.split(o, np.flatnonzero(np.diff(pair[o])) + 1) if len(o) else []:
                        d, i = int(doc[g[0]]), int(item[g[0]])
                        words, own = items.words_of(i), keys[ends[d] - counts[d] : ends[d]]
                        here = at[g] - (ends[d] - counts[d])
                        best = (0, 0, 0)
                        for x, y in _windows(here, int(items.around[i]), len(own)):
                            if len(np.unique(place[g[(here >= x) & (here < y)]])) < items.need[i]:
                                continue
                            score, begin, end = align(words, own[x:y])
                            if score > best[0]:
                                best = (score, x + begin, x + end)
                        if best[0] >= ratio * len(words):
                            for c, v in zip(out, (a + d, i, best[0], best[0] / len(words), best[1], best[2])):
                                out[c].append(v)
            ids = batch.column("doc_id").take(pa.array(out["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([items.ids[i] for i in out["item"]], pa.int64()), pa.array(out["score"], pa.int64()), pa.array(out["ratio"], pa.float64()), pa.array(out["first"], pa.int64()), pa.array(out["last"], pa.int64())],
                ["doc_id", "item_id", "score", "ratio", "first_word", "end_word"],
            )

    return run


_SCHEMA = "doc_id long, item_id long, score long, ratio double, first_word long, end_word long"


def _blocks(documents: DataFrame, benchmark: DataFrame, ratio: float, block_chars: int) -> Iterator[Items]:
    """The benchmark in blocks of about ``block_chars`` characters at most, their seeds chosen by the corpus."""
    rows = documents.select("text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        got = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = Items([r["item_id"] for r in got], [r["text"] for r in got])
        if not len(block.keys):
            continue
        counts = rows.mapInArrow(_word_counts(block.words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        frequency = np.zeros(len(block.words), np.int64)
        total = 0
        for r in counts:
            if r["word"] < 0:
                total = r["n"]
            else:
                frequency[r["word"]] = r["n"]
        block.choose_seeds(frequency, total, ratio)
        yield block


def leaks(documents: DataFrame, benchmark: DataFrame, ratio: float = RATIO, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each text and item whose best alignment reaches ``ratio`` of the item: doc_id, item_id, score, ratio, and the words it spans."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(documents, benchmark, ratio, block_chars):
        found = rows.mapInArrow(_matched(spark.sparkContext.broadcast(block), ratio), _SCHEMA)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


def _unmatched(shared, ratio: float):
    matched = _matched(shared, ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(b.num_rows)), b.column("text")], ["doc_id", "text"])
            keep = np.ones(b.num_rows, bool)
            keep[next(matched(iter([numbered]))).column("doc_id").to_numpy()] = False
            yield b.filter(pa.array(keep))

    return run


def without_leaks(documents: DataFrame, benchmark: DataFrame, ratio: float = RATIO, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no copy of an item."""
    out = documents
    for block in _blocks(documents, benchmark, ratio, block_chars):
        out = out.mapInArrow(_unmatched(documents.sparkSession.sparkContext.broadcast(block), ratio), documents.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
