"""Quality classification by co-training.

Two views of a document: its text (byte frequencies and hashed words) and its page
metadata (language, source, length).  A logistic classifier of each view learns from
labelled documents; over rounds each hands the pool documents it is most confident of, as
pseudo-labels, to the other.  A held-out fifth of the labels then calibrates the views and
weighs them, and all documents get one combined probability of being wanted.

A label is positive where quality is 1 and the document isn't toxic.

Bounded fit (documented): about ``LABELLED`` labelled and ``POOL`` unlabelled documents,
drawn by hash, reach the driver as features.  Scoring reads every whole text where it lies.

Defined results: a null text counts as empty, null metadata is a value of its own; labels
that repeat an id count once, with their least quality and greatest toxicity; null labels
and labels without a document are ignored; without labels of both kinds every document
scores 1; rows are scored one by one, repeated ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkeys import buffers, mix, word_keys

LABELLED = 8000
POOL = 4000
ROUNDS = 3
#: Pseudo-labels: probabilities at least this far to one side, and so many a round and kind at most.
CONFIDENT = 0.97
A_ROUND = 400
SPACE = 1 << 18
#: Hashed words in fewer labelled documents than this are left out.
LEAST_DOCUMENTS = 8


def text_features(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(roots of byte frequencies and of the share of distinct words, distinct hashed words) of each text."""
    data, starts = buffers(texts)
    keys, counts = word_keys(texts)
    n = len(starts) - 1
    dense = np.zeros((n, 257), np.float32)
    words, ends = [], np.cumsum(counts)
    hashed = (mix(keys) & np.uint64(SPACE - 1)).astype(np.int32)
    for i in range(n):
        size = starts[i + 1] - starts[i]
        own = np.unique(hashed[ends[i] - counts[i] : ends[i]])
        words.append(own)
        if size:
            dense[i, :256] = np.sqrt(np.bincount(data[starts[i] : starts[i + 1]], minlength=256) / size)
            dense[i, 256] = np.sqrt(len(own) / max(1, counts[i]))
    return dense, words


def meta_features(lang: list, source: list, n_chars: list) -> list[np.ndarray]:
    """Hashed values of each document's metadata."""
    import zlib

    at = lambda s: zlib.crc32(s.encode()) % SPACE
    length = [-1 if c is None else int(np.log2(max(1, c)) * 2) for c in n_chars]
    return [np.unique(np.array([at(f"lang={a}"), at(f"source={b}"), at(f"length={c}"), at(f"both={a}|{c}")], np.int32)) for a, b, c in zip(lang, source, length)]


class View:
    """Logistic regression over dense and hashed features, fitted by full-batch steps with momentum."""

    def __init__(self):
        self.hashed = np.zeros(SPACE, np.float32)
        self.dense, self.bias, self.mean, self.spread = None, 0.0, None, None

    def fit(self, dense, words, y, weight=None, steps: int = 250, rate: float = 0.5, decay: float = 1e-4) -> View:
        y, n = np.asarray(y, float), len(y)
        weight = np.ones(n) if weight is None else weight
        weight = weight / weight.sum()
        row = np.repeat(np.arange(n), [len(w) for w in words])
        col = np.concatenate(words).astype(np.int64) if n else np.zeros(0, np.int64)
        common = np.bincount(col, minlength=SPACE) >= min(LEAST_DOCUMENTS, max(1, n // 20))
        names = np.flatnonzero(common)
        place = np.full(SPACE, -1)
        place[names] = np.arange(len(names))
        use = place[col] >= 0
        row, col = row[use], place[col[use]]
        rarity = 1 / np.sqrt(1 + np.bincount(col, minlength=len(names)) / n * 50)  # rarer words move faster
        self.mean, self.spread = dense.mean(0), dense.std(0) + 1e-3
        x = (dense - self.mean) / self.spread
        w, v, b = np.zeros(len(names)), np.zeros(x.shape[1]), float(np.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)))
        mw, mv, mb = np.zeros_like(w), np.zeros_like(v), 0.0
        for _ in range(steps):
            z = np.clip(b + x @ v + np.bincount(row, w[col], n), -30, 30)
            g = weight * (1 / (1 + np.exp(-z)) - y)
            mw = 0.9 * mw + np.bincount(col, g[row], len(w)) * rarity + decay * w
            mv = 0.9 * mv + (g @ x) / 10 + decay * v
            mb = 0.9 * mb + g.sum()
            w -= rate * 4 * mw
            v -= rate * mv
            b -= rate * mb
        self.hashed[names] = w
        self.dense, self.bias = v, b
        return self

    def logit(self, dense, words) -> np.ndarray:
        n = len(words)
        row = np.repeat(np.arange(n), [len(w) for w in words])
        col = np.concatenate(words) if n else np.zeros(0, np.int32)
        return np.clip(self.bias + ((dense - self.mean) / self.spread) @ self.dense + np.bincount(row, self.hashed[col], n), -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """A small logistic regression with weights held near ``prior``; the last column of x is 1."""
    w = prior.astype(float).copy()
    for _ in range(50):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + strength * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def co_train(labelled: dict, pool: dict, rounds: int = ROUNDS) -> dict | None:
    """The model from features ``dense``, ``words``, ``meta`` of both sets and ``y`` and ``fold`` of the labelled one."""
    y = labelled["y"]
    if len(y) == 0 or y.min() == y.max():
        return None
    blank = np.zeros((1, 1), np.float32)
    held = labelled["fold"] == 0
    if not held.any() or held.all() or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    pick = lambda xs, m: [x for x, k in zip(xs, m) if k]
    base = {"dense": labelled["dense"][~held], "words": pick(labelled["words"], ~held), "meta": pick(labelled["meta"], ~held), "y": y[~held]}
    got: dict[str, dict[int, int]] = {"text": {}, "meta": {}}  # pool documents with pseudo-labels, by the view that learns from them

    def fitted(view: str) -> View:
        extra = sorted(got[view])
        ys = np.concatenate([base["y"], [got[view][i] for i in extra]])
        weight = np.concatenate([np.ones(len(base["y"])), np.full(len(extra), 0.5)])
        if view == "text":
            return View().fit(np.concatenate([base["dense"], pool["dense"][extra]]), base["words"] + [pool["words"][i] for i in extra], ys, weight)
        return View().fit(np.repeat(blank, len(ys), 0), base["meta"] + [pool["meta"][i] for i in extra], ys, weight)

    def logits(view: str, model: View, of: dict) -> np.ndarray:
        return model.logit(of["dense"], of["words"]) if view == "text" else model.logit(np.repeat(blank, len(of["meta"]), 0), of["meta"])

    models = {v: fitted(v) for v in got}
    for _ in range(rounds):
        if not pool["words"]:
            break
        new = 0
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            p = _sigmoid(logits(teacher, models[teacher], pool))
            for label, sure in ((1, p), (0, 1 - p)):
                best = [int(i) for i in np.argsort(-sure, kind="stable") if sure[i] >= CONFIDENT and int(i) not in got[pupil]][:A_ROUND]
                got[pupil].update({i: label for i in best})
                new += len(best)
        if not new:
            break
        models = {v: fitted(v) for v in got}
    if held.any():
        part = {"dense": labelled["dense"][held], "words": pick(labelled["words"], held), "meta": pick(labelled["meta"], held)}
        x = np.stack([logits("text", models["text"], part), logits("meta", models["meta"], part), np.ones(int(held.sum()))], 1)
        single = {v: _newton(x[:, [i, 2]], y[held], np.array([1.0, 0.0])) for i, v in enumerate(("text", "meta"))}
        both = _newton(x, y[held], np.array([1.0, 0.0, 0.0]))
    else:
        single, both = {v: np.array([1.0, 0.0]) for v in got}, np.array([1.0, 0.0, 0.0])
    return {"views": models, "single": single, "both": both}


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 256):
            cut = b.slice(a, 256)
            dense, words = text_features(cut.column("text"))
            meta = meta_features(*(cut.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            yield pa.RecordBatch.from_arrays([cut.column("y"), cut.column("fold"), pa.array(list(dense), pa.list_(pa.float32())), pa.array(words, pa.list_(pa.int32())), pa.array(meta, pa.list_(pa.int32()))], ["y", "fold", "dense", "words", "meta"])


def _gathered(rows: DataFrame) -> dict:
    t = rows.mapInArrow(_features, "y int, fold int, dense array<float>, words array<int>, meta array<int>").toArrow()
    each = lambda c: [np.asarray(x, np.int32) for x in t[c].to_pylist()]
    dense = t["dense"].combine_chunks().values.to_numpy().reshape(-1, 257) if t.num_rows else np.zeros((0, 257), np.float32)
    words = t["words"].combine_chunks()
    flat, at = words.values.to_numpy(), words.offsets.to_numpy()
    return {"y": t["y"].to_numpy(), "fold": t["fold"].to_numpy(), "dense": dense, "words": [flat[a:b] for a, b in zip(at[:-1], at[1:])], "meta": each("meta")}


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                dense, words = text_features(b.column("text"))
                meta = meta_features(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
                text = model["views"]["text"].logit(dense, words)
                page = model["views"]["meta"].logit(np.zeros((len(meta), 1), np.float32), meta)
                s, (x, y, z) = model["single"], model["both"]
                p = [_sigmoid(text * s["text"][0] + s["text"][1]), _sigmoid(page * s["meta"][0] + s["meta"][1]), _sigmoid(text * x + page * y + z)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v.astype(float)) for v in p), pa.array(p[2] >= 0.5)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return run


def _plain(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> dict | None:
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    marks = marks.select("doc_id", ((F.col("q") == 1) & (F.col("t") == 0)).cast("int").alias("y"))
    draw = lambda tag: F.pmod(F.xxhash64(F.lit(tag), "doc_id"), F.lit(1 << 30))
    n = marks.count()
    some = marks.where(draw("label") < min(1.0, labelled / max(n, 1)) * (1 << 30))
    rows = _plain(documents)
    first = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    known = first.select("doc_id", "d.*", "y").withColumn("fold", (draw("fold") % 5).cast("int"))
    total = documents.count()
    drawn = rows.where("doc_id is not null").where(draw("pool") < min(1.0, pool / max(total, 1)) * (1 << 30))
    others = drawn.join(marks, "doc_id", "left_anti").withColumn("y", F.lit(0)).withColumn("fold", F.lit(0))
    return co_train(_gathered(known), _gathered(others))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of every row."""
    model = train(documents, labels)
    if model is None:
        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit(1.0).alias(c) for c in ("p_text", "p_meta", "score")], F.lit(True).alias("kept"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return _plain(documents).mapInArrow(_scored(shared), "doc_id long, p_text double, p_meta double, score double, kept boolean")


def _filtered(shared):
    scored = _scored(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                yield b.filter(next(scored(iter([b]))).column("kept"))

    return run


def wanted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, with all their columns, that the classifier keeps."""
    model = train(documents, labels)
    if model is None:
        return documents
    return documents.mapInArrow(_filtered(documents.sparkSession.sparkContext.broadcast(model)), documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
