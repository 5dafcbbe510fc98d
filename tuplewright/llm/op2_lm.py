"""LM scoring with a weighted backoff automaton.

N-gram counts of the training texts are gathered without bringing the model to
any one place.  Each input partition is cut into blocks of a bounded number of
tokens.  A block sends its distinct n-grams, as sorted key blobs with their training
counts, to buckets of the key space, and along with one of them what is left of its
texts (ids, lengths and words by number); a bucket adds up what all blocks sent and
answers each block with the totals of just the n-grams it asked for.  So texts are
read once and never shuffled.  Each block then has the part of the model that its
texts touch, and turns it into an automaton: states are n-grams below the highest
order seen in training, an arc reads a word, and a failure arc leads to the next
shorter suffix at a cost.  One pass from left to right over a text carries the state
and adds up log10 probabilities (all texts of a block step together).  A block holds
``BLOCK_TOKENS`` tokens or a single longer text, whatever the ids; buckets follow the
bytes of text.  Nothing here grows faster than the corpus, but for the number of blobs
(blocks times buckets, each of some thousand n-grams at 1 GB): beyond about 250 GB a
blob would have 20 n-grams, and ``BLOCK_TOKENS`` should grow with the memory at hand.

Smoothing: hierarchical Dirichlet.  With counts c, p(w|h) = (c(hw) + m p(w|h')) /
(c(h) + m), h' being h without its first word; as an automaton: arcs for seen hw,
and a failure weight m / (c(h) + m).  At the root p(w) = (c(w) - D) / N for known
words and D V / N for all unknown ones together, D = n1 / (n1 + 2 n2) from the
numbers of words seen once and twice (0.5 where either is 0).  Probabilities over
known words, the end and the unknown class add up to 1 in every state.

Defined results: a null text is empty and consists of its end alone; null ids and
repeated rows are scored row by row; without training texts N = V = 0 and every
token has probability 1 in both models; words are compared by 61-bit hashes, longer
n-grams by hashes whose bits grow with the corpus (``gram_bits``), so that about one
n-gram in 250,000 shares its hash with another at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, partitions, stored, table
from .textkeys import bucket_bounds, mix, pack_keys, pack_numbers, unpack_keys, unpack_numbers, word_keys

BEGIN = np.uint64(0x5BD1E9955BD1E980)
END = np.uint64(0x1B873593CC9E2D50)
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_TRAINED = np.uint64(1)
_MARKS = np.uint64(7)

#: Tokens of a block, and bytes of text whose n-grams a bucket adds up.
BLOCK_TOKENS = 300_000
BUCKET_BYTES = 5 << 20
MASS = 300.0


def word_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Begin, words and end of every text in one row, as keys; and the lengths of texts with both marks."""
    words, counts = word_keys(texts)
    lengths = counts + 2
    starts = np.cumsum(lengths) - lengths
    stream = np.empty(int(lengths.sum()), np.uint64)
    inner = np.ones(len(stream), bool)
    inner[starts] = inner[starts + lengths - 1] = False
    stream[inner] = words & ~_MARKS
    stream[starts], stream[starts + lengths - 1] = BEGIN, END
    return stream, lengths


def gram_bits(size: int) -> int:
    """Bits of an n-gram's hash for ``size`` bytes of text, which hold a third as many n-grams at most."""
    return min(61, max(32, int(size).bit_length() + 16))


def gram_levels(stream: np.ndarray, lengths: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """Keys [order][tokens]: that of level n at a place is of the n-gram ending there, 0 where a text has no such n-gram.

    Level 0 has the words' keys, the others have their highest ``bits`` bits only.
    """
    cut = ~np.uint64((1 << (64 - bits)) - 1)
    place = np.arange(len(stream)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    levels = [stream]
    with np.errstate(over="ignore"):
        total = stream * _SALTS[0]
        for k in range(1, order):
            total = stream * _SALTS[0] + np.concatenate([np.zeros(1, np.uint64), total[:-1]]) * _SALTS[k]
            key = np.maximum(mix(total) & cut, ~cut + np.uint64(1))
            key[place < k] = 0
            levels.append(key)
    return levels


def _asked(buckets: int, order: int, bits: int):
    """Blocks of texts -> their distinct n-grams with training counts, a row for each bucket, and a row of what the block is."""

    def block(part: int, ids: pa.Array, train: np.ndarray, stream: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        trained = np.where(np.repeat(train, lengths), _TRAINED, np.uint64(0))
        levels = gram_levels(stream, lengths, order, bits)
        at, kinds, blobs, counts = [], [], [], []
        for kind, chosen in enumerate((levels[:1], levels[1:])):
            if not chosen:
                continue
            keys = np.concatenate([(k | trained)[k > 0] for k in chosen])
            keys.sort()
            own = (keys & _TRAINED).astype(np.int64)
            keys &= ~_TRAINED
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            own, keys = np.add.reduceat(own, new), keys[new]
            bounds = bucket_bounds(keys, buckets)
            for b in np.flatnonzero(bounds[1:] > bounds[:-1]):
                x = slice(bounds[b], bounds[b + 1])
                at.append(int(b))
                kinds.append(kind)
                blobs.append(pack_keys(keys[x] >> np.uint64(64 - bits if kind else 0)))
                counts.append(pack_numbers(own[x]))
        n = len(at)
        words, places = np.unique(stream, return_inverse=True)
        about = pa.RecordBatch.from_arrays([ids, pa.array(train), pa.array(lengths)], ["doc_id", "train", "length"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as w:
            w.write_batch(about)
        none = pa.nulls(n, pa.binary())
        one = lambda x: pa.array([x], pa.binary())
        home = int(mix(np.array([part], np.uint64))[0] % np.uint64(buckets))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*at, home], pa.int32()),
                pa.array([part] * (n + 1), pa.int64()),
                pa.array([*kinds, None], pa.int32()),
                pa.array([*blobs, None], pa.binary()),
                pa.array([*counts, None], pa.binary()),
                pa.concat_arrays([none, one(sink.getvalue().to_pybytes())]),
                pa.concat_arrays([none, one(pack_keys(words))]),
                pa.concat_arrays([none, one(pack_numbers(places))]),
            ],
            ["bucket", "part", "kind", "keys", "counts", "about", "words", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kept = TaskContext.get().partitionId() << 24, 0, []

        def joined() -> pa.RecordBatch:
            return block(part, pa.concat_arrays([k[0] for k in kept]), *(np.concatenate([k[i] for k in kept]) for i in (1, 2, 3)))

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                cut = batch.slice(a, 64)
                stream, lengths = word_stream(cut.column("text"))
                if kept and held + len(stream) > BLOCK_TOKENS:
                    yield joined()
                    part, held, kept = part + 1, 0, []
                kept.append((cut.column("doc_id"), cut.column("train").to_numpy(zero_copy_only=False).astype(bool), stream, lengths))
                held += len(stream)
        if kept:
            yield joined()

    return run, "bucket int, part long, kind int, keys binary, counts binary, about binary, words binary, places binary"


_ANSWER = "part long, bucket int, kind int, totals binary, about binary, words binary, places binary, tokens long, types long, once long, twice long"


def _answered(t: pa.Table) -> pa.Table:
    """Totals for every row of a bucket, and the bucket's part of N, V, n1 and n2 in its first row; what blocks are goes along."""
    kinds = t["kind"].combine_chunks()
    out = {x.split(" ")[0]: [] for x in _ANSWER.split(", ")}
    figures = [0, 0, 0, 0]
    for kind in (0, 1):
        own = t.filter(pc.equal(kinds, kind))
        if not own.num_rows:
            continue
        parts = [unpack_keys(x) for x in own["keys"].to_pylist()]
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.concatenate([unpack_numbers(x) for x in own["counts"].to_pylist()]).astype(np.float64)).astype(np.int64)
        if not kind:
            words = total[(keys != BEGIN) & (total > 0)]
            figures = [int(x) for x in (words.sum(), len(words), (words == 1).sum(), (words == 2).sum())]
        cuts = np.cumsum([0] + [len(p) for p in parts])
        for c in ("part", "bucket", "kind"):
            out[c] += own[c].to_pylist()
        out["totals"] += [pack_numbers(total[of[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    rest = t.filter(pc.is_null(kinds))
    n, m = len(out["part"]), rest.num_rows
    for c in ("part", "bucket", "kind"):
        out[c] += rest[c].to_pylist()
    out["totals"] += [None] * m
    for c in ("about", "words", "places"):
        out[c] = [None] * n + rest[c].to_pylist()
    for c, v in zip(("tokens", "types", "once", "twice"), figures):
        out[c] = [v] + [0] * (n + m - 1)
    kinds_of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pydict(out, pa.schema([(c, kinds_of[k]) for c, k in (x.split(" ") for x in _ANSWER.split(", "))]))


class Automaton:
    """The part of the model that some texts touch.

    A state is 0 (the root) or 1 + the number of an n-gram below the highest order.
    The arc that leaves a state of n words on the word at a place is the (n+1)-gram
    ending there, if training has it: reading it costs ``logp`` and leads to
    ``target``.  Otherwise the failure arc leads to ``fail`` at ``fail_cost``.
    """

    def __init__(self, levels, totals, of, corpus: dict, mass: float):
        order, n = len(levels), len(totals)
        self.at = np.full((order, len(levels[0])), n, np.int64)  # each place's n-gram of each order; n: none
        cursor = 0
        for k in range(order):
            has = levels[k] > 0
            used = int(has.sum())
            self.at[k][has] = of[cursor : cursor + used]
            cursor += used
        N, V, once, twice = (corpus[x] for x in ("tokens", "words", "once", "twice"))
        D = once / (once + 2 * twice) if once and twice else 0.5
        self.unknown = float(np.log10(D * V / N)) if N else 0.0
        p = np.ones(n + 1)
        self.seen = np.append(totals > 0, False)
        self.seen[self.at[0][:1]] &= False  # the first place is a begin mark, which no arc reads
        self.target = np.zeros(n + 1, np.int64)
        self.fail = np.zeros(n + 2, np.int64)
        self.words_of = np.zeros(n + 2, np.int64)  # the number of words of a state
        first = np.zeros(n + 1, np.int64)
        for k in range(order):
            has = np.flatnonzero(self.at[k] < n)
            grams = self.at[k][has]
            first[grams] = has  # any place will do: an n-gram's parts are the same at each
            own = np.flatnonzero((np.bincount(grams, minlength=n)[:n] > 0) & (totals > 0))
            place = first[own]
            if k == 0:
                p[own] = (totals[own] - D) / N if N else 1.0
            else:
                history, suffix = self.at[k - 1][place - 1], self.at[k - 1][place]
                p[own] = (totals[own] + mass * p[suffix]) / (totals[history] + mass)
                self.fail[own + 1] = suffix + 1
            if k < order - 1:
                self.target[own] = own + 1
                self.words_of[own + 1] = k + 1
            else:
                self.target[own] = self.fail[own + 1]
        self.logp = np.log10(p)
        self.fail_cost = np.concatenate([[0.0], np.log10(mass / (totals + mass)), [0.0]])
        self.start = int(self.at[0][0]) + 1 if order > 1 and len(levels[0]) and totals[self.at[0][0]] > 0 else 0

    def score(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 probability of each text: one pass from left to right, all texts a token at a time."""
        out = np.zeros(len(starts))
        order = np.argsort(-lengths, kind="stable")
        begin, left = starts[order], lengths[order]
        state = np.full(len(starts), self.start, np.int64)
        total = np.zeros(len(starts))
        live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")  # texts longer than t
        for t in range(1, len(live)):
            active = int(live[t])
            now, lp, place = state[:active], total[:active], begin[:active] + t  # now and lp are views
            arc = self.at[self.words_of[now], place]
            hit = self.seen[arc]
            todo = np.flatnonzero(~hit)
            gain = np.where(hit, self.logp[arc], 0.0)
            after = np.where(hit, self.target[arc], now)
            while len(todo):
                s = after[todo]
                root = s == 0
                gain[todo[root]] += self.unknown
                todo, s = todo[~root], s[~root]
                if not len(todo):
                    break
                gain[todo] += self.fail_cost[s]
                s = self.fail[s]
                arc = self.at[self.words_of[s], place[todo]]
                hit = self.seen[arc]
                gain[todo[hit]] += self.logp[arc[hit]]
                after[todo] = np.where(hit, self.target[arc], s)
                todo = todo[~hit]
            now[:] = after
            lp += gain
        out[order] = total
        return out


def _scored(order: int, bits: int, corpus: dict, mass: float):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        own = next(r for r in rows if r["about"] is not None)
        about = pa.ipc.open_stream(own["about"]).read_all().combine_chunks()
        lengths, train = about["length"].to_numpy(), about["train"].to_numpy(zero_copy_only=False).astype(bool)
        words, places = unpack_keys(own["words"]), unpack_numbers(own["places"]).astype(np.int64)
        levels = gram_levels(words[places], lengths, order, bits)
        grams, of = np.zeros(0, np.uint64), places
        if order > 1:
            grams, above = np.unique(np.concatenate([k[k > 0] for k in levels[1:]]), return_inverse=True)
            of = np.concatenate([places, above + len(words)])
        answers = sorted((r["kind"], r["bucket"], r["totals"]) for r in rows if r["totals"] is not None)
        totals = np.concatenate([unpack_numbers(x) for _, _, x in answers]).astype(np.int64)
        if len(totals) != len(words) + len(grams):
            raise RuntimeError(f"{len(totals)} answers for {len(words) + len(grams)} n-grams")
        del rows, answers, grams
        a = Automaton(levels, totals, of, corpus, mass)
        starts = np.cumsum(lengths) - lengths
        count = totals[a.at[0]]
        plain = np.log10((count + 1) / (corpus["tokens"] + corpus["words"] + 1))
        plain[starts] = 0
        known = count > 0
        known[starts] = False
        return pa.table(
            {
                "doc_id": about["doc_id"].combine_chunks(),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(lengths - 1, pa.int64()),
                "n_known": pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                "train_tokens": pa.array(np.full(len(lengths), corpus["tokens"], np.int64)),
                "base_score": pa.array(np.add.reduceat(plain, starts)),
                "score": pa.array(a.score(starts, lengths)),
            }
        )

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(documents: DataFrame, train, order: int = 2, mass: float = MASS) -> DataFrame:
    """Scores every row of ``documents`` (doc_id, text) with a model of the rows where ``train`` holds.

    ``order``: the longest n-grams, 1 to 4; ``mass``: the weight m of the shorter history.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, bits = max(partitions(spark), -(-size // BUCKET_BYTES)), gram_bits(size)
    run, schema = _asked(buckets, order, bits)
    asked = rows.mapInArrow(run, schema)
    answers = stored(asked.groupBy("bucket").applyInArrow(_answered, _ANSWER), "ngrams")
    names = {"tokens": "tokens", "words": "types", "once": "once", "twice": "twice"}
    found = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(x) for x, c in names.items()]).first()
    run, schema = _scored(order, bits, {x: found[x] for x in names}, mass)
    return answers.select("part", "bucket", "kind", "totals", "about", "words", "places").groupBy("part").applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
