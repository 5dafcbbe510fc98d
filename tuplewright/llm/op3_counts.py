"""Edit-aware token counts.

A document keeps a segment tree over its pre-tokens: leaves are runs of consecutive
pre-tokens with their length and token count, inner nodes the sums below them.  An edit
goes down from the root to the leaf of its place by the sums of lengths and re-encodes the leaves it touches, one leaf of context before them, and as much after them
as it takes until a pre-token ends where an old leaf ended; from there on the text and so
its pre-tokens are the old ones.  Only sums on the way from those leaves to the root change.

Why this is exact: the pre-token pattern is matched from left to right and looks ahead by
one place beyond the white space at a pre-token's end, never back; so pre-tokens a leaf
before the edit can't see it, and a match that starts at an old boundary in unchanged text
goes on as before.

Defined results: a null text counts as empty, with no tokens; edits whose places lie beyond
the text are clipped to it, an end before its start counts as the start, a null replacement
as empty; edits of one document apply in order of ``seq``, then place, then text, each to
the text that the one before left; edits of unknown documents change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAF = 16
KEPT = 500_000
_encoders: dict = {}


class Counter(dict):
    """Token counts of pre-tokens, of those met lately kept."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.match = regex.compile(public_tokenizers.PATTERN).match
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, s: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[s] = len(self.encoding.encode_ordinary(s))
        return n


def counter(path: str | None = None) -> Counter:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        _encoders[path] = Counter(path)
    return _encoders[path]


class CountedText:
    """A text with its tree, as two arrays: the sums of characters and of tokens.

    Node 1 is the whole, node k's children are 2k and 2k + 1, the leaves begin at ``first``
    and those past the text's end are empty.
    """

    def __init__(self, text: str, count: Counter, leaf: int = LEAF, state: tuple[list[int], list[int]] | None = None):
        self.text, self.count, self.leaf = text, count, leaf
        self.reencoded = 0
        if state is not None:
            self.chars, self.tree = list(state[0]), list(state[1])
            self.first = len(self.tree) // 2
        else:
            self._build()

    def _leaves(self, tokens: list[str], size: int) -> list[tuple[int, int]]:
        values = [self.count[t] for t in tokens]
        return [(sum(map(len, tokens[a : a + size])), sum(values[a : a + size])) for a in range(0, len(tokens), size)]

    def _build(self) -> None:
        leaves = self._leaves(self.count.split(self.text), self.leaf)
        self.first = 1
        while self.first < len(leaves):
            self.first *= 2
        self.chars, self.tree = ([0] * self.first + [x[i] for x in leaves] + [0] * (self.first - len(leaves)) for i in (0, 1))
        for k in range(self.first - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tree[k] = self.tree[2 * k] + self.tree[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.tree[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The first leaf that ends at ``place`` or after it, and where it ends; from the root down."""
        k, before = 1, 0
        while k < self.first:
            k *= 2
            if before + self.chars[k] < place:
                before += self.chars[k]
                k += 1
        return k - self.first, before + self.chars[k]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Puts ``new`` in place of characters start to stop."""
        start = max(0, min(start, len(self.text)))
        stop = max(start, min(stop, len(self.text)))
        text = self.text[:start] + new + self.text[stop:]
        moved = len(new) - (stop - start)
        low, end = self._leaf_at(start)
        begin = end - self.chars[self.first + low]
        if low:
            low -= 1
            begin -= self.chars[self.first + low]
        after, end = self._leaf_at(stop)
        last = self._leaf_at(len(self.text))[0]
        at, tokens, high = begin, [], None
        while at < len(text):
            m = self.count.match(text, at)
            tokens.append(m[0])
            at = m.end()
            while after < last and end + moved < at:
                after += 1
                end += self.chars[self.first + after]
            if at >= start + len(new) and end + moved == at and after >= low:
                high = after + 1
                break
        grown = not self.text
        self.text = text
        self.reencoded += at - begin
        if high is None:  # to the end of the text, where empty leaves may follow
            high = max(last + 1, min(self.first, low - -len(tokens) // self.leaf))
        places = high - low
        size = max(1, -(-len(tokens) // places))
        if grown or size > 8 * self.leaf:
            self._build()  # grown too far for its tree
            self.reencoded += len(text)
            return
        leaves = self._leaves(tokens, size)
        leaves += [(0, 0)] * (places - len(leaves))
        touched = set()
        for i, (c, n) in enumerate(leaves, self.first + low):
            self.chars[i], self.tree[i] = c, n
            touched.add(i // 2)
        while touched - {0}:
            for k in touched:
                self._add(k)
            touched = {k // 2 for k in touched if k > 1}


def _tree_of(path, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                trees = [CountedText(x or "", count, leaf) for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tree for t in trees], pa.list_(pa.int64())), pa.array([t.tokens for t in trees], pa.int64())],
                    [*b.schema.names, "char_tree", "tree", "n_tokens"],
                )

    return run


def build(documents: DataFrame, leaf: int = LEAF, vocabulary: str | None = None) -> DataFrame:
    """``documents`` with their trees: char_tree, tree and n_tokens (columns of these names are replaced; ``apply_lists`` and ``apply_edits`` also replace ``reencoded`` and take ``edits``)."""
    rows = documents.drop("char_tree", "tree", "n_tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_tree_of(vocabulary, leaf), schema + ", char_tree array<int>, tree array<bigint>, n_tokens bigint")


def _edited(path, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                done = []
                for text, chars, tree, edits in zip(*(b.column(c).to_pylist() for c in ("text", "char_tree", "tree", "edits"))):
                    t = CountedText(text or "", count, leaf, (chars, tree))
                    for e in edits or []:
                        t.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
                    done.append(t)
                columns = {n: b.column(n) for n in b.schema.names if n != "edits"}
                columns |= {
                    "text": pa.array([t.text for t in done], pa.string()),
                    "char_tree": pa.array([t.chars for t in done], pa.list_(pa.int32())),
                    "tree": pa.array([t.tree for t in done], pa.list_(pa.int64())),
                    "n_tokens": pa.array([t.tokens for t in done], pa.int64()),
                    "reencoded": pa.array([t.reencoded for t in done], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def apply_lists(trees: DataFrame, leaf: int = LEAF, vocabulary: str | None = None) -> DataFrame:
    """``trees`` (from ``build``) after the edits in their column ``edits``, an array of (start, stop, new) in order; plus reencoded, the characters encoded anew."""
    rows = trees.drop("reencoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("edits").schema)
    return rows.mapInArrow(_edited(vocabulary, leaf), schema + ", reencoded bigint")


def apply_edits(trees: DataFrame, edits: DataFrame, leaf: int = LEAF, vocabulary: str | None = None) -> DataFrame:
    """The same for a table of edits (doc_id, seq, start, stop, new); a document's edits come together, not its text."""
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "new"))).alias("edits"))
    return apply_lists(trees.drop("edits").join(listed, "doc_id", "left"), leaf, vocabulary)


def sample_edits(text, doc_id):
    """Three edits of any document, fixed by its id: a word goes in, a stretch goes, the end is written anew."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = lambda tag: F.pmod(F.xxhash64(F.lit(tag), doc_id), n + 1).cast("int")
    one = F.struct(at("insert").alias("start"), at("insert").alias("stop"), F.lit(" edited words' ").alias("new"))
    two = F.struct(at("delete").alias("start"), (at("delete") + 40).alias("stop"), F.lit("").alias("new"))
    three = F.struct(F.greatest(n - 10, F.lit(0)).alias("start"), (n + 100).alias("stop"), F.concat(F.lit("s. "), F.coalesce(doc_id.cast("string"), F.lit(""))).alias("new"))
    return F.array(one, two, three)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after their sample edits."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trees = build(docs).withColumn("n_before", F.col("n_tokens")).withColumn("edits", sample_edits(F.col("text"), F.col("doc_id")))
    return apply_lists(trees).select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), F.length("text").cast("long").alias("n_chars_after"), "reencoded")
