"""Best-fit packing by the sum-of-squares rule.

Texts become token ids; longer ones are cut to pieces of the sequence length.  A
piece goes where the sum, over gap sizes g > 0, of the squared number of open
sequences with gap g comes out smallest; a new sequence is one of the choices.
Whole-length pieces are sequences of their own.  The others are dealt at random
to shards of bounded size that are packed apart; what a shard leaves open costs
a sequence or two in thousands.

Token ids of a text are those of its words, as neither the tokenizer's
normalisation nor its pre-tokenizer crosses white space; the ids of words seen
lately are kept, so the tokenizer runs once for a word in a batch at most.

Defined results: a null or empty text has the end id alone; null ids and repeated
rows are packed row by row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .textkeys import buffers, word_spans
from .wordbpe import WordIds, ragged

#: Pieces of a shard, on average.
SHARD = 65536
#: Words whose ids are kept at most.
KEPT_WORDS = 1_000_000

_tokenizers: dict = {}


def word_ids(vocabulary: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = WordIds(vocabulary, KEPT_WORDS)
    return _tokenizers[vocabulary]


def encode_pieces(vocabulary: str | None, length: int, end_id: int, batch_bytes: int = 4 << 20):
    """Arrow map: (doc_id, text) -> a row for each piece.  ``vocabulary`` None: the 49k word vocabulary installed on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids = word_ids(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        for whole in batches:
            data, starts = buffers(whole.column("text"))
            a, n = 0, whole.num_rows
            while a < n:
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + batch_bytes, "right")) - 1)
                part = data[starts[a] : starts[b]]
                keys, counts, begins, ends = word_spans(part, starts[a : b + 1] - starts[a])
                at, size = ids.find(keys, part, begins, ends)
                flat = ids.flat[ragged(at, size)]
                done = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
                row, piece, start, long, crc = [], [], [], [], []
                for i in range(b - a):
                    own = np.append(flat[done[i] : done[i + 1]], np.uint32(end_id))
                    for k, s in enumerate(range(0, len(own), length)):
                        x = own[s : s + length]
                        row.append(a + i)
                        piece.append(k)
                        start.append(s)
                        long.append(len(x))
                        crc.append(zlib.crc32(x.astype("<u4", copy=False)))
                yield pa.RecordBatch.from_arrays(
                    [whole.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(long, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                a = b

    return run


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given; pieces have 1 to ``capacity`` tokens."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; gap 0 is closed and never counted
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gaps = count[s:]
        change = 2 * (count[: capacity + 1 - s] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = none
        best = int(change.argmin())
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if change[best] <= new:
            g = best + s
            at = open_with[g].pop()
            count[g] -= 1
            gap = g - s
        else:
            at, used = used, used + 1
            g, gap = capacity, capacity - s
        sequence[i], offset[i] = at, capacity - g
        if gap:
            count[gap] += 1
            open_with[gap].append(at)
    return sequence, offset


def pack(pieces: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """``pieces`` (with a column length) plus sequence_id and offset.

    Within a shard the longest pieces come first, so that the short ones close gaps.  Rows
    are dealt to shards one by one, so repeated rows don't meet in one.
    """
    n = pieces.where(F.col("length") < capacity).count()
    shards = max(1, -(-n // shard))
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(t: pa.Table) -> pa.Table:
        size = t["length"].to_numpy()
        order = np.lexsort((t["piece"].to_numpy(), t["ids_crc32"].to_numpy(), t["doc_id"].fill_null(-1).to_numpy(), -size))
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        sequence[order], offset[order] = sum_of_squares(size[order], capacity)
        base = np.int64(t["shard"][0].as_py()) << np.int64(32)
        return t.drop(["shard"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    short = pieces.where(F.col("length") < capacity).select(*keys, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    packed = short.groupBy("shard").applyInArrow(run, schema + ", sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(*keys, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_texts(documents: DataFrame, length: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every text with its sequence and place there."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return pack(stored(rows.mapInArrow(encode_pieces(vocabulary, length, end_id), schema), "pieces"), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"))
