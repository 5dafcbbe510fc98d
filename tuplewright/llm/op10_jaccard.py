"""N-gram Jaccard join by size-aware heavy-light partitioning.

Documents are sets of distinct word shingles; two link when their Jaccard similarity
reaches a threshold.  Small sets (up to a boundary) enumerate the fixed-size subsets
that any partner among small sets must share; large sets scan inverted lists, cut to
the prefix that any partner must meet, rarest shingles first.  The boundary is the
one of least cost for the numbers of short texts at hand.

Exact document frequencies come without moving texts: a block of texts sends its
shingles as sorted key blobs to buckets of the key space, a bucket answers each block
with only those shingles that occur in two documents or more, and the block picks
prefixes and subsets.  Only shared shingles can make up an intersection, so they and
the set's size are all that the exact check of a pair needs.

Equal sets count as one class, so copies never meet in pairs.  Within a list, rounds of
stars link a leader with all members of other components, and only what stays apart
after them is paired, so a group of m near copies costs about m checks, not m^2.  Pairs
of different components are checked where the elements that follow the list's shingle
could still make up the overlap that the pair needs; every linked pair has such a list.
A sketch of each set's shared shingles (the parity of those that fall on each of its
bits) bounds the difference of two sets from below, as what they have in common cancels
out; pairs whose sketches already differ by too much never leave the join.  So of a group
of copies edited beyond the threshold only the pairs next to it are looked at.  Hot lists
and classes are joined under AQE's skew splitting, never gathered.

Defined results: a null text counts as empty; empty sets link with nothing and are their
own component; rows are judged one by one, so rows with equal ids may differ in
n_shingles but a component's id is the smallest non-null id in it (null if it has none);
shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, partitions, stored, table
from .textkeys import bucket_bounds, distinct_by_text, mix, pack_keys, pack_numbers, shingle_keys, unpack_keys, unpack_numbers, word_keys

#: Shingles gathered before a block is sent.
BLOCK_SHINGLES = 1_000_000
LARGEST_SMALL = 24
STAR_ROUNDS = 3
#: 64-bit words of a sketch.  It tells sets apart whose allowed difference is below about half its bits: some 2,500 shingles.
SKETCH_WORDS = 16


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection with which sets of a and b elements link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    return sorted({least_overlap(n, r, percent) for r in partner_sizes(n, percent) if r <= boundary})


def prefix_length(n, percent: int):
    return n + percent * n // -100 + 1  # n - ceil(percent n / 100) + 1


def choose_boundary(sizes: dict[int, int], percent: int, scan: float = 8.0) -> int:
    """The boundary of least cost: a subset costs 1, a posting costs 1 and ``scan`` for its list."""

    def cost(x: int) -> float:
        small = sum(c * sum(comb(n, q) for q in subset_sizes(n, x, percent)) for n, c in sizes.items() if n <= x)
        return small + sum(c * prefix_length(n, percent) * (1 + scan) for n, c in sizes.items() if n * 100 >= percent * (x + 1))

    return min(range(LARGEST_SMALL + 1), key=cost)


def _posted(width: int, buckets: int):
    """Blocks of texts -> for each bucket their shingles and texts, and what the block knows of its texts."""

    def block(part: int, ids: pa.Array, keys: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        of = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(keys), dtype=np.uint64)])
            whole = mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64))
        o = np.argsort(keys)
        keys, of = keys[o], of[o]
        at = bucket_bounds(keys, buckets)
        full = [b for b in range(buckets) if at[b] < at[b + 1]]
        n = len(full)
        none = pa.nulls(n, pa.binary())
        home = int(mix(np.array([part], np.uint64))[0] % np.uint64(buckets))
        about = pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(whole.view(np.int64))], ["doc_id", "n", "class"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, about.schema) as w:
            w.write_batch(about)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*full, home], pa.int32()),
                pa.array([part] * (n + 1), pa.int64()),
                pa.concat_arrays([pa.array([pack_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary()), pa.nulls(1, pa.binary())]),
                pa.concat_arrays([pa.array([pack_numbers(of[at[b] : at[b + 1]]) for b in full], pa.binary()), pa.nulls(1, pa.binary())]),
                pa.concat_arrays([none, pa.array([sink.getvalue().to_pybytes()], pa.binary())]),
            ],
            ["bucket", "part", "keys", "texts", "about"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, keys, sizes, held = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                cut = batch.slice(a, 256)
                k, c = word_keys(cut.column("text"))
                s, of, _ = shingle_keys(k, c, width)
                d, n = distinct_by_text(s, of, len(c))
                ids.append(cut.column("doc_id"))
                keys.append(d)
                sizes.append(n)
                held += len(d) + len(c)
                if held >= BLOCK_SHINGLES:
                    yield block(part, pa.concat_arrays(ids), np.concatenate(keys), np.concatenate(sizes))
                    part, ids, keys, sizes, held = part + 1, [], [], [], 0
        if ids:
            yield block(part, pa.concat_arrays(ids), np.concatenate(keys), np.concatenate(sizes))

    return run, "bucket int, part long, keys binary, texts binary, about binary"


def _answered(t: pa.Table) -> pa.Table:
    """A bucket's shingles that occur in two documents or more, sent back to the blocks with their frequencies."""
    rows = t.to_pylist()
    own = [r for r in rows if r["keys"] is not None]
    out = [{**r, "dfs": None} for r in rows if r["keys"] is None]
    if own:
        parts = [unpack_keys(r["keys"]) for r in own]
        _, of, df = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        df, at = df[of], 0
        for r, keys in zip(own, parts):
            here = df[at : at + len(keys)]
            at += len(keys)
            shared = here > 1
            if shared.any():
                out.append({"part": r["part"], "keys": pack_keys(keys[shared]), "texts": pack_numbers(unpack_numbers(r["texts"])[shared]), "dfs": pack_numbers(here[shared]), "about": None})
    return pa.Table.from_pylist(out, pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("texts", pa.binary()), ("dfs", pa.binary()), ("about", pa.binary())]))


def _subsets(keys: np.ndarray, q: int) -> np.ndarray:
    """A key for each subset of q of the rising ``keys``."""
    from itertools import combinations

    if len(keys) < q:
        return np.zeros(0, np.uint64)
    chosen = np.array(list(combinations(range(len(keys)), q)), np.int64).reshape(-1, q)
    with np.errstate(over="ignore"):
        total = np.full(len(chosen), q, np.uint64)
        for j in range(q):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + keys[chosen[:, j]])
    return total


def sketches(keys: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` sets, the parity of its elements on each bit: two sets differ in as many elements as bits at least."""
    out = np.zeros((n, SKETCH_WORDS), np.uint64)
    with np.errstate(over="ignore"):
        bit = mix(keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    bit = bit % np.uint64(64 * SKETCH_WORDS)
    np.bitwise_xor.at(out, (of, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def _chosen(percent: int, boundary: int):
    """Blocks' answers -> each text with its list keys, their reaches and, where it has any, its shared shingles.

    A list entry's reach is the most that the text can have in common with a partner whose first common shingle it
    is: the elements from there on in order of frequency; of a subset, its size.  ``own`` counts the shingles that no
    other text has.
    """

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        about = pa.ipc.open_stream(next(r["about"] for r in rows if r["about"] is not None)).read_all().combine_chunks()
        n = about["n"].to_numpy()
        rows = [r for r in rows if r["keys"] is not None]
        none = np.zeros(0, np.uint64)
        keys = np.concatenate([none, *(unpack_keys(r["keys"]) for r in rows)])
        texts = np.concatenate([none, *(unpack_numbers(r["texts"]) for r in rows)]).astype(np.int64)
        dfs = np.concatenate([none, *(unpack_numbers(r["dfs"]) for r in rows)]).astype(np.int64)
        o = np.lexsort((keys, dfs, texts))
        keys, texts = keys[o], texts[o]
        shared = np.bincount(texts, minlength=len(n))
        ends = np.cumsum(shared)
        sketch = sketches(keys, texts, len(n))
        lists, reaches, blobs, marks = [], [], [], []
        for i in range(len(n)):
            size, have = int(n[i]), int(shared[i])
            need = -(-percent * size // 100)
            if not have or have < need:
                lists.append(None)
                reaches.append(None)
                blobs.append(None)
                marks.append(None)
                continue
            own = keys[ends[i] - have : ends[i]]
            posts, reach = [none], [none.astype(np.int32)]
            if size <= boundary:
                rising = np.sort(own)
                for q in subset_sizes(size, boundary, percent):
                    posts.append(_subsets(rising, q))
                    reach.append(np.full(len(posts[-1]), q, np.int32))
            if 100 * size >= percent * (boundary + 1):
                posts.append(own[: max(0, prefix_length(size, percent) - (size - have))])
                reach.append(np.arange(have, have - len(posts[-1]), -1, dtype=np.int32))
            posts = np.concatenate(posts)
            lists.append(posts.view(np.int64) if len(posts) else None)
            reaches.append(np.concatenate(reach) if len(posts) else None)
            blobs.append(pack_keys(np.sort(own)) if len(posts) else None)
            marks.append(sketch[i] if len(posts) else None)
        out = {"doc_id": about["doc_id"], "n": about["n"], "class": about["class"], "own": pa.array(n - shared), "sketch": pa.array(marks, pa.list_(pa.int64())), "posts": pa.array(lists, pa.list_(pa.int64())), "reach": pa.array(reaches, pa.list_(pa.int32())), "shared": pa.array(blobs, pa.binary())}
        return pa.table(out)

    return run, "doc_id long, n long, class long, own long, sketch array<long>, posts array<long>, reach array<int>, shared binary"


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, many = b.column("shared_a").to_pylist(), b.column("shared_b").to_pylist()
            na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            both = np.array([len(np.intersect1d(unpack_keys(x), unpack_keys(y), assume_unique=True)) for x, y in zip(one, many)], np.int64)
            link = 100 * both >= percent * (na + nb - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(link)), b.column("b").filter(pa.array(link))], ["a", "b"])

    return run


def link_sets(documents: DataFrame, width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(texts, links): every row's (doc_id, n, class), and the verified links (a, b) between classes that join them up."""
    spark = documents.sparkSession
    buckets = 2 * partitions(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= 16 * (LARGEST_SMALL + width))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    sizes = short.groupBy(F.greatest(words - (width - 1), F.lit(1)).alias("n")).count().where(F.col("n") <= LARGEST_SMALL).collect()
    boundary = choose_boundary({r["n"]: r["count"] for r in sizes}, percent)
    run, schema = _posted(width, buckets)
    posted = rows.mapInArrow(run, schema)
    answered = posted.groupBy("bucket").applyInArrow(_answered, "part long, keys binary, texts binary, dfs binary, about binary")
    run, schema = _chosen(percent, boundary)
    texts = stored(answered.groupBy("part").applyInArrow(run, schema), "sets")
    held = texts.where("posts is not null")
    wide, texts = texts, stored(texts.select("doc_id", "n", "class"), "texts")
    classes = stored(held.groupBy("class").agg(*[F.first(c).alias(c) for c in ("n", "own", "sketch", "posts", "reach", "shared")]), "classes")
    discard(wide)
    posts = classes.select(F.explode(F.arrays_zip("posts", "reach")).alias("p"), "class", "n", "own").select(F.col("p.posts").alias("key"), "class", "n", "own", F.col("p.reach").alias("reach"))
    sets = classes.select("class", "n", "shared")
    full = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    posts = stored(posts.join(full, "key"), "posts")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"shared_{x}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verified(percent), "a long, b long")

    fits = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    schema = "a long, b long"
    links, tested = spark.createDataFrame([], schema), spark.createDataFrame([], schema)
    labelled, labelled_at = posts.withColumn("label", F.col("class")), None
    for r in range(STAR_ROUNDS):
        # first the set with the least share of its own, the likeliest source of the rest; then any
        rank = F.col("own") / F.col("n") if not r else F.lit(0.0)
        lead = labelled.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), F.xxhash64(F.lit(r), "class").alias("h"), "class", "n", "label")).alias("l"))
        star = labelled.join(lead, "key").where(F.col("label") != F.col("l.label")).where(fits(F.col("n"), F.col("l.n")))
        pairs = star.select(F.least("class", "l.class").alias("a"), F.greatest("class", "l.class").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        links, tested = links.union(stored(verified(pairs), "links")), tested.union(pairs)
        labels = components(links)
        labelled = posts.join(labels.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "n", "own", "reach", F.coalesce("component", "class").alias("label"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
        last, labelled = labelled_at, stored(labelled.join(mixed, "key"), "labelled")
        labelled_at = labelled
        if last is not None:
            discard(last)
    # A linked pair meets at its first common shingle (or a subset of its least overlap), where both reaches suffice; the
    # smaller set's reach must suffice for a partner of its own size at least, which empties most of the long lists.
    labelled = labelled.join(classes.select("class", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)]), "class")
    x, y = (labelled.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "own", "reach", "label", *(f"s{i}" for i in range(SKETCH_WORDS)))]) for s in "ab")
    x = x.where(F.col("reach_a") * (100 + percent) >= F.col("n_a") * (2 * percent))
    apart = F.col("own_a") + F.col("own_b")
    for i in range(SKETCH_WORDS):
        apart = apart + F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b")))
    rest = x.join(y, "key").where("label_a <> label_b and (n_a < n_b or n_a = n_b and class_a < class_b)").where(fits(F.col("n_a"), F.col("n_b")))
    rest = rest.where(F.least("reach_a", "reach_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    rest = rest.where(apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
    rest = rest.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    links = links.union(stored(verified(rest), "links"))
    return texts, links


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row."""
    texts, links = link_sets(documents, width, percent)
    label = components(links)
    of_class = texts.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    of_class = of_class.join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    least = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = of_class.select("class", "label").join(least, "label").select("class", "component_id")
    some = texts.where("n > 0").join(of_class, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = texts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.union(none)


def one_of_each(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row of each component: the one with its smallest id.

    Empty texts link with nothing, so they stay.  Of rows that repeat a kept id and text one
    stays; a component without any id keeps one row of each text.
    """
    near = stored(near_duplicates(documents, width, percent), "components")
    kept = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    n = kept.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    ids = kept.select(F.col("doc_id").alias("__id")).distinct()
    out = documents.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi")
    if n["rows"] > n["ids"]:
        out = out.dropDuplicates(["doc_id", "text"])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Brute force over all pairs that share a shingle, where ids are unique and not null.
ORACLE = r"""
WITH RECURSIVE
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM texts
),
shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS shingle FROM sets),
sizes AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT node, b FROM reach JOIN links ON other = a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least_other, doc_id)) AS component_id
FROM sizes LEFT JOIN (SELECT node, min(other) AS least_other FROM reach GROUP BY node) ON node = doc_id
"""
