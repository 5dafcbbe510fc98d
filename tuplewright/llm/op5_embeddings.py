"""Embedding near-dedup over a robust-pruned flat graph.

Vectors fall into clusters, each into its ``overlap`` nearest ones, and clusters into
blocks of bounded size.  Each block builds a neighbour graph with robust pruning (a
candidate goes if a kept neighbour is ``ALPHA`` times nearer to it than the vector is);
a vector's adjacency lists from all blocks are united.  Search runs for all vectors of a
block together: greedily from the block's medoid, then range-expanding, which follows
every vector within range until nothing new is found.  Cosines are computed in double
precision for every vector visited, so no link is false.  Blocks of one cluster search
each other pairwise.  An audit compares a sample of vectors with brute force over all and
repeats with more overlap while recall is below ``RECALL``.  Recall is the mean share of a
vector's partners that are found, in the worst band of vectors with about as many partners;
the sample grows until enough vectors with few partners are in it.  Where the most overlap is
not enough, all vectors are compared with all by brute force (its time grows with the square of their
number).  The column ``recall`` has the recall that was measured, null where no vector of a part audited has a partner.

Equal vectors count as one class, so copies never meet in pairs; near copies' links are
counted, never listed, and connectivity leaves each task as a spanning forest.

Bounded fit: cluster centres come from about ``SAMPLE`` vectors; all are indexed.

Defined results: vectors of one length are compared with each other; those that are null, empty, zero, or hold null or
non-finite components have no links and are their own component; rows are judged one by
one, so repeated ids stay (a component's id is the smallest non-null id in it).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stored, table

COSINE = 0.95
SAMPLE = 16384
BLOCK = 1000
ALPHA = 1.2
DEGREE = 20
BEAM = 24
RECALL = 0.97
#: Vectors audited at first and at most, and how many with 1 to FEW partners are wanted among them.
AUDITED = 256
MOST_AUDITED = 16384
FEW = 3
LEAST_BAND = 64
#: Vectors that all are compared with at a time by brute force.
CHUNK = 16384


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision [valid rows], which rows are valid) of a list column whose lists have one length, or are empty."""
    rows = column.to_pylist()
    sizes = [len(x) for x in rows if x]
    d = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    valid = np.array([bool(x) and len(x) == d and None not in x for x in rows], bool)
    x = np.array([r for r, v in zip(rows, valid) if v], np.float64).reshape(int(valid.sum()), d)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1) if d else np.zeros(0)
        fine = np.isfinite(x).all(1) & (top > 0)
        x = x[fine] / top[fine][:, None]
    valid[np.flatnonzero(valid)[~fine]] = False
    return x / np.sqrt((x * x).sum(1))[:, None], valid


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray, kind=pa.float64()) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d)[: n + 1], pa.int32()), pa.array(x.ravel(), kind))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's class (null: links with nothing) and unit vector."""
    import xxhash

    for whole in batches:
        for a in range(0, whole.num_rows, 4096):
            b = whole.slice(a, 4096)
            x, valid = unit_rows(b.column("embedding"))
            key, unit = [None] * b.num_rows, [None] * b.num_rows
            for i, row in zip(np.flatnonzero(valid).tolist(), x):
                key[i], unit[i] = np.uint64(xxhash.xxh3_64_intdigest(row.tobytes())).astype(np.int64), row
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(key, pa.int64()), pa.array(unit, pa.list_(pa.float64()))], ["vec_id", "class", "unit"])


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from a fixed random start."""
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(1))
        c = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def _assigned(shared, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        k = min(overlap, len(c))
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                x = _matrix(b.column("unit"))
                near = np.sort(np.argsort(-(x @ c.T), 1, kind="stable")[:, :k].astype(np.int32), 1)
                yield pa.RecordBatch.from_arrays([b.column("class"), b.column("size"), b.column("unit"), _lists(near, pa.int32())], ["class", "size", "unit", "clusters"])

    return run


def pruned_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each vector: robust pruning of its nearest and some random ones, with the edges turned round as well."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    s = x @ x.T
    near = min(3 * degree, m - 1)
    np.fill_diagonal(s, -2)
    pool = np.argpartition(-s, near - 1, 1)[:, :near]
    far = np.random.default_rng(m).integers(0, m, (m, min(degree, m)))
    pool = np.concatenate([pool, far], 1)
    sims = np.take_along_axis(s, pool, 1)
    o = np.argsort(-sims, 1, kind="stable")
    pool, sims = np.take_along_axis(pool, o, 1), np.take_along_axis(sims, o, 1)
    own = np.sqrt(np.maximum(0, 2 - 2 * sims))
    alive = sims > -2
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    rows = np.arange(m)
    edges = []
    for _ in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        chosen = pool[rows, first]
        edges.append(np.stack([rows[some], chosen[some]]))
        between = np.sqrt(np.maximum(0, 2 - 2 * s[chosen[:, None], pool]))
        alive &= ~(alpha * between <= own)
        alive[rows, first] = False
    a, b = np.concatenate(edges, 1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    pair = np.unique(a * m + b)
    a, b = pair // m, pair % m
    return np.split(b, np.searchsorted(a, np.arange(1, m)))


def _built(t: pa.Table) -> pa.Table:
    x, names = _matrix(t["unit"]), t["class"].to_numpy()
    return pa.table({"class": t["class"].combine_chunks(), "near": pa.array([names[n] for n in pruned_graph(x)], pa.list_(pa.int64()))})


def padded(near: list[np.ndarray]) -> np.ndarray:
    wide = max([1, *map(len, near)])
    out = np.full((len(near), wide), -1, np.int64)
    for i, n in enumerate(near):
        out[i, : len(n)] = n
    return out


def range_search(q: np.ndarray, x: np.ndarray, near: np.ndarray, medoid: int, cosine: float, beam: int = BEAM) -> np.ndarray:
    """[queries, vectors] of what lies within range, as found from the medoid."""
    n, m = len(q), len(x)
    visited, hits, open_ = np.zeros((n, m), bool), np.zeros((n, m), bool), np.zeros((n, m), bool)
    rows = np.arange(n)
    beam_ids = np.full((n, beam), -1, np.int64)
    beam_sims = np.full((n, beam), -3.0)
    done = np.ones((n, beam), bool)
    beam_ids[:, 0], beam_sims[:, 0], done[:, 0] = medoid, q @ x[medoid], False
    visited[:, medoid] = True
    hits[:, medoid] = beam_sims[:, 0] >= cosine
    open_ |= hits
    live = rows
    while len(live):  # greedy: the best open vector of each beam gives its neighbours
        best = np.where(done[live], -9.0, beam_sims[live]).argmax(1)
        go = ~done[live, best]
        live, best = live[go], best[go]
        if not len(live):
            break
        at = beam_ids[live, best]
        done[live, best] = True
        open_[live, at] = False
        nb = near[at]
        fresh = (nb >= 0) & ~visited[live[:, None], nb]
        r, c = np.nonzero(fresh)
        sims = np.full(nb.shape, -3.0)
        sims[r, c] = np.einsum("ij,ij->i", q[live[r]], x[nb[r, c]])
        visited[live[r], nb[r, c]] = True
        within = sims[r, c] >= cosine
        hits[live[r[within]], nb[r, c][within]] = True
        open_[live[r[within]], nb[r, c][within]] = True
        ids = np.concatenate([beam_ids[live], np.where(fresh, nb, -1)], 1)
        all_sims = np.concatenate([beam_sims[live], sims], 1)
        flags = np.concatenate([done[live], ~fresh], 1)
        o = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        beam_ids[live], beam_sims[live], done[live] = (np.take_along_axis(v, o, 1) for v in (ids, all_sims, flags))
    while open_.any():  # range-expanding: every vector within range gives its neighbours
        r, c = np.nonzero(open_)
        open_[:] = False
        for a in range(0, len(r), 65536):
            rr = np.repeat(r[a : a + 65536], near.shape[1])
            nb = near[c[a : a + 65536]].ravel()
            use = nb >= 0
            rr, nb = rr[use], nb[use]
            use = ~visited[rr, nb]
            key = np.unique(rr[use] * m + nb[use])
            rr, nb = key // m, key % m
            visited[rr, nb] = True
            within = np.einsum("ij,ij->i", q[rr], x[nb]) >= cosine
            hits[rr[within], nb[within]] = True
            open_[rr[within], nb[within]] = True
    return hits


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs over n nodes: each node with the least of its component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _searched(cosine: float):
    """Two blocks of a cluster (or one twice): links counted where this cluster owns the pair, and a spanning forest of them."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, j, cluster = t["i"][0].as_py(), t["j"][0].as_py(), t["cluster"][0].as_py()
        names, size, block = t["class"].to_numpy(), t["size"].to_numpy(), t["block"].to_numpy()
        x, clusters = _matrix(t["unit"]), _matrix(t["clusters"])
        near = t["near"].to_pylist()
        # a pair belongs to the first cluster that both its vectors are in
        earlier = np.where(clusters < cluster, clusters, -1)

        def owned(a, b):
            mine = np.ones(len(a), bool)
            for p in range(earlier.shape[1]):
                for q in range(earlier.shape[1]):
                    mine &= (earlier[a, p] < 0) | (earlier[a, p] != earlier[b, q])
            return mine

        def graph(rows):
            place = {int(v): k for k, v in enumerate(names[rows])}
            return padded([np.array([place[v] for v in near[r] if v in place], np.int64) for r in rows])

        def found(own, other):
            xo = x[other]
            medoid = int((xo @ xo.mean(0)).argmax())
            hits = range_search(x[own], xo, graph(other), medoid, cosine)
            a, b = np.nonzero(hits)
            return own[a], other[b]

        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = found(one, two) if len(one) and len(two) else (np.zeros(0, np.int64),) * 2
        if i != j and len(one) and len(two):
            c, d = found(two, one)
            a, b = np.concatenate([a, d]), np.concatenate([b, c])
        use = a != b
        pair = np.unique(np.minimum(a, b)[use] * len(names) + np.maximum(a, b)[use])
        a, b = pair // max(len(names), 1), pair % max(len(names), 1)
        mine = owned(a, b)
        count = np.bincount(a[mine], size[b[mine]], len(names)) + np.bincount(b[mine], size[a[mine]], len(names))
        partners = np.bincount(a[mine], minlength=len(names)) + np.bincount(b[mine], minlength=len(names))
        some = np.flatnonzero(partners)
        x_, y_ = _forest(a, b, len(names))
        return pa.table(
            {
                "a": pa.array(np.concatenate([names[some], names[x_]]), pa.int64()),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[y_], pa.int64())]),
                "links": pa.array(np.concatenate([count[some].astype(np.int64), np.zeros(len(x_), np.int64)])),
                "partners": pa.array(np.concatenate([partners[some], np.zeros(len(x_), np.int64)])),
            }
        )

    return run


def _true_partners(shared, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        total = np.zeros(len(names), np.int64)
        step = max(1, (1 << 22) // len(q))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                hit = _matrix(b.column("unit")) @ q.T >= cosine
                hit &= b.column("class").to_numpy()[:, None] != names
                total += hit.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["class", "true"])

    return run


def _mark(column: str):
    """The place of a class in the order of the audit, below 2**30."""
    return F.pmod(F.xxhash64(column, F.lit("audit")), F.lit(1 << 30))


def audited(classes: DataFrame, cosine: float) -> tuple[dict[int, int], int]:
    """(how many other classes are partners of each one drawn, by brute force; the mark below which all are drawn)."""
    spark = classes.sparkSession
    n = classes.count()
    truth: dict[int, int] = {}
    begin, wanted = 0, AUDITED
    while True:
        end = int(min(1.0, wanted / max(n, 1)) * (1 << 30))
        drawn = classes.where((_mark("class") >= begin) & (_mark("class") < end)).select("class", "unit").toArrow()
        if drawn.num_rows:
            shared = spark.sparkContext.broadcast((drawn["class"].to_numpy(), _matrix(drawn["unit"])))
            got = classes.mapInArrow(_true_partners(shared, cosine), "class long, true long").groupBy("class").agg(F.sum("true").alias("true")).collect()
            truth |= {r["class"]: r["true"] for r in got}
        if sum(0 < t <= FEW for t in truth.values()) >= LEAST_BAND or wanted >= min(n, MOST_AUDITED):
            return truth, end
        begin, wanted = end, min(4 * wanted, MOST_AUDITED)


def worst_recall(truth: dict[int, int], have: dict[int, int]) -> float | None:
    """The least mean share of partners found over bands of vectors with about as many; None where no vector has any.

    Bands next to each other are taken together only while both are small.
    """
    linked = sorted((t, min(1.0, have.get(c, 0) / t)) for c, t in truth.items() if t)
    bands: list[list[float]] = []
    for _, band in groupby(linked, lambda x: x[0].bit_length()):
        shares = [x for _, x in band]
        if bands and max(len(bands[-1]), len(shares)) < LEAST_BAND:
            bands[-1] += shares
        else:
            bands.append(shares)
    return min((sum(x) / len(x) for x in bands), default=None)


def index_links(classes: DataFrame, cosine: float, overlap: int, block: int = BLOCK) -> DataFrame:
    """(a, b, links, partners) of one pass: rows with b null count a's links and the classes linked, the others join a and b."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = classes.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < share * (1 << 30)).select("class", "unit").toArrow().sort_by("class")
    x = _matrix(drawn["unit"])
    if not len(x):
        return spark.createDataFrame([], "a long, b long, links long, partners long")
    k = max(1, min(-(-n * overlap // block), len(x) // 8))
    near = _assigned(spark.sparkContext.broadcast(centres(x, k)), overlap)
    points = classes.mapInArrow(near, "class long, size long, unit array<double>, clusters array<int>")
    points = stored(points.withColumn("cluster", F.explode("clusters")), "points")
    many = {r["cluster"]: -(-r["count"] // block) for r in points.groupBy("cluster").count().collect()}
    split = F.create_map(*[v for c, b in many.items() if b > 1 for v in (F.lit(c), F.lit(b))]) if any(b > 1 for b in many.values()) else None
    blocks = F.coalesce(split[F.col("cluster")], F.lit(1)) if split is not None else F.lit(1)
    points = points.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int"))
    lists = points.groupBy("cluster", "block").applyInArrow(_built, "class long, near array<long>")
    joined = lists.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    full = points.join(joined, "class")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = full.select("*", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tasks = tasks.select("cluster", "i", "j", "block", "class", "size", "unit", "clusters", "near")
    return tasks.groupBy("cluster", "i", "j").applyInArrow(_searched(cosine), "a long, b long, links long, partners long")


def _brute(shared, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, size, q = shared.value
        step = max(1, (1 << 21) // len(q))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                own = b.column("class").to_numpy()
                r, c = np.nonzero((_matrix(b.column("unit")) @ q.T >= cosine) & (own[:, None] != names))
                count = np.bincount(r, size[c], len(own)).astype(np.int64)
                partners = np.bincount(r, minlength=len(own))
                some = np.flatnonzero(partners)
                node, of = np.unique(np.concatenate([own[r], names[c]]), return_inverse=True)
                x, y = _forest(of[: len(r)], of[len(r) :], len(node))
                none = np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own[some], node[x]]), pa.int64()),
                        pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[y], pa.int64())]),
                        pa.array(np.concatenate([count[some], none])),
                        pa.array(np.concatenate([partners[some], none])),
                    ],
                    ["a", "b", "links", "partners"],
                )

    return run


def all_links(classes: DataFrame, cosine: float) -> DataFrame:
    """What ``index_links`` returns, by brute force over all pairs."""
    spark = classes.sparkSession
    chunks = -(-classes.count() // CHUNK)
    out = None
    for k in range(chunks):
        t = classes.where(F.pmod(F.xxhash64("class", F.lit("chunk")), F.lit(chunks)) == k).select("class", "size", "unit").toArrow()
        if not t.num_rows:
            continue
        shared = spark.sparkContext.broadcast((t["class"].to_numpy(), t["size"].to_numpy(), _matrix(t["unit"])))
        found = stored(classes.mapInArrow(_brute(shared, cosine), "a long, b long, links long, partners long"), "brute")
        shared.unpersist()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "a long, b long, links long, partners long") if out is None else out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, overlap: int = 2, most_overlap: int = 6) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of ``vectors`` (vec_id, embedding).

    Vectors of one length are compared with each other; recall is that of the vectors of a row's length.
    """
    sizes = [r[0] for r in vectors.where(F.size("embedding") > 0).select(F.size("embedding")).distinct().collect()]
    if len(sizes) < 2:
        return _near_of_one_length(vectors, cosine, overlap, most_overlap)
    apart = [vectors.where(F.size("embedding") == s) for s in sorted(sizes)] + [vectors.where(~F.coalesce(F.size("embedding") > 0, F.lit(False)))]
    return reduce(DataFrame.union, [_near_of_one_length(v, cosine, overlap, most_overlap) for v in apart])


def _near_of_one_length(vectors: DataFrame, cosine: float, overlap: int, most_overlap: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(_hashed, "vec_id long, class long, unit array<double>"), "vectors")
    valid = rows.where("class is not null")
    classes = stored(valid.groupBy("class").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.first("unit").alias("unit")), "classes")
    truth, end = audited(classes, cosine)

    def measured(found: DataFrame) -> float | None:
        """Worst recall, 1 where all vectors are audited and none has a partner, None where just none of a sample has."""
        have = found.where((F.col("b").isNull()) & (_mark("a") < end)).groupBy("a").agg(F.sum("partners").alias("n")).collect()
        recall = worst_recall(truth, {r["a"]: r["n"] for r in have})
        return 1.0 if recall is None and end == 1 << 30 else recall

    while True:
        found = stored(index_links(classes, cosine, overlap), "found")
        near_vectors.recall = measured(found)
        if overlap >= most_overlap or (near_vectors.recall or 0) >= RECALL:
            break
        overlap = min(most_overlap, overlap + 2)
    if near_vectors.recall is not None and near_vectors.recall < RECALL:
        found = all_links(classes, cosine)
        near_vectors.recall = measured(found)
        if near_vectors.recall < RECALL:
            raise RuntimeError(f"recall {near_vectors.recall} of a search by brute force")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    label = components(found.where("b is not null").select("a", "b"))
    of_class = classes.select("class", "size", "least").join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    ids = of_class.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = of_class.join(ids, "label").join(links.withColumnRenamed("a", "class"), "class", "left")
    of_class = of_class.select("class", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = valid.join(of_class, "class").select("vec_id", "n_links", "component_id")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).withColumn("kept", kept).withColumn("recall", F.lit(near_vectors.recall).cast("double"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs, where ids are unique and not null; a search that misses a link differs in ``recall`` too.
ORACLE = """
WITH RECURSIVE
vectors AS MATERIALIZED (
  SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT node, b FROM reach JOIN links ON other = a),
of_node AS (
  SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least_other, vec_id)) AS component_id
  FROM embeddings
  LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
  LEFT JOIN (SELECT node, min(other) AS least_other FROM reach GROUP BY node) ON node = vec_id
)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept, CAST(1 AS DOUBLE) AS recall FROM of_node
"""
