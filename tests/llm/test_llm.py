"""Each operator against brute force on small fixtures with nulls, empty and repeated texts, ties and clashing extra columns."""

import random
import zlib
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tuplewright.llm import op1_decontaminate, op2_lm, op3_counts, op4_packing, op5_embeddings, op6_quality, op7_chat, op8_langid, op9_secrets, op10_jaccard, trigrams
from tuplewright.llm.textkeys import pack_keys, pack_numbers, shingle_keys, unpack_keys, unpack_numbers, word_keys

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, class long, label string"


def documents(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "of", "the", "and", "é", "ñandú", "x1", "!!", "delta"]
    texts = [None, "", " \n\t", "one", "a b c d", "A B C D"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    for b in base:
        w = b.split()
        texts += [b, b, b + " tail", " ".join(w[:30] + ["edit"] + w[31:]), " ".join(w[:20]), "lead " * 30 + b]
    texts.append("long" * 3000 + " " + "z " * 5000)
    rows = [(i, t, ["en", "fr", None][i % 3], "src", None if t is None else len(t), 1, 2, "x") for i, t in enumerate(texts)]
    rows += [rows[8], (None, "null id text here is fine", "en", None, None, 1, 2, "x"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text):
    return (text or "").encode().lower().split()


def test_word_keys_and_codecs():
    texts = ["Hello  wOrld\x0bfoo", " é É\xa0a", "", None, "hello world FOO", "q" * 300_000]
    keys, counts = word_keys(pa.array(texts))
    assert counts.tolist() == [len(words_of(t)) for t in texts]
    assert keys[:3].tolist() == keys[5:8].tolist()
    s, of, _ = shingle_keys(keys, counts, 5)
    assert of.tolist() == [0, 1, 4, 5] and s[0] == s[2]
    k = np.sort(np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64) * np.uint64(2))
    assert (unpack_keys(pack_keys(k)) == k).all() and (unpack_numbers(pack_numbers(k)) == k).all()
    assert unpack_numbers(pack_numbers(np.zeros(0, np.uint64))).tolist() == []


def test_decontamination(spark):
    rng = random.Random(1)
    item = " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    w = item.split()
    edited = " ".join("edit" if i % 8 == 3 else x for i, x in enumerate(w))
    filler = lambda n: " ".join(f"f{rng.randrange(500)}" for _ in range(n))
    texts = [filler(50) + " " + item + " " + filler(9), filler(30) + " " + edited, filler(80), None, "", item, item, " ".join(w[:5])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.ratio for r in op1_decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {(0, 7), (1, 7), (5, 7), (6, 7)} and got[(0, 7)] == 1 and got[(1, 7)] < 1
    clean = op1_decontaminate.without_leaks(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 3, 4, 7] and clean.columns == docs.columns
    assert op1_decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert op1_decontaminate.leaks(docs, bench.limit(0)).count() == 0


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (1 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_decontamination_of_a_hot_item(spark):
    item = [f"w{k}" for k in range(12)]
    edited = ["x" if k in (2, 5) else w for k, w in enumerate(item)]
    texts = [" ".join(item)] * 40 + ["other"] * 79 + [" ".join(edited)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in op1_decontaminate.leaks(docs, bench).collect()}
    assert got == {i: 12 for i in range(40)} | {119: 8}


def test_decontamination_finds_every_alignment(spark, monkeypatch):
    monkeypatch.setattr(op1_decontaminate, "HITS", 50)
    rng = random.Random(3)
    word = lambda: f"w{min(rng.randrange(60), rng.randrange(60))}"
    items = [[word() for _ in range(rng.randrange(3, 25))] for _ in range(12)] + [["alone"]]
    texts = [["z"] * 200 + ["alone"] + ["z"] * 90]
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(60))]
        for w in rng.choice(items) * rng.randrange(1, 3):
            t += rng.choice([[w], [w], [w], [w, word()], [word()], []])
        texts.append(t + ["z"] * rng.randrange(40) + [word() for _ in range(rng.randrange(60))])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in op1_decontaminate.leaks(docs, bench).collect()}
    scores = {(d, i): smith_waterman(item, t) for d, t in enumerate(texts) for i, item in enumerate(items)}
    assert got == {k: v for k, v in scores.items() if v >= 0.4 * len(items[k[1]])}


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        assert op1_decontaminate.align(a, b)[0] == smith_waterman(a, b)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, order):
    docs = documents(spark)
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    m = 10.0
    got = op2_lm.score_texts(docs, train, order, m).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    from collections import Counter

    c = Counter()
    for r in rows:
        if r.doc_id is not None and r.doc_id % 3 != 0:
            seq = ["<s>", *words_of(r.text), "</s>"]
            c.update(tuple(seq[i : i + n]) for n in range(1, order + 1) for i in range(len(seq) - n + 1))
    words = {g[0]: v for g, v in c.items() if len(g) == 1 and g != ("<s>",)}
    N, V = sum(words.values()), len(words)
    once, twice = (sum(v == k for v in words.values()) for k in (1, 2))
    D = once / (once + 2 * twice) if once and twice else 0.5

    def p(h, w):
        if not h:
            return (words[w] - D) / N if w in words else D * V / N
        if not c[h]:
            return p(h[1:], w)
        return (c[(*h, w)] + m * p(h[1:], w)) / (c[h] + m)

    want = {}
    for r in rows:
        seq = ["<s>", *words_of(r.text), "</s>"]
        score = sum(log10(p(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        base = sum(log10((words.get(w, 0) + 1) / (N + V + 1)) for w in seq[1:])
        want.setdefault(r.doc_id, []).append((len(seq) - 1, sum(w in words for w in seq[1:]), base, score))
    for r in got:
        assert r.train_tokens == N
        assert any(x[:2] == (r.n_tokens, r.n_known) and np.allclose(x[2:], (r.base_score, r.score)) for x in want[r.doc_id]), r
    assert abs(sum(p(("<s>",)[: order - 1], w) for w in [*words, "never seen"]) - 1) < 1e-9
    assert op2_lm.score_texts(docs.limit(0), train).count() == 0


def test_token_counts(spark):
    docs = documents(spark)
    trees = op3_counts.build(docs, leaf=4)
    rng = random.Random(4)
    edits = [(i % 30, s, rng.randrange(400), rng.randrange(500), rng.choice(["", "  x", "don't", "\n\n", None, "é" * 50])) for i in range(60) for s in range(2)]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start int, stop int, new string")
    got = op3_counts.apply_edits(trees, table, leaf=4).collect()
    encode = op3_counts.counter().encoding.encode_ordinary
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, _, a, b, new in sorted(edits, key=lambda e: (e[0], e[1], e[2], e[3], e[4] is not None, e[4] or "")):
        t = want[i]
        a = min(a, len(t))
        b = max(a, min(b, len(t)))
        want[i] = t[:a] + (new or "") + t[b:]
    for r in got:
        assert r.n_tokens == len(encode(r.text))
        if r.doc_id is not None:
            assert r.text == want[r.doc_id]


def test_rebuilding_counts_as_reencoded():
    count = op3_counts.counter()
    t = op3_counts.CountedText("a few words " * 40, count, 4)
    t.edit(5, 5, "x")
    small = t.reencoded
    assert 0 < small < len(t.text)
    t.edit(100, 100, " grown" * 500)
    assert t.reencoded - small >= len(t.text) + 3000
    empty = op3_counts.CountedText("", count, 4)
    empty.edit(0, 0, "some new text")
    assert empty.reencoded == 2 * 13 and empty.tokens == len(count.encoding.encode_ordinary("some new text"))


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(spark)
    got = op4_packing.pack_texts(docs, length=64, end_id=1).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 64)):
            x = np.array(ids[s : s + 64], "<u4")
            want.append((r.doc_id if r.doc_id is not None else -1, k, s, len(x), zlib.crc32(x.tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    full = {}
    for r in got:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(full) <= 1.05 * sum(r.length for r in got) / 64 + 2
    assert op4_packing.pack_texts(docs.limit(0)).count() == 0


def test_packing_of_repeated_rows(spark):
    pieces = spark.range(0, 3000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(30).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = op4_packing.pack(pieces, 64, shard=100).collect()
    shards = {}
    for r in got:
        shards.setdefault(r.sequence_id >> 32, []).append(r)
    assert len(got) == 3000 and len(shards) == 30 and max(map(len, shards.values())) < 200


def test_sum_of_squares():
    """Each choice against the sums themselves."""
    rng = random.Random(3)
    sizes = np.array([rng.randrange(1, 10) for _ in range(200)], np.int64)
    sequence, offset = op4_packing.sum_of_squares(sizes, 10)
    open_, counts = {}, [0] * 11
    for s, q, o in zip(sizes.tolist(), sequence.tolist(), offset.tolist()):
        def total(gap):  # after the piece goes to a bin of that gap, 10 being a new one
            c = counts.copy()
            if gap < 10:
                c[gap] -= 1
            c[gap - s] += 1
            return sum(x * x for x in c[1:10])

        fits = [g for g in range(s, 11) if g == 10 or counts[g]]
        gap = open_.get(q, 10)
        assert o == 10 - gap and total(gap) == min(map(total, fits))
        if gap < 10:
            counts[gap] -= 1
        open_[q] = gap - s
        counts[gap - s] += 1


def test_word_ids_of_odd_words():
    import public_tokenizers

    ids = op4_packing.word_ids(public_tokenizers.path("word_bpe_49k.json"))
    text = "Don't STOP, it's ÀÉÎ ß ünïcode... <|endoftext|> 3rd?! ñ́ Σίσυφος ʼn İ a" + "b" * 70 + " 中文  x \x1cy é '' 's"
    data = np.frombuffer(text.encode(), np.uint8)
    from tuplewright.llm.textkeys import word_spans
    from tuplewright.llm.wordbpe import ragged

    keys, _, a, b = word_spans(data, np.array([0, len(data)]))
    start, size = ids.find(keys, data, a, b)
    assert ids.flat[ragged(start, size)].tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 16))
    for i in range(0, 60):
        x[i + 60] = x[i % 7] + rng.normal(size=16) * 0.1
    rows = [(i, v.astype(np.float32).tolist(), i) for i, v in enumerate(x)]
    rows += [(150, rows[0][1], 0), (151, [2 * v for v in rows[0][1]], 0), (152, None, 0), (153, [0.0] * 16, 0), (154, [float("nan")] * 16, 0), (155, [None] * 16, 0), (156, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, class int")
    got = {r.vec_id: r for r in op5_embeddings.near_vectors(df).collect()}
    v = {i: np.array(e, float) for i, e, _ in rows if i < 152}
    u = {i: e / np.linalg.norm(e) for i, e in v.items()}
    pairs = [(a, b) for a in u for b in u if a < b and u[a] @ u[b] >= 0.95]
    want = components(pairs, range(157))
    n = np.zeros(157, int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[i].n_links for i in range(157)] == n.tolist()
    assert all(got[i].kept == (want[i] == i) for i in got)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows]), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}))
    assert sorted(con.sql(op5_embeddings.ORACLE).fetchall()) == sorted(tuple(r) for r in got.values())


def test_vectors_of_unequal_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [3.0, 0.0, 0.0]), (5, [1.0, 0.0]), (6, None), (7, []), (8, [0.0, 1.0, None])]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {r.vec_id: (r.n_links, r.component_id) for r in op5_embeddings.near_vectors(df).collect()}
        assert got == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3), 6: (0, 6), 7: (0, 7), 8: (0, 8)}


def test_hot_vectors_do_not_outweigh_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 32))
    x[:60] = x[0] + rng.normal(size=(60, 32)) * 0.03
    x[90:120] = x[60:90] + rng.normal(size=(30, 32)) * 0.03
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole, overlaps = op5_embeddings.index_links, []

    def lossy(classes, cosine, overlap):
        overlaps.append(overlap)
        found = whole(classes, cosine, overlap)
        return found.where("b is not null or links > 3") if overlap == 2 else found

    monkeypatch.setattr(op5_embeddings, "index_links", lossy)
    got = {r.vec_id: r.n_links for r in op5_embeddings.near_vectors(df).collect()}
    assert [got[i] for i in range(120)] == [59] * 60 + [1] * 60 and overlaps == [2, 4]


def test_low_recall_falls_back_on_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 16))
    x[30:60] = x[:30] + rng.normal(size=(30, 16)) * 0.03
    x[60:75] = x[0] + rng.normal(size=(15, 16)) * 0.03
    x[75:80] = x[1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(op5_embeddings, "index_links", lambda classes, *_: spark.createDataFrame([], "a long, b long, links long, partners long"))
    monkeypatch.setattr(op5_embeddings, "CHUNK", 20, raising=False)
    got = {r.vec_id: r for r in op5_embeddings.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    want = components([(a, b) for a, b in np.argwhere(near).tolist() if a < b], range(90))
    assert [got[i].n_links for i in range(90)] == (near.sum(1) - 1).tolist()
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.recall == 1 for r in got.values())


def test_worst_recall():
    worst = op5_embeddings.worst_recall
    assert worst({}, {}) is None and worst({1: 0}, {}) is None
    assert worst({i: 1000 for i in range(85)} | {100 + i: 1 for i in range(10)}, {i: 1000 for i in range(85)} | {100 + i: 1 for i in range(5)}) == 0.5


def test_quality(spark):
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op6_quality.score(good, labels).join(labels, "doc_id").toPandas()
    y = (got.quality == 1) & (got.toxic == 0)
    assert (got.kept == y).mean() > 0.9 and got.kept[y].mean() > 0.95
    unseen = F.crc32(F.col("doc_id").cast("string")) % 4 == 0  # labels that the classifier doesn't get
    more, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = op6_quality.score(more, marks.where(~unseen)).join(marks.where(unseen), "doc_id").toPandas()
    y = (got.quality == 1) & (got.toxic == 0)
    print("held out:", len(got), (got.kept == y).mean(), got.kept[y].mean(), got.kept[got.toxic == 1].mean(), got.kept[got.quality == 0].mean())
    assert len(got) > 500 and (got.kept == y).mean() > 0.95 and got.kept[y].mean() > 0.98
    twice = good.union(good.limit(300).withColumn("text", F.concat("text", F.lit(" once more"))))
    one, two = ({r.doc_id: r.score for r in op6_quality.score(x, labels).where("doc_id < 50").collect()} for x in (twice, twice.repartition(7)))
    assert one.keys() == two.keys()
    docs = documents(spark)
    kept = op6_quality.wanted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert op6_quality.score(docs, labels.limit(0)).where("kept").count() == docs.count()
    assert op6_quality.wanted(docs.limit(0), labels).count() == 0


def test_chat(spark):
    chats = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "a", 6: "x"}
    rows = [(c, t, ["user", "assistant"][t % 2], m, 1) for c, text in chats.items() for t, m in enumerate(text)]
    rows += [(None, 1, "assistant", "q", 2), (10, 0, "user", "a", 1), (10, 1, "assistant", "q", 2)]
    rows += [(7, 0, None, None, 1), (8, 0, None, "", 1), (None, 0, "user", "a", 1), (9, 3, "user", "q", 1), (9, 3, "user", "q", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in op7_chat.maximal_chats(df).collect()}
    assert got == {2: (3, 2), 4: (3, 1), 6: (1, 1), 7: (1, 1), 8: (1, 1), 9: (2, 1), 10: (2, 2)}
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64"}))
    assert sorted(map(tuple, op7_chat.maximal_chats(df).collect())) == sorted(con.sql(op7_chat.ORACLE).fetchall())
    nobody = spark.createDataFrame([(None, 0, "user", "hi")] * 2, "conv_id long, turn long, role string, text string")
    assert [tuple(r)[:3] for r in op7_chat.maximal_chats(nobody).collect()] == [(None, 2, 1)]
    assert op7_chat.maximal_chats(df.limit(0)).count() == 0


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op8_langid.predict(docs, F.col("doc_id") % 3 != 1).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    odd = op8_langid.predict(documents(spark), F.coalesce(F.col("doc_id") % 3 != 1, F.lit(False))).toPandas()
    assert len(odd) == documents(spark).count() and odd.score.between(0, 1).all()
    assert (odd.lang_pred[odd.doc_id.isin([0, 1, 2])] == "und").all()
    assert op8_langid.predict(docs.limit(0), F.lit(True)).count() == 0


def test_forward_sums_all_segmentations():
    class Tiny(op8_langid.Pieces):
        def __init__(self):
            super().__init__()

    pieces = Tiny()
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces.pieces)), 1).T
    value = dict(zip(pieces.pieces, p[:, 0]))

    def brute(w):
        return 1.0 if not w else sum(value[w[:k]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in value)

    words = [b" the", b" ing", b" qz", b" a"]
    _, total = op8_langid.forward(*pieces.lattice(words), p)
    assert np.allclose(total[:, 0], [np.log(brute(w)) for w in words])


def test_long_words_count_in_learning():
    pieces = op8_langid.Pieces()
    at = {p: i for i, p in enumerate(pieces.pieces)}
    rng = random.Random(9)
    words = [b" " + "".join(rng.choice(["the", "ing", "qz", "ñ"]) for _ in range(n)).encode() for n in (2, 11, 14, 30, 300)]
    counts = np.array([3, 1, 2, 1, 1])
    p = op8_langid.learn(pieces, words, counts, 0)
    got = op8_langid.learn(pieces, words, counts, 1)
    want = np.full(len(p), op8_langid.SMOOTHING)
    for w, n in zip(words, counts):
        edges = [(a, b, at[w[a:b]]) for a in range(len(w)) for b in range(a + 1, min(len(w), a + pieces.longest) + 1) if w[a:b] in at]
        alpha, beta = np.zeros(len(w) + 1, np.longdouble), np.zeros(len(w) + 1, np.longdouble)
        alpha[0] = beta[-1] = 1
        for a, b, i in edges:
            alpha[b] += alpha[a] * p[i]
        for a, b, i in sorted(edges, key=lambda e: -e[1]):
            beta[a] += beta[b] * p[i]
        for a, b, i in edges:
            want[i] += float(n * alpha[a] * p[i] * beta[b] / alpha[-1])
    assert np.allclose(got, want / want.sum(), rtol=1e-6)


def test_secrets(spark):
    texts = ["password = hunter22 é", "PassWD:'abc'", "x" * 9 + " token: secret=abcdefgh", "AKIA" + "A" * 16 + " " + "f" * 24, "é\U0001f600 api_key=\"AbCdEf12\"", None, "", "deadbeef" * 3]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = op9_secrets.report(op9_secrets.scan(df))
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(op9_secrets.ORACLE).fetchall()
    shown = lambda rs: sorted((tuple(-1 if v is None else v for v in r) for r in rs), key=str)
    assert shown(tuple(r) for r in got.collect()) == shown(want)
    cut = {r.doc_id: r.text for r in op9_secrets.redacted(df).collect() if r.doc_id is not None}
    assert cut[0] == "[secret:assign] é" and cut[3] == "[secret:access] [secret:hex]" and cut[5] is None
    odd = df.withColumn("spans", F.lit("mine")).withColumn("a.b", F.lit(2)).withColumn("row", F.lit("r")).withColumn("n_chars", F.length("text"))
    clean = op9_secrets.redacted(odd)
    assert clean.dtypes == odd.dtypes
    assert all((r.key, r.spans, r["a.b"], r.row) == (1, "mine", 2, "r") and (r.text is None or r.n_chars == len(r.text)) for r in clean.collect())
    assert op9_secrets.scan(df.limit(0)).count() == 0


def test_sets_of_a_query():
    q = ("and", ["abc", ("or", ["def", ("and", ["ghi", "jkl"])]), "xyz"])
    assert set(trigrams.sets_of(q)) == {frozenset(["abc", "xyz", "def"]), frozenset(["abc", "xyz", "ghi", "jkl"])}
    assert frozenset(["pas", "ass", "ssw", "swd"]) in trigrams.sets_of(trigrams.query_of("passw(or)?d")) and trigrams.sets_of("abc") == [frozenset(["abc"])]


def test_trigram_queries():
    q = trigrams.query_of(op9_secrets.ASSIGN)
    assert trigrams.holds(q, lambda t: t in "my api-key") is False and trigrams.holds(q, lambda t: t in "the api_key") is True
    assert trigrams.query_of(r"[0-9a-f]{24,}") is True
    assert trigrams.query_of(r"AKIA[A-Z]{3,}") == ("and", ["aki", "kia"])


def test_jaccard(spark):
    docs = documents(spark)
    got = op10_jaccard.near_duplicates(docs).collect()
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    sets = {}
    for r in rows:
        w = words_of(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(pairs, sets)
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r.doc_id for r in rows], "text": pa.array([r.text for r in rows], pa.string())}))
    assert sorted(con.sql(op10_jaccard.ORACLE).fetchall()) == sorted({tuple(r) for r in got if r.doc_id is not None})
    kept = op10_jaccard.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want.values()))
    assert op10_jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_subsets_find_all_small_links():
    rng = random.Random(0)
    for _ in range(400):
        a = set(rng.sample(range(14), rng.randrange(1, 12)))
        b = set(rng.sample(range(14), rng.randrange(1, 12)))
        if 100 * len(a & b) >= 80 * len(a | b):
            keys = [{int(k) for q in op10_jaccard.subset_sizes(len(s), 12, 80) for k in op10_jaccard._subsets(np.array(sorted(s), np.uint64), q)} for s in (a, b)]
            assert keys[0] & keys[1]
