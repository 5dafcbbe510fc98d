"""Domains of node columns, clauses that look at one file, and updates of programs over trees."""

import random

import pytest
from pyspark.sql import functions as F

from tuplewright.engine import Engine
from tuplewright.incremental import IncrementalTrees
from tuplewright.plans.analysis import check
from tuplewright.plans.domains import Domains, by_file
from tuplewright.plans.patterns import expand
from tuplewright.plans.syntax import parse
from tuplewright.sources.trees import trees


def domains_of(text, language="java"):
    program = expand(parse(text), language, {"A_PR", "A_ATTR", "A_SLOC"})
    return Domains(program, check(program))


@pytest.mark.parametrize(
    "text, signature, local",
    [
        ("H(c, p) :- PARENT(p, c), PARENT(_, p).", [[0, 1]], {0, 1}),
        ("H(u, t) :- TYPE(u, t), INDEX(u, 0).", [[0], [1]], {0}),
        ("H(t, u) :- TYPE(u, t).", [[0], [1]], {1}),
        ("H(u, v, t) :- TYPE(u, t), TYPE(v, t), PARENT(u, v).", [[0, 1], [2]], {0, 1}),
        ("H(u, v) :- TYPE(u, t), TYPE(v, t).", [[0], [1]], set()),
        ("H(u, v) :- PARENT(u, v). H(u, v) :- TYPE(u, v).", [[0], [1]], {0}),
        ("H(u, v) :- PARENT(u, v). H(v, u) :- TYPE(u, v).", [[0], [1]], {1}),
        ("H(u, t) :- TYPE(u, t), NOT(PARENT(t, u)).", [[0], [1]], {0}),
        ("H(u, t) :- TYPE(u, t), NOT(TYPE(t, t)).", [[0], [1]], set()),
        ("H(a, b) :- PARENT(a, b). H(a, c) :- H(a, b), H(b, c).", [[0, 1]], {0, 1}),
        ("H(a, b) :- PARENT(a, b). H(a, b) :- K(a, b). K(a, b) :- H(a, b), TYPE(a, b).", [[0, 1]], {0, 1}),
        ("H(n, c) :- A_PR(_, n, _, c, _).", [[0, 1]], {0, 1}),
        ("H(n, m) :- A_PR(_, n, _, c, _), A_PR(_, m, _, c, _).", [[0], [1]], set()),
        ("H(n, c) :- A_PR(_, n, _, c, _), A_PR(_, c, _, _, _).", [[0, 1]], {0, 1}),
    ],
)
def test_signatures(text, signature, local):
    d = domains_of(text)
    assert d.signature("H") == signature and d.local["H"] == local


def test_local_clauses():
    d = domains_of(
        'Word(w) :- ID(_, w). Both(1) :- Word("a"), Word("b"). Twice(w) :- ID(n, w), INDEX(n, 1). Pair(1) :- ID(m, "a"), ID(n, "b"). Name("a"). Known(n) :- ID(n, w), Name(w).'
        " Free(w) :- Name(w), NOT(Word(w)). Later(n) :- Known(n), Free(w), ID(n, w)."
    )
    locals_ = {c.heads[0].name: d.is_local(c) for c in d.program.clauses}
    assert {p: locals_[p] for p in ("Word", "Both", "Twice", "Pair", "Known", "Free", "Later")} == {"Word": True, "Both": False, "Twice": True, "Pair": False, "Known": True, "Free": False, "Later": False}
    assert d.derived_by_file() >= {"Word", "Twice", "Known", "ID", "INDEX"} and not d.derived_by_file() & {"Both", "Pair", "Free", "Later", "Name"}
    program, trees = by_file(d.program, check(d.program))
    text = str(program)
    assert trees == {"A_PR"} and "Word_by_file(file, w) :- \n\tID_by_file(file, _, w)." in text and "Both(1) :- \n\tWord_by_file(_, \"a\"),\n\tWord_by_file(_, \"b\")." in text
    check(program)


def test_explained_domains(spark):
    assert "domains of H: {0} {1}" in Engine(spark, language="java").explain("H(u, t) :- TYPE(u, t), A_PR(_, u, _, _, _).")


PROGRAM = """
Fact(n, i) :- $f <: $p(..., $v). :>, ID($p, n), INT($v, i).
Below(a, b) :- PARENT(a, b).  Below(a, c) :- Below(a, b), PARENT(b, c).
Deep(n) :- $r <: $h(...) :- ... . :>, Below($r, x), ID(x, n), NOT(Fact(n, 1)).
Head(n) :- $r <: $h(...) :- ... . :>, ID($h, n), $h <: $p(...) :>.
Missing(n) :- Deep(n), NOT(Head(n)).
Same(n) :- Fact(n, i), Fact(n, j), NEQ(i, j).
Raw(k) :- A_PR(k, n, _, _, _), A_PR(k, m, _, _, _), NEQ(node_to_id(n), node_to_id(m)), SRC(n, 1, _, _, _, _).
"""


@pytest.mark.parametrize("share", [3])
def test_updates_of_trees(spark, tmp_path, share):
    rng = random.Random(share)
    some = lambda: f"P{rng.randrange(9)}({rng.randrange(3)}). Q{rng.randrange(5)}(x) :- P{rng.randrange(9)}(x), NOT(R{rng.randrange(4)}(x))."
    texts = {f: some() for f in range(1, 13)}
    frame = lambda: spark.createDataFrame([(f, f"{f}.rules", t) for f, t in texts.items()], "file_id long, file string, text string")
    kept = IncrementalTrees(spark, PROGRAM, f"{tmp_path}/kept", buckets=4)
    assert {"Fact", "Below", "Head"} <= {p.removesuffix("_by_file") for p in kept.inner.tag_of}
    kept.run(frame())
    changed = rng.sample(range(1, 13), share)
    for i, f in enumerate(changed):
        if i % 2:
            del texts[f]
        else:
            texts[f] = some()
    got = kept.update(frame(), spark.createDataFrame([(f,) for f in changed], "f long"))
    full = Engine(spark).run(PROGRAM, sources=frame())
    for p in ("Fact", "Deep", "Head", "Missing", "Same", "Raw"):
        assert {tuple(r) for r in got[p].collect()} == {tuple(r) for r in full[p].collect()}, p


def test_update_parses_changed_files_alone(spark, tmp_path):
    """One bucket holds all files: those that didn't change keep their rows without being parsed again."""
    frame = lambda texts: spark.createDataFrame([(f, f"{f}.rules", t) for f, t in texts.items()], "file_id long, file string, text string")
    kept = IncrementalTrees(spark, "Word(f, w) :- ID(n, w), BIND(f, bshru(node_to_id(n), 32)).", f"{tmp_path}/kept", buckets=1)
    kept.run(frame({1: "A(1).", 2: "B(1).", 3: "C(1)."}))
    got = kept.update(frame({1: "no program", 2: "D(1).", 4: "E(1)."}), spark.createDataFrame([(2,), (3,), (4,)], "f int"))
    assert {tuple(r) for r in got["Word"].collect()} == {(1, "A"), (2, "D"), (4, "E")}
    got = kept.update(frame({}), spark.createDataFrame([(1,), (2,), (4,)], "f int"))
    assert got["Word"].count() == 0


def test_sources_of_one_partition_are_dealt_out(spark):
    texts = spark.range(64).selectExpr("id file_id", "concat(id, '.rules') file", "concat('A(', id, ').') text").coalesce(1)
    found = trees(texts)
    assert found["A_PR"].select(F.input_file_name()).distinct().count() > 1
    assert found["A_PR"].where("c0 = 'NUMERAL'").selectExpr("cast(c4 as long)").toDF("n").distinct().count() == 64


def test_trees_without_places(spark):
    texts = spark.createDataFrame([(1, "a", "A(1, _). B(x) :- A(x, x).")], "file_id long, file string, text string")
    whole, bare = trees(texts), trees(texts, False)
    assert set(whole) == {"A_PR", "A_SLOC"} and set(bare) == {"A_PR"}
    assert sorted(whole["A_PR"].collect()) == sorted(bare["A_PR"].collect())
