import itertools

import pytest

from tuplewright.engine import Engine
from tuplewright.plans.emit import emit
from tuplewright.plans.objects import KINDS, Tree, read_program, readings, supertypes
from tuplewright.plans.patterns import ambiguous, expand
from tuplewright.plans.syntax import ProgramError, parse
from tuplewright.sources.trees import FileIds, tree_rows

PROGRAM = """
Shop(1, "mill", 'Town).  # a comment
Town(2), River(2, 3).
Near(x, y) :- Shop(x, _, _), River(x, y), LT(x, y + 1).
Far(x) :- River(x, y), NOT(Near(x, y)), BIND(z, mul(add(x, 2), y)), GT(z, 4).
Lone() :- NOT(Town(_)).
"""


def run(spark, program, text=PROGRAM):
    sources = spark.createDataFrame([(1, "town.rules", text)], "file_id long, file string, text string")
    return {p: {tuple(r) for r in df.collect()} for p, df in Engine(spark).run(program, sources=sources).items()}


# Brute force: the subtrees that a pattern's tree fits, by walking both.


def walk(t):
    yield t
    for c in t.children:
        yield from walk(c)


def fits(p, t, held, declared=None):
    """All ways to extend ``held`` (names to subtrees) so that the pattern ``p`` fits the subtree ``t``."""
    if p.hole:
        if p.kind != declared and p.kind not in supertypes(t.kind):
            return
        if held.get(p.hole, t) is t:
            yield {**held, p.hole: t}
        return
    if p.kind == "List":
        yield from lists(p.children, t.children, held, declared)
        return
    if p.kind != t.kind or (p.tokens and p.tokens != t.tokens):
        return
    ways = [held]
    for a, b, kind in zip(p.children, t.children, KINDS[p.kind][1]):
        if not (a.kind == "List" and all(x.gap for x in a.children)):
            ways = [w for h in ways for w in fits(a, b, h, kind.rstrip("*"))]
    yield from ways


def lists(ps, ts, held, declared):
    wanted = [i for i, p in enumerate(ps) if not p.gap]
    for places in itertools.product(range(len(ts)), repeat=len(wanted)):
        at = dict(zip(wanted, places))
        ok = all(
            at[i] == i if not any(x.gap for x in ps[:i]) else i - 1 not in at or at[i] == at[i - 1] + 1 for i in wanted
        ) and (ps[-1].gap or at[len(ps) - 1] == len(ts) - 1)
        ways = [held] if ok else []
        for i in wanted:
            ways = [w for h in ways for w in fits(ps[i], ts[at[i]], h, declared)]
        yield from ways


def numbers(tree):
    """Numbers of all nodes, by identity, as the rows have them."""
    out, count = {}, 1 << 32

    def go(t):
        nonlocal count
        for c in t.children:
            go(c)
        count += 1
        out[id(t)] = count
        count += len(t.tokens)

    go(tree)
    return out


PATTERNS = [
    "$p($a), $q($b, $c).", "$p($a, ..., $b).", "$p(..., $a, $b, ...).", "... :- ..., $p(...), $q(...), ... .", "... :- $p(...), ... .", "... :- ..., NOT($p(..., $x)), ... .",
    "... :- ..., LT($x, $e), ... .", "$a + $b", "mul(...)", "$f", "River(x, $y)", "BIND($v, $e)", "Lone()", "$p(..., \"mill\", ...)", "Lone() :- $l.", "... :- ..., $l, GT($z, 4).",
]


def test_patterns_against_brute_force(spark):
    tree = read_program(PROGRAM)
    number = numbers(tree)
    program, want = [], {}
    for i, text in enumerate(PATTERNS):
        holes = sorted({x.hole for r in readings(text) for x in walk(r) if x.hole})
        program.append(f"P{i}({', '.join(['r', *holes])}) :- r <: {text} :>.")
        want[f"P{i}"] = {(number[id(t)], *(number[id(w[h])] for h in holes)) for r in readings(text) for t in walk(tree) if t.kind != "List" for w in fits(r, t, {})}
    got = run(spark, "\n".join(program))
    for i, text in enumerate(PATTERNS):
        assert got[f"P{i}"] == want[f"P{i}"], text
        assert want[f"P{i}"], text


def test_rows_of_a_tree():
    rows = list(tree_rows(read_program('A(1, _).'), 7 << 32, "a"))
    base = 7 << 32
    edges = {(k, n - base, i, c - base if c > 0 else c, t) for k, n, i, c, t, *_ in rows if k}
    assert edges == {
        ("PRED_ID", 2, 0, 0, "A"), ("PredicateSymbol", 1, 0, 2, ""), ("NUMERAL", 4, 0, 0, "1"), ("IntConstant", 3, 0, 4, ""), ("Wildcard", 5, -1, -1, ""),
        ("List", 6, 0, 3, ""), ("List", 6, 1, 5, ""), ("Atom", 7, 0, 1, ""), ("Atom", 7, 1, 6, ""), ("List", 8, 0, 7, ""), ("Fact", 9, 0, 8, ""), ("List", 10, 0, 9, ""), ("Program", 11, 0, 10, ""),
    }
    assert (None, base + 7, 1, 1, "a", 1, 7) in rows


def test_context_predicates(spark):
    got = run(
        spark,
        """N(s) :- ID(_, s). I(v) :- INT(_, v). S(v) :- STR(_, v). R(v) :- REF(_, v). L(l, c, f) :- $p <: Lone() :- ... . :>, SRC($p, l, c, _, _, f).
        At(i, s) :- INDEX(n, i), ID(n, s). Up(k) :- <: Town(_) :>, A_PR(k, _, _, _, _), A_SUPERTYPE(k, "Constant"). C(s) :- PARENT(a, b), ID(b, s), A_PR("Functor", a, _, _, _). T(k) :- AST(k, _, _, _, "mill").""",
    )
    assert got["I"] == {(1,), (2,), (3,), (4,)} and got["S"] == {("mill",)} and got["R"] == {("Town",)}
    assert {("add",), ("mul",), ("x",), ("Near",), ("BIND",)} <= got["N"] and got["L"] == {(6, 1, "town.rules")}
    assert {(0, "x"), (1, "y")} <= got["At"] and got["Up"] == {("IntConstant",), ("StringConstant",), ("PredicateRef",)}
    assert got["C"] == {("add",), ("mul",)} and got["T"] == {("STRING",)}


def test_context_predicates_of_java_trees(spark):
    tree = spark.createDataFrame([("Modifier", 1, 0, 2, ""), ("ID", 2, 0, 0, "public"), ("BreakStmt", 3, 0, 4, ""), ("Label", 4, 0, 0, "out"), ("List", 5, 0, 1, "")], "a string, b long, c long, d long, e string")
    kinds = spark.createDataFrame([("type", 1, 3), ("decl", 1, 5)], "a string, b long, c long")
    origin = spark.createDataFrame([(1, 2)], "a long, b long")
    out = Engine(spark, language="java").run(
        "M(s) :- MOD(_, s). L(s) :- LABEL(_, s). I(s) :- ID(_, s). T(a, b) :- TYPE(a, b). D(b) :- DECL(_, b). G(b) :- GENERIC(_, b). P(x, y) :- PROVENANCE(x, y). B(s) :- BOOLEAN(_, s).",
        {"A_PR": tree, "A_ATTR": kinds, "A_PROV": origin},
    )
    got = {p: {tuple(r) for r in out[p].collect()} for p in "MLITDGPB"}
    assert got == {"M": {("public",)}, "L": {("out",)}, "I": {("public",)}, "T": {(1, 3)}, "D": {(5,)}, "G": set(), "P": {(1, 2)}, "B": set()}


def test_own_relations_keep_their_names(spark):
    table = spark.createDataFrame([(1, "a")], "n long, s string")
    assert {tuple(r) for r in Engine(spark).run("Q(s) :- ID(_, s).", {"ID": table})["Q"].collect()} == {("a",)}
    assert run(spark, "INDEX(9, 9). Q(i) :- INDEX(i, i), <: Lone() :>.")["Q"] == {(9,)}


def test_negated_patterns_signs_and_escapes(spark):
    got = run(spark, "Rule($h) :- <: $h(...) :- ... . :>. Q(s) :- Rule(`h), NOT(<: `h(...) :- ..., NOT($_), ... . :>), ID($h, s).")
    assert got["Q"] == {("Near",)}
    text = "Warn(p) :- <: $p(...) . :>."
    assert run(spark, r"Q(n) :- <: Warn($x) :- <: $p(...) . \:>. :>, ID($x, n).", text)["Q"] == {("p",)}
    assert str(parse(r"Q($a) :- $a <: P(...) \:> :>.").clauses[0].body[0]) == r"$a <: P(...) \:> :>"


def test_readings_and_faults(spark):
    assert [t.kind for t in readings("$x")] == ["CommonClause", "CommonLiteral", "Expr"] and len(readings("$a + 1")) == 1
    assert ambiguous(parse("Q($x) :- <: $x :>.")) == ["The pattern <: $x :> has 3 readings."]
    assert "has 3 readings" in Engine(spark).explain("Q($x) :- <: $x :>.")
    for bad in ("P(", "P(1) :-", "", "a.", "NOT(NOT"):
        with pytest.raises(ProgramError):
            expand(parse(f"Q(1) :- <: {bad} :>."))
    with pytest.raises(ProgramError):
        Engine(spark).run("<: P(...) :>.")
    with pytest.raises(ProgramError):
        Engine(spark).run("Q($x) :- NOT(<: P($x) :>).")
    with pytest.raises(ProgramError):
        Engine(spark, language="cobol")
    with pytest.raises(Exception, match="bad.rules"):
        sources = spark.createDataFrame([(1, "bad.rules", "A(")], "file_id long, file string, text string")
        Engine(spark).run("Q($x) :- <: $x(...) :>.", sources=sources)


def test_null_texts_empty_tables_and_emission(spark):
    sources = spark.createDataFrame([(1, "a", None)], "file_id long, file string, text string")
    for df in (sources, sources.where("false")):
        assert Engine(spark).run("Q($x) :- <: $x(...) :>.", sources=df)["Q"].count() == 0
    text = emit("Q($x, x) :- <: $x(...) . :>, ID($x, x).")
    assert ".decl A_PR(" in text and "$" not in text and "Q(w_x, v_x)" in text


def test_files_and_their_ids(spark, tmp_path):
    for name, text in (("a/x y.rules", "A(1)."), ("x y.rules", "B(1)."), ("c+d.rules", "C(1)."), ("gone.rules", "D(1).")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    kept = str(tmp_path / "ids.json")
    program = "Q(s, f) :- <: $p(...) . :>, ID($p, s), BIND(f, bshru(node_to_id($p), 32))."
    names = {str(tmp_path / n): "A" for n in ("x y.rules", "a/x y.rules")}
    first = {tuple(r) for r in Engine(spark, ids=FileIds(kept)).run(program, sources=names)["Q"].collect()}
    assert first == {("A", 1), ("B", 2)}
    more = {**names, f"file://{tmp_path}/c+d.rules": "M", str(tmp_path / "gone.rules"): "D"}
    assert {tuple(r) for r in Engine(spark, ids=FileIds(kept)).run(program, sources=more)["Q"].collect()} == first | {("C", 3)}
    with pytest.raises(ProgramError):
        Engine(spark).run(program, sources={"x": "Z"})


def test_tree_of_a_block():
    tree = read_program("analyze('P) { A(1). } B(2).")
    assert [c.kind for c in tree.children[0].children] == ["AnalyzeBlock", "Fact"]
    assert readings("analyze($p, \"java\") { $c }")[0].children[2].children[0].hole == "$c"
    assert isinstance(tree, Tree)
