"""Queries with patterns over programs, and the SQL that gives the same rows.

Each part is a program of its own, made of its row:

    Part(17, "Brand#12", 8).
    Big(x) :- Part(x, _, s), GT(s, 8 * 2 + 17), NOT(Sold(x, 'Part)).

where the last literal is there for even sizes only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine

PROGRAM = r"""concat('Part(', p_partkey, ', "', translate(p_brand, '"', '_'), '", ', p_size, ').\nBig(x) :- Part(x, _, s), GT(s, ', p_size, ' * 2 + ', p_partkey, ')', if(p_size % 2 = 0, ', NOT(Sold(x, \'Part))', ''), '.\n')"""


@dataclass(frozen=True)
class CodeQuery:
    program: str
    result: str
    names: tuple[str, ...]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS file_id", "concat(p_partkey, '.rules') AS file", f"{PROGRAM} AS text")
        return Engine(spark).run(self.program, sources=texts, want={self.result})[self.result].toDF(*self.names)


def _file(node: str, name: str = "f") -> str:
    return f"BIND({name}, bshru(node_to_id({node}), 32))"


CODE: dict[str, CodeQuery] = {
    "pattern_fact": CodeQuery(
        f"Last(f, i, v) :- <: $p(..., $v). :>, INDEX($v, i), INT($v, v), {_file('$p')}.",
        "Last",
        ("f", "i", "v"),
        "SELECT p_partkey AS f, 2::BIGINT AS i, p_size::BIGINT AS v FROM part",
    ),
    "pattern_exact_list": CodeQuery(
        f"One(f, s) :- <: $p($a, $b, $c). :>, STR($b, s), {_file('$p')}. One(f, \"none\") :- <: $p($a, $b). :>, {_file('$p')}.",
        "One",
        ("f", "s"),
        "SELECT p_partkey AS f, p_brand AS s FROM part",
    ),
    "pattern_member": CodeQuery(
        f"Uses(f, n) :- <: ... :- ..., $p(...), ... . :>, ID($p, n), {_file('$p')}.",
        "Uses",
        ("f", "n"),
        "SELECT p_partkey AS f, 'Part' AS n FROM part",
    ),
    "pattern_next": CodeQuery(
        f"Pair(f, v, w) :- <: ... :- ..., Part(..., $x), GT($y, $e), ... . :>, ID($x, v), ID($y, w), {_file('$x')}.",
        "Pair",
        ("f", "v", "w"),
        "SELECT p_partkey AS f, 's' AS v, 's' AS w FROM part",
    ),
    "pattern_negation": CodeQuery(
        f"Sells(f, n) :- <: ... :- ..., NOT($p(..., $r)). :>, ID($p, n), REF($r, q), {_file('$r')}.",
        "Sells",
        ("f", "n"),
        "SELECT p_partkey AS f, 'Sold' AS n FROM part WHERE p_size % 2 = 0",
    ),
    "pattern_absent": CodeQuery(
        f"Plain(f) :- $r <: $h(...) :- ... . :>, NOT(Has($r)), {_file('$r')}. Has($r) :- $r <: ... :- ..., NOT($p(...)), ... . :>.",
        "Plain",
        ("f",),
        "SELECT p_partkey AS f FROM part WHERE p_size % 2 <> 0",
    ),
    "pattern_bounded": CodeQuery(
        f"Sum(f, v) :- $e <: $a + $b :>, INT($b, v), {_file('$e')}.",
        "Sum",
        ("f", "v"),
        "SELECT p_partkey AS f, p_partkey AS v FROM part",
    ),
    "pattern_evaluation": CodeQuery(
        "Op($e, $a, $b, \"+\") :- $e <: $a + $b :>. Op($e, $a, $b, \"*\") :- $e <: $a * $b :>. Value(e, v) :- INT(e, v)."
        " Value(e, v) :- Op(e, a, b, \"+\"), Value(a, x), Value(b, y), BIND(v, x + y). Value(e, v) :- Op(e, a, b, \"*\"), Value(a, x), Value(b, y), BIND(v, x * y)."
        f" Bound(f, v) :- <: ... :- ..., GT($x, $e), ... . :>, Value($e, v), {_file('$e')}.",
        "Bound",
        ("f", "v"),
        "SELECT p_partkey AS f, p_size::BIGINT * 2 + p_partkey AS v FROM part",
    ),
    "pattern_any_subtree": CodeQuery(
        f"Holds(f, v) :- <: Sold($x, 'Part) :>, ID($x, v), PARENT(l, $x), PARENT(a, l), {_file('a')}.",
        "Holds",
        ("f", "v"),
        "SELECT p_partkey AS f, 'x' AS v FROM part WHERE p_size % 2 = 0",
    ),
    "pattern_place": CodeQuery(
        f"Place(f, l, c, d) :- <: $h(...) :- ... . :>, SRC($h, l, c, _, d, _), {_file('$h')}.",
        "Place",
        ("f", "l", "c", "d"),
        "SELECT p_partkey AS f, 2::BIGINT AS l, 1::BIGINT AS c, 3::BIGINT AS d FROM part",
    ),
    "pattern_kinds": CodeQuery(
        f"Kind(f, k) :- <: Part($x, ..., $y) :>, AST(k, $y, _, _, _), A_SUPERTYPE(k, \"Constant\"), {_file('$y')}.",
        "Kind",
        ("f", "k"),
        "SELECT p_partkey AS f, 'IntConstant' AS k FROM part",
    ),
    "tree_tokens": CodeQuery(
        f"Number(f, v) :- A_PR(\"NUMERAL\", t, _, _, s), BIND(v, to_number(s)), {_file('t')}.",
        "Number",
        ("f", "v"),
        "SELECT p_partkey AS f, p_partkey::BIGINT AS v FROM part UNION SELECT p_partkey, p_size FROM part UNION SELECT p_partkey, 2 FROM part",
    ),
    "tree_supertypes": CodeQuery(
        'Up(s) :- A_SUPERTYPE("StringConstant", s), A_PR("Fact", _, _, _, _).',
        "Up",
        ("s",),
        "SELECT unnest(['StringConstant', 'Constant', 'Term', 'Expr']) AS s",
    ),
}
