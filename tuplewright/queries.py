"""Programs over the test tables, each with the SQL that gives the same rows.

Money is bound in cents and times in whole days, as the language has integers and texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .code_queries import CODE, PROGRAM
from .engine import Engine
from .incremental import Incremental, IncrementalTrees
from .sources.store import shared_root

#: Predicates over tables: (table, columns as SQL of Spark).
BINDINGS: dict[str, tuple[str, list[str]]] = {
    "Region": ("region", ["r_regionkey", "r_name"]),
    "Nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"]),
    "Customer": ("customer", ["c_custkey", "c_nationkey", "c_mktsegment"]),
    "Supplier": ("supplier", ["s_suppkey", "s_nationkey"]),
    "Part": ("part", ["p_partkey", "p_name", "p_brand", "p_size"]),
    "Order": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
    "Line": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
    "Event": ("events", ["event_id", "user_id", "event_type"]),
}


@dataclass(frozen=True)
class Query:
    program: str
    result: str
    names: tuple[str, ...]
    sql: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {p: spark.read.parquet(f"{sf_dir}/{t}.parquet").selectExpr(*c) for p, (t, c) in BINDINGS.items() if f"{p}(" in self.program}
        out = Engine(spark).run(self.program, tables, {self.result})[self.result]
        return out.toDF(*self.names)


CATALOGUE: dict[str, Query] = {
    "project_filter": Query("Small(k, s) :- Part(k, _, _, s), LT(s, 10).", "Small", ("k", "s"), "SELECT DISTINCT p_partkey AS k, p_size::BIGINT AS s FROM part WHERE p_size < 10"),
    "join_inner": Query('InAsia(k, n) :- Nation(k, n, r), Region(r, "ASIA").', "InAsia", ("k", "n"), "SELECT DISTINCT n_nationkey::BIGINT AS k, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "join_three": Query(
        "Sold(c, s) :- Order(o, c, _, _), Line(o, _, _, s), Supplier(s, n), Customer(c, n, _).",
        "Sold",
        ("c", "s"),
        "SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey AND c_nationkey = s_nationkey",
    ),
    "cross_product": Query("Pair(a, b) :- Region(a, _), Region(b, _).", "Pair", ("a", "b"), "SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a, region b"),
    "theta_self_join": Query(
        "Pair(a, b) :- Nation(a, _, r), Nation(b, _, r), LT(a, b).",
        "Pair",
        ("a", "b"),
        "SELECT DISTINCT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "semi_join": Query("Buyer(c, s) :- Customer(c, _, s), Order(_, c, _, _).", "Buyer", ("c", "s"), "SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "anti_join": Query('Idle(c, s) :- Customer(c, _, s), NOT(Order(_, c, _, "1-URGENT")).', "Idle", ("c", "s"), "SELECT DISTINCT c_custkey AS c, c_mktsegment AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"),
    "emptiness": Query('Flag("none") :- NOT(Order(_, _, "X", _)). Flag("some") :- Order(_, _, _, _).', "Flag", ("f",), "SELECT 'none' AS f WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X') UNION SELECT 'some' WHERE EXISTS (SELECT 1 FROM orders)"),
    "union": Query("N(n) :- Customer(_, n, _). N(n) :- Supplier(_, n).", "N", ("n",), "SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "intersect": Query(
        "Bought(p) :- Line(_, _, p, _), Part(p, _, _, s), EQ(s, 1). Sold(p) :- Line(_, 1, p, _). Both(p) :- Bought(p), Sold(p).",
        "Both",
        ("p",),
        "SELECT l_partkey AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 1",
    ),
    "except": Query(
        "Here(p) :- Line(_, 1, p, _). There(p) :- Line(_, 2, p, _). Only(p) :- Here(p), NOT(There(p)).",
        "Only",
        ("p",),
        "SELECT l_partkey AS p FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2",
    ),
    "repeated_variable": Query("Same(o, n) :- Line(o, n, _, n).", "Same", ("o", "n"), "SELECT DISTINCT l_orderkey AS o, l_linenumber::BIGINT AS n FROM lineitem WHERE l_linenumber = l_suppkey"),
    "multi_head": Query(
        'Urgent(o), Seen(c) :- Order(o, c, _, "1-URGENT"). All(x, "order") :- Urgent(x). All(x, "customer") :- Seen(x).',
        "All",
        ("x", "kind"),
        "SELECT o_orderkey AS x, 'order' AS kind FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT o_custkey, 'customer' FROM orders WHERE o_orderpriority = '1-URGENT'",
    ),
    "constants_only": Query('P("yes", 1) :- EQ(0, 0). P("no", 2) :- NEQ(0, 0). P("fact", 3).', "P", ("s", "n"), "SELECT 'yes' AS s, 1::BIGINT AS n UNION SELECT 'fact', 3"),
    "comparisons": Query(
        "C(k, s) :- Part(k, _, _, s), GTE(s, 10), LTE(s, 20), NOT(EQ(s, 15)), GT(k, 5), NOT(LT(k, 9)).",
        "C",
        ("k", "s"),
        "SELECT DISTINCT p_partkey AS k, p_size::BIGINT AS s FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size <> 15 AND p_partkey > 5 AND p_partkey >= 9",
    ),
    "bind_arithmetic": Query(
        "A(k, x, y, z) :- Part(k, _, _, s), BIND(x, (k + s) * 2 - 7), BIND(y, x / 3), BIND(z, mod(0 - x, 5)).",
        "A",
        ("k", "x", "y", "z"),
        "SELECT DISTINCT p_partkey AS k, (p_partkey + p_size) * 2 - 7 AS x, ((p_partkey + p_size) * 2 - 7) // 3 AS y, (0 - ((p_partkey + p_size) * 2 - 7)) % 5 AS z FROM part",
    ),
    "bit_functions": Query(
        "B(k, a, o, x, l, r) :- Part(k, _, _, s), BIND(a, band(k, s)), BIND(o, bor(k, s)), BIND(x, bxor(k, s)), BIND(l, bshl(s, 3)), BIND(r, bshr(k, 2)).",
        "B",
        ("k", "a", "o", "x", "l", "r"),
        "SELECT DISTINCT p_partkey AS k, p_partkey & p_size AS a, p_partkey | p_size AS o, xor(p_partkey, p_size::BIGINT) AS x, p_size::BIGINT << 3 AS l, p_partkey >> 2 AS r FROM part",
    ),
    "text_functions": Query(
        'T(k, s, n) :- Part(k, _, b, _), BIND(s, cat(cat("<", b), ">")), BIND(n, add(to_number("42"), k)).',
        "T",
        ("k", "s", "n"),
        "SELECT DISTINCT p_partkey AS k, '<' || p_brand || '>' AS s, 42 + p_partkey AS n FROM part",
    ),
    "match": Query('M(k, n) :- Nation(k, n, _), MATCH(".*[13579]", n).', "M", ("k", "n"), "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE regexp_full_match(n_name, '.*[13579]')"),
    "not_match": Query('M(k, n) :- Nation(k, n, _), NOT(MATCH(".*[13579]", n)).', "M", ("k", "n"), "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation WHERE NOT regexp_full_match(n_name, '.*[13579]')"),
    "max_by_negation": Query(
        "Larger(o, n) :- Line(o, n, _, _), Line(o, m, _, _), GT(m, n). Last(o, n) :- Line(o, n, _, _), NOT(Larger(o, n)).",
        "Last",
        ("o", "n"),
        "SELECT l_orderkey AS o, max(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY l_orderkey",
    ),
    "for_all": Query(
        'Open(c) :- Order(_, c, s, _), NEQ(s, "F"). Settled(c) :- Order(_, c, _, _), NOT(Open(c)).',
        "Settled",
        ("c",),
        "SELECT DISTINCT o_custkey AS c FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'F')",
    ),
    "value_walk": Query(
        "Seen(k) :- Part(k, _, _, 1). Seen(m) :- Seen(k), BIND(m, k * 2 + 3), LT(m, 5000).",
        "Seen",
        ("n",),
        "WITH RECURSIVE w AS (SELECT p_partkey AS n FROM part WHERE p_size = 1 UNION SELECT n * 2 + 3 FROM w WHERE n * 2 + 3 < 5000) SELECT n FROM w",
    ),
    "shared_relations": Query(
        "A(c, s) :- Order(o, c, _, _), Line(o, _, _, s), LT(s, 20), LT(c, 200). B(c, d) :- A(c, s), A(d, s). C(c, d) :- B(c, e), B(e, d), LT(c, 9), LT(d, 9), LT(e, 9).",
        "C",
        ("c", "d"),
        "WITH a AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey < 20 AND o_custkey < 200), b AS (SELECT DISTINCT x.c AS c, y.c AS d FROM a AS x JOIN a AS y ON x.s = y.s WHERE x.c < 9 AND y.c < 9) SELECT DISTINCT x.c AS c, y.d AS d FROM b AS x JOIN b AS y ON x.d = y.c",
    ),
    "unsigned_shift": Query(
        "U(k, u) :- Part(k, _, _, _), BIND(u, bshru(0 - k, 40)).",
        "U",
        ("k", "u"),
        "SELECT p_partkey AS k, CASE WHEN p_partkey = 0 THEN 0 ELSE 16777215 END::BIGINT AS u FROM part",
    ),
    "node_ids": Query(
        "Node(n) :- Nation(k, _, _), BIND(n, id_to_node(k * 7)). Back(k) :- Node(n), BIND(k, node_to_id(n)).",
        "Back",
        ("k",),
        "SELECT DISTINCT n_nationkey::BIGINT * 7 AS k FROM nation",
    ),
    "closure_large": Query(
        "Up(a, b) :- Order(a, _, _, _), BIND(b, a / 2), Order(b, _, _, _), LT(b, a). Over(a, b) :- Up(a, b). Over(a, c) :- Over(a, b), Over(b, c).",
        "Over",
        ("a", "b"),
        "WITH RECURSIVE u AS (SELECT x.o_orderkey AS a, y.o_orderkey AS b FROM orders AS x JOIN orders AS y ON y.o_orderkey = x.o_orderkey // 2 WHERE y.o_orderkey < x.o_orderkey), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a, b FROM r",
    ),
    "closure_linear": Query(
        "Step(a, b) :- Nation(a, _, _), BIND(b, a + 3), Nation(b, _, _). Reach(a, b) :- Step(a, b). Reach(a, c) :- Step(a, b), Reach(b, c).",
        "Reach",
        ("a", "b"),
        "WITH RECURSIVE s AS (SELECT a.n_nationkey::BIGINT a, b.n_nationkey::BIGINT b FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 3), r AS (SELECT a, b FROM s UNION SELECT s.a, r.b FROM s JOIN r ON s.b = r.a) SELECT a, b FROM r",
    ),
    "closure_nonlinear": Query(
        "Trade(a, b) :- Line(o, _, _, s), Supplier(s, a), Order(o, c, _, \"1-URGENT\"), Customer(c, b, _), LT(a, b), LTE(b, a + 2). Reach(a, b) :- Trade(a, b). Reach(a, c) :- Reach(a, b), Reach(b, c).",
        "Reach",
        ("a", "b"),
        "WITH RECURSIVE t AS (SELECT DISTINCT s_nationkey::BIGINT a, c_nationkey::BIGINT b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND s_nationkey < c_nationkey AND c_nationkey <= s_nationkey + 2), r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a) SELECT a, b FROM r",
    ),
    "mutual_recursion": Query(
        "Even(0). Odd(y) :- Even(x), BIND(y, x + 1), LTE(y, 9). Even(y) :- Odd(x), BIND(y, x + 1), LTE(y, 9). Par(x, \"even\") :- Even(x). Par(x, \"odd\") :- Odd(x).",
        "Par",
        ("n", "parity"),
        "SELECT n, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM (SELECT unnest(range(10))::BIGINT AS n)",
    ),
    "symmetric_closure": Query(
        "Near(a, b) :- Nation(a, _, r), Nation(b, _, r), BIND(b, a + 5). Near(b, a) :- Near(a, b).",
        "Near",
        ("a", "b"),
        "WITH s AS (SELECT a.n_nationkey::BIGINT a, b.n_nationkey::BIGINT b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5) SELECT a, b FROM s UNION SELECT b, a FROM s",
    ),
}


def _tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {p: spark.read.parquet(f"{sf_dir}/{BINDINGS[p][0]}.parquet").selectExpr(*BINDINGS[p][1]) for p in names}


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation through OUTPUT to CSV and back through EDB."""
    folder = f"{shared_root(spark)}/{uuid.uuid4().hex}-csv"
    nations = _tables(spark, sf_dir, ("Nation",))
    Engine(spark, out=folder).run("""N(k, s) :- Nation(k, n, _), BIND(s, cat(n, ", \\ ")). OUTPUT('N, "n", "csv").""", nations)
    return Engine(spark, facts=folder).run("""EDB('N, "n", "csv"). N(0, "") :- NEQ(0, 0).""")["N"].toDF("k", "s")


#: Orders are the sources: their lines and customers carry the order key.
BY_ORDER = """Larger(o, n) :- Line(o, n, _, _), Line(o, m, _, _), GT(m, n).
Last(o, n) :- Line(o, n, _, _), NOT(Larger(o, n)).
Long(o, c) :- Last(o, n), GT(n, 4), Order(o, c, _, _).
Segment(s, o) :- Long(o, c), Customer(c, _, s)."""


def incremental_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run on the tables with every twentieth order altered, then an update to the tables as they are."""
    now = _tables(spark, sf_dir, ("Line", "Order", "Customer"))
    then = {**now, "Line": now["Line"].where("l_orderkey % 20 <> 0 or l_linenumber < 3").union(now["Line"].where("l_orderkey % 20 = 0").selectExpr("l_orderkey", "l_linenumber + 9", "l_partkey", "l_suppkey"))}
    kept = Incremental(spark, BY_ORDER, {"Line": 0, "Order": 0}, f"{shared_root(spark)}/{uuid.uuid4().hex}-kept", 16)
    kept.run(then)
    changed = now["Order"].where("o_orderkey % 20 = 0").select("o_orderkey")
    return kept.update(now, changed)["Segment"].toDF("segment", "o")


COMMON = """Last(f, v) :- <: $p(..., $v). :>, INT($v, v), BIND(f, bshru(node_to_id($v), 32)).
Shared(v) :- Last(f, v), Last(g, v), NEQ(f, g).
Common(f, v) :- Last(f, v), Shared(v)."""


def incremental_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full run on programs made of the parts with every tenth one altered and some missing, then an update to the parts as they are."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    texts = lambda df: df.selectExpr("p_partkey AS file_id", "concat(p_partkey, '.rules') AS file", f"{PROGRAM} AS text")
    kept = IncrementalTrees(spark, COMMON, f"{shared_root(spark)}/{uuid.uuid4().hex}-kept", 16)
    kept.run(texts(part.where("p_partkey % 100 <> 7").selectExpr("p_partkey", "p_brand", "if(p_partkey % 10 = 0, p_size + 100, p_size) AS p_size")))
    return kept.update(texts(part), part.where("p_partkey % 10 = 0 OR p_partkey % 100 = 7").select("p_partkey"))["Common"].toDF("f", "v")


OTHERS = {
    "incremental_trees": (incremental_trees, "SELECT p_partkey AS f, p_size::BIGINT AS v FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 1)"),
    "csv_round_trip": (csv_round_trip, "SELECT DISTINCT n_nationkey::BIGINT AS k, n_name || ', \\ ' AS s FROM nation"),
    "incremental_update": (
        incremental_update,
        "SELECT DISTINCT c_mktsegment AS segment, o_orderkey AS o FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n > 4",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in (CATALOGUE | CODE).items()} | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in (CATALOGUE | CODE).items()} | {name: sql for name, (_, sql) in OTHERS.items()}
