"""One rule as a DataFrame plan.

Relations have columns c0, c1, ... and no duplicates; a relation of no arguments has one
row and a hidden column when it holds.  Literals are joined in an order that keeps them
connected; a literal that only filters becomes a semi-join, negation an anti-join, a
literal without variables an existence test against one row at most.  A variable that is there
for one comparison only is joined as its least and greatest value, so pairs are not listed
to find that there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import call, compare
from ..plans.syntax import Atom, Bind, Call, Clause, Const, Test, Var, variables

UNIT = "__unit"
SPARK_TYPES = {"Integer": "long", "ASTNode": "long", "String": "string", "PredicateRef": "string"}


def schema_of(kinds: list[str]) -> str:
    return ", ".join(f"c{i} {SPARK_TYPES[k]}" for i, k in enumerate(kinds)) or f"{UNIT} boolean"


def column(x) -> Column:
    if isinstance(x, Const):
        return F.lit(x.value).cast("long") if x.kind == "Integer" else F.lit(x.value)
    if isinstance(x, Var):
        return F.col(f"v_{x.name}")
    assert isinstance(x, Call)
    return call(x.name, [column(a) for a in x.args])


def condition(t: Test) -> Column:
    left = t.left.value if t.op == "MATCH" and isinstance(t.left, Const) else column(t.left)
    out = compare(t.op, left, column(t.right))
    return ~out if t.negated else out


_TURNED = {"NEQ": "NEQ", "LT": "GT", "LTE": "GTE", "GT": "LT", "GTE": "LTE"}
_OPPOSITE = {"EQ": "NEQ", "LT": "GTE", "LTE": "GT", "GT": "LTE", "GTE": "LT"}
_LEAST, _MOST = "__least", "__most"


def any_passes(t: Test, var: str, bound: set[str]) -> Column | None:
    """Whether a value of ``var`` passes the test, by the least and the greatest of its values; None if these don't tell."""
    op, left, right = _OPPOSITE.get(t.op) if t.negated else t.op, t.left, t.right
    if op in _TURNED and right == Var(var):
        op, left, right = _TURNED[op], right, left
    if op not in _TURNED or left != Var(var) or not variables(right) <= bound:
        return None
    other = column(right)
    if op == "NEQ":
        return (F.col(_LEAST) != other) | (F.col(_MOST) != other)
    return compare(op, F.col(_LEAST if op in ("LT", "LTE") else _MOST), other)


def matches(atom: Atom, relation: DataFrame, keep: set[str]) -> DataFrame:
    """The relation's rows that fit the atom, as columns v_x for the variables in ``keep``."""
    first: dict[str, int] = {}
    for i, t in enumerate(atom.terms):
        if isinstance(t, Const):
            relation = relation.where(F.col(f"c{i}") == column(t))
        elif isinstance(t, Var):
            if t.name in first:
                relation = relation.where(F.col(f"c{i}") == F.col(f"c{first[t.name]}"))
            else:
                first[t.name] = i
    return relation.select(*[F.col(f"c{i}").alias(f"v_{v}") for v, i in first.items() if v in keep])


def _exists(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows.select(F.lit(True).alias("__any")).limit(1))  # one row at most


def body_frame(spark: SparkSession, clause: Clause, relation: Callable[[Atom, int], DataFrame], first: int | None = None) -> DataFrame:
    """All bindings of the variables that the heads use.  ``relation(atom, place)`` gives a literal's rows; ``first``: the place to begin with."""
    heads = set().union(*(variables(h) for h in clause.heads))
    places = [i for i, x in enumerate(clause.body) if isinstance(x, Atom) and not x.negated]
    others = [x for x in clause.body if not (isinstance(x, Atom) and not x.negated)]
    frame: DataFrame | None = None
    bound: set[str] = set()

    def settle() -> None:
        """Applies every constraint and negation whose variables are bound."""
        nonlocal frame
        again = True
        while again:
            again = False
            for x in list(others):
                if isinstance(x, Bind) and variables(x.expr) <= bound:
                    if x.var.name in bound:
                        frame = frame.where(column(x.var) == column(x.expr))
                    else:
                        frame = frame.withColumn(f"v_{x.var.name}", column(x.expr))
                        bound.add(x.var.name)
                elif isinstance(x, Test) and variables(x) <= bound:
                    frame = frame.where(condition(x))
                elif isinstance(x, Atom) and variables(x) <= bound:
                    rows = matches(x, relation(x, -1), variables(x))
                    keys = [f"v_{v}" for v in sorted(variables(x))]
                    frame = frame.join(rows.select(*keys), keys, "left_anti") if keys else frame.join(_exists(rows), F.col("__any"), "left_anti")
                else:
                    continue
                others.remove(x)
                again = True

    def used_later() -> set[str]:
        return heads.union(*(variables(x) for x in others), *(variables(clause.body[i]) for i in places))

    while places:
        if frame is None and first is not None:
            at = first
        else:
            # connected literals first, those with most shared variables and constants leading
            rank = lambda i: (len(variables(clause.body[i]) & bound), sum(isinstance(t, Const) for t in clause.body[i].terms), -i)
            at = max(places, key=rank)
        places.remove(at)
        atom = clause.body[at]
        own = variables(atom)
        shared = [f"v_{v}" for v in sorted(own & bound)]
        new = (own - bound) & used_later()
        rows = matches(atom, relation(atom, at), (own & bound) | new)
        passing = None
        if frame is not None and first is None and len(new) == 1 and not new & heads:
            uses = [x for x in [*others, *(clause.body[i] for i in places)] if variables(x) & new]
            if len(uses) == 1 and isinstance(uses[0], Test):
                passing = any_passes(uses[0], *new, bound)
        if passing is not None:
            var = F.col(f"v_{next(iter(new))}")
            rows = rows.groupBy(*shared).agg(F.min(var).alias(_LEAST), F.max(var).alias(_MOST))
            frame = (frame.join(rows, shared) if shared else frame.crossJoin(F.broadcast(rows))).where(passing).drop(_LEAST, _MOST)
            others.remove(uses[0])
        elif frame is None:
            frame = rows if new else spark.range(1).select(F.lit(True).alias(UNIT)).join(_exists(rows), F.col("__any"), "left_semi")
        elif not own or (not shared and not new):
            frame = frame.join(_exists(rows), F.col("__any"), "left_semi")
        elif not shared:
            frame = frame.crossJoin(rows)  # the program asks for the product
        else:
            frame = frame.join(rows, shared, "inner" if new else "left_semi")
        bound |= own if not shared and not new else (own & bound) | new
        settle()
        keep = [c for c in frame.columns if c[2:] in used_later()]
        frame = frame.select(*keep) if keep else frame.select(F.lit(True).alias(UNIT))
    if frame is None:
        frame = spark.range(1).select(F.lit(True).alias(UNIT))
        settle()
    return frame


def head_frame(head: Atom, body: DataFrame) -> DataFrame:
    if not head.terms:
        return body.select(F.lit(True).alias(UNIT))
    return body.select(*[column(t).alias(f"c{i}") for i, t in enumerate(head.terms)])
