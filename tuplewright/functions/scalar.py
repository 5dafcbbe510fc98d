"""The language's functors: signatures, and their Catalyst expressions.

Integers are 64-bit and wrap.  Plans are built with ANSI mode off for that (see
``engine.Engine``), and the guards below raise where ANSI mode would: a zero divisor and a
text that is no number are errors, never nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_I, _S, _N = "Integer", "String", "ASTNode"
SIGNATURES: dict[str, tuple[tuple[str, ...], str]] = {
    **{n: ((_I, _I), _I) for n in ("add", "sub", "mul", "div", "mod", "band", "bor", "bxor", "bshl", "bshr", "bshru")},
    "to_number": ((_S,), _I),
    "cat": ((_S, _S), _S),
    "node_to_id": ((_N,), _I),
    "id_to_node": ((_I,), _N),
}


def _nonzero(b: Column, value: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("long")).otherwise(value)


def _number(s: Column) -> Column:
    n = F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.cast("long"))
    return F.coalesce(n, F.raise_error(F.concat(F.lit("not a number: "), s)).cast("long"))


def _shift(kind):
    return lambda a, b: F.call_function(kind, a, b.bitwiseAND(F.lit(63)).cast("int"))


_BUILD = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: _nonzero(b, F.call_function("div", a, b)),
    "mod": lambda a, b: _nonzero(b, a % b),
    "band": lambda a, b: a.bitwiseAND(b),
    "bor": lambda a, b: a.bitwiseOR(b),
    "bxor": lambda a, b: a.bitwiseXOR(b),
    "bshl": _shift("shiftleft"),
    "bshr": _shift("shiftright"),
    "bshru": _shift("shiftrightunsigned"),
    "to_number": _number,
    "cat": lambda a, b: F.concat(a, b),
    "node_to_id": lambda a: a,
    "id_to_node": lambda a: a,
}


def call(name: str, args: list[Column]) -> Column:
    return _BUILD[name](*args)


def compare(op: str, a: Column, b: Column) -> Column:
    if op == "MATCH":  # the whole of b, not a part
        return b.rlike(F.concat(F.lit(r"\A(?:"), a, F.lit(r")\z"))) if not isinstance(a, str) else b.rlike(rf"\A(?:{a})\z")
    return {"EQ": a == b, "NEQ": a != b, "LT": a < b, "LTE": a <= b, "GT": a > b, "GTE": a >= b}[op]
