"""Clauses made in Python: ``rule([p.T(x, z)], p.E(x, y), p.T(y, z), NEQ(x, z))``.

Strings in terms are constants; variables come from ``var`` or ``variables_of``.
"""

from __future__ import annotations

from .syntax import Atom, Bind, Call, Clause, Const, Program, ProgramError, Test, Var, Wild

ANY = Wild()


def var(name: str) -> Var:
    if not name[:1].islower():
        raise ProgramError(f"Variable {name} begins with a small letter.")
    return Var(name)


def variables_of(names: str) -> list[Var]:
    return [var(n) for n in names.split()]


def ref(name: str) -> Const:
    return Const(name, "PredicateRef")


def _term(x):
    if isinstance(x, bool) or not isinstance(x, (int, str, Var, Wild, Const, Call)):
        raise ProgramError(f"{x!r} is no term.")
    return Const(x, "Integer") if isinstance(x, int) else Const(x, "String") if isinstance(x, str) else x


class Predicates:
    """``Predicates().P(1, x)`` is an atom of P."""

    def __getattr__(self, name: str):
        return lambda *terms: Atom(name, tuple(map(_term, terms)))


p = Predicates()


def call(name: str, *args) -> Call:
    return Call(name, tuple(map(_term, args)))


def _test(op: str):
    return lambda a, b: Test(op, _term(a), _term(b))


EQ, NEQ, LT, LTE, GT, GTE, MATCH = map(_test, ("EQ", "NEQ", "LT", "LTE", "GT", "GTE", "MATCH"))


def BIND(x: Var, expr) -> Bind:
    return Bind(x, _term(expr))


def NOT(x):
    if isinstance(x, Bind) or x.negated:
        raise ProgramError(f"{x} can't be negated.")
    return type(x)(**{**x.__dict__, "negated": True})


def fact(*heads: Atom) -> Clause:
    return Clause(list(heads), [])


def rule(heads: Atom | list[Atom], *body) -> Clause:
    return Clause(heads if isinstance(heads, list) else [heads], list(body))


def program(*clauses: Clause) -> Program:
    return Program(list(clauses))
