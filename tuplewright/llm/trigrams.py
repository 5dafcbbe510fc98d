"""Boolean trigram queries of regular expressions.

A query is ``True`` (no mandatory trigram: every text may match), a trigram in
lower case, or ``("and" | "or", [queries])``.  It holds for every text that the
expression matches; the converse need not be so, hence candidates are verified.
"""

from __future__ import annotations

import re
from itertools import product

#: More alternatives than this are no longer enumerated.
MOST = 64

_P = re._parser
_C = re._constants


def both(kind: str, parts: list):
    """``and`` / ``or`` of queries, simplified."""
    flat: list = []
    for p in parts:
        flat.extend(p[1] if isinstance(p, tuple) and p[0] == kind else [p])
    if kind == "or" and any(p is True for p in flat):
        return True
    flat = [p for p in flat if p is not True]
    unique: list = []
    for p in flat:
        if p not in unique:
            unique.append(p)
    return True if not unique else unique[0] if len(unique) == 1 else (kind, unique)


def _text_query(s: str):
    return both("and", [s[i : i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else True


def _set_query(texts: set[str]):
    return both("or", [_text_query(s) for s in sorted(texts)]) if texts else True


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, av in items:
        if op is _C.LITERAL:
            out.add(chr(av).lower())
        elif op is _C.RANGE and av[1] - av[0] < MOST:
            out |= {chr(c).lower() for c in range(av[0], av[1] + 1)}
        else:
            return None
    return out


def _walk(seq) -> tuple[set[str] | None, object]:
    """(all texts that may match, or None where they are too many; what else must hold)."""
    run: set[str] = {""}
    must: list = []
    exact = True
    for op, av in seq:
        texts: set[str] | None
        query: object = True
        if op is _C.LITERAL:
            texts = {chr(av).lower()}
        elif op is _C.IN:
            texts = _class(av)
        elif op is _C.SUBPATTERN:
            texts, query = _walk(av[3])
        elif op is _C.BRANCH:
            found = [_walk(x) for x in av[1]]
            texts = None if any(t is None for t, _ in found) else set().union(*(t for t, _ in found))
            query = both("or", [both("and", [q, True if t is None else _set_query(t)]) for t, q in found]) if texts is None else True
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT):
            low, high, inner = av
            texts, query = _walk(inner)
            if low == 0:
                texts, query = ({""} | texts if high == 1 and texts is not None else None), True
            elif texts is not None and not (low == high and len(texts) ** low <= MOST):
                texts, query = None, both("and", [query, _set_query(texts)])
            elif texts is not None:
                texts = {"".join(x) for x in product(texts, repeat=low)}
        elif op is _C.AT:
            texts = {""}
        else:
            texts = None
        must.append(query)
        if texts is not None and len(run) * len(texts) <= MOST:
            run = {a + b for a in run for b in texts}
            continue
        exact = False
        must.append(_set_query(run))
        run = texts if texts is not None and len(texts) <= MOST else {""}
    if exact:
        return run, both("and", must)
    must.append(_set_query(run))
    return None, both("and", must)


def query_of(pattern: str):
    """The Boolean trigram query that every text matched by ``pattern`` fulfils."""
    texts, query = _walk(_P.parse(pattern))
    return both("and", [query, True if texts is None else _set_query(texts)])


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_in(q) for q in query[1]))


def sets_of(query) -> list[frozenset[str]]:
    """``query`` in disjunctive form: it holds where all trigrams of one of the sets do."""
    if isinstance(query, str):
        return [frozenset([query])]
    found = [sets_of(q) for q in query[1]]
    if query[0] == "or":
        out = [s for f in found for s in f]
    else:
        out = [frozenset()]
        for f in sorted(found, key=len):
            if len(out) * len(f) <= MOST:  # what would need more sets is left to the verification
                out = [a | b for a in out for b in f]
    out = list(dict.fromkeys(out))
    return [s for s in out if not any(o < s for o in out)]


def holds(query, has):
    """``query`` with each trigram t replaced by ``has(t)``, as a value that knows & and |."""
    if isinstance(query, str):
        return has(query)
    out = None
    for q in query[1]:
        x = holds(q, has)
        out = x if out is None else (out & x if query[0] == "and" else out | x)
    return out
