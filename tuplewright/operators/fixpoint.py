"""Evaluates strata: one plan for those without recursion, a semi-naive loop for the rest.

Each round of the loop uses only what the last round added, in one variant of a rule for
each recursive literal; what is new is written to the shared folder, so plans stay short
and a lost executor costs no earlier round.  A derived relation that several literals or a
loop use is written once, when it is first used; the rest is part of its user's plan.
Strata that don't depend on each other can run side by side.
"""

from __future__ import annotations

import time
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from functools import reduce
from threading import RLock

from pyspark.sql import DataFrame, SparkSession

from ..plans.strata import edges, recursive, strata
from ..plans.syntax import Atom, Clause
from ..sources.store import counted, written
from .rules import body_frame, head_frame, schema_of

#: After so many rounds the parts of a growing relation are written as one.
COMPACT = 8


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class Evaluator:
    def __init__(self, spark: SparkSession, kinds: dict[str, list[str]], relations: dict[str, DataFrame], max_rounds: int | None = None, threads: int = 1):
        self.spark, self.kinds, self.relations, self.max_rounds, self.threads = spark, kinds, dict(relations), max_rounds, threads
        self.rounds: dict[str, int] = {}
        self.seconds: dict[str, float] = {}
        self.shared: set[str] = set()  # derived relations to be written at their first use
        self.bags = set(relations)  # relations that may hold a row more than once
        self.lock = RLock()

    def relation(self, name: str) -> DataFrame:
        """A predicate without clauses or rows is an empty relation."""
        with self.lock:
            if name not in self.relations:
                self.relations[name] = self.spark.createDataFrame([], schema_of(self.kinds[name]))
            if name in self.shared:
                self.shared.discard(name)
                self.relations[name] = written(self.relations[name], name)
            return self.relations[name]

    def result(self, name: str) -> DataFrame:
        """The relation as a set."""
        return self.relation(name).distinct() if name in self.bags else self.relation(name)

    def _heads(self, clause: Clause, body: DataFrame) -> dict[str, list[DataFrame]]:
        out: dict[str, list[DataFrame]] = {}
        if len(clause.heads) > 1 and sum(isinstance(x, Atom) for x in clause.body) > 1:
            body = written(body.distinct(), "body")  # its joins are made once
        for h in clause.heads:
            out.setdefault(h.name, []).append(head_frame(h, body))
        return out

    def _facts(self, clauses: list[Clause]) -> dict[str, list[DataFrame]]:
        rows: dict[str, set] = {}
        for c in clauses:
            for h in c.heads:
                rows.setdefault(h.name, set()).add(tuple(t.value for t in h.terms) or (True,))
        return {p: [self.spark.createDataFrame(sorted(r), schema_of(self.kinds[p]))] for p, r in rows.items()}

    def _add(self, new: dict[str, list[DataFrame]]) -> None:
        with self.lock:
            for p, frames in new.items():
                known = [self.relations[p]] if p in self.relations else []
                self.relations[p] = union([*known, *frames]).distinct()
                self.bags.discard(p)

    def run(self, clauses: list[Clause], keep: set[str] = frozenset()) -> dict[str, DataFrame]:
        self._add(self._facts([c for c in clauses if c.is_fact]))
        rules = [c for c in clauses if not c.is_fact]
        groups = strata(rules)
        loops = [recursive(rules, g) for g in groups]
        uses: dict[str, int] = {}
        for g, loop in zip(groups, loops):
            for name in (x.name for i in g for x in rules[i].body if isinstance(x, Atom)):
                uses[name] = uses.get(name, 0) + (2 if loop else 1)
        inside = {h.name for g, loop in zip(groups, loops) if loop for i in g for h in rules[i].heads}
        self.shared = {h.name for c in rules for h in c.heads if uses.get(h.name, 0) > 1 or h.name in keep} - inside
        place = {i: k for k, g in enumerate(groups) for i in g}
        after: dict[int, set[int]] = {k: set() for k in range(len(groups))}
        for i, users in enumerate(edges(rules)):
            for j in users:
                if place[i] != place[j]:
                    after[place[j]].add(place[i])
        step = lambda k: self._stratum([rules[i] for i in groups[k]], loops[k])
        if self.threads <= 1:
            for k in range(len(groups)):
                step(k)
            return self.relations
        with ThreadPoolExecutor(self.threads) as pool:
            running, done, todo = {}, set(), set(after)
            while todo or running:
                for k in sorted(k for k in todo if after[k] <= done):
                    todo.discard(k)
                    running[pool.submit(step, k)] = k
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    done.add(running.pop(f))
                    f.result()
        return self.relations

    def _stratum(self, rules: list[Clause], loop: bool) -> None:
        began = time.time()
        if loop:
            self._fixpoint(rules)
        else:
            body = body_frame(self.spark, rules[0], lambda a, _: self.relation(a.name))
            self._add(self._heads(rules[0], body))
        for p in {h.name for c in rules for h in c.heads}:
            self.seconds[p] = self.seconds.get(p, 0.0) + time.time() - began

    def _fixpoint(self, rules: list[Clause]) -> None:
        own = sorted({h.name for c in rules for h in c.heads})
        parts = {p: [written(self.result(p), p)] for p in own}
        delta = {p: parts[p][0] for p in own}
        n = 0
        while True:
            full = {p: union(parts[p]) for p in own}
            found: dict[str, list[DataFrame]] = {}
            for c in rules:
                for i, x in enumerate(c.body):
                    if not (isinstance(x, Atom) and not x.negated and x.name in own):
                        continue
                    if n and x.name not in delta:
                        continue
                    at = lambda a, place, i=i: delta[a.name] if place == i else full.get(a.name) if a.name in full else self.relation(a.name)
                    for p, frames in self._heads(c, body_frame(self.spark, c, at, i)).items():
                        found.setdefault(p, []).extend(frames)
            new = {}
            for p, frames in found.items():
                fresh = union(frames).distinct()
                fresh, rows = counted(fresh.join(full[p], fresh.columns, "left_anti"), p)
                if rows:
                    new[p] = fresh
            n += 1
            if not new:
                break
            if self.max_rounds is not None and n >= self.max_rounds:
                raise RuntimeError(f"no fixpoint of {', '.join(own)} in {self.max_rounds} rounds")
            for p, fresh in new.items():
                parts[p].append(fresh)
                if len(parts[p]) > COMPACT:
                    parts[p] = [written(union(parts[p]), p)]
            delta = new
        with self.lock:
            for p in own:
                self.relations[p] = union(parts[p])
                self.bags.discard(p)
                self.rounds[p] = n
