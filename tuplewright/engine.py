"""Runs programs: parse, check, load, evaluate, write."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .operators.fixpoint import Evaluator
from .operators.rules import SPARK_TYPES
from .plans.analysis import TREE_TYPES, check, undefined
from .plans.domains import Domains
from .plans.patterns import IDENTIFIERS, ambiguous, expand
from .plans.strata import needed_for, recursive, strata
from .plans.syntax import Atom, Program, ProgramError, parse
from .sources import files
from .sources.trees import FileIds, texts_of, trees


@contextmanager
def wrapping_integers(spark: SparkSession):
    """ANSI mode off while plans are built, so that integers wrap; expressions keep the mode they were built with."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def _kinds(name: str, kinds: list[str]) -> tuple[str, ...]:
    """A table's column types; those of the tree relations are fixed, as a node's id looks like any integer."""
    fixed = TREE_TYPES.get(name, ())
    return fixed if len(fixed) == len(kinds) else tuple(kinds)


class Engine:
    """``facts`` and ``out`` are the folders that EDB and OUTPUT files lie in; ``max_rounds`` bounds every fixpoint."""

    def __init__(self, spark: SparkSession, facts: str | None = None, out: str | None = None, max_rounds: int | None = None, threads: int = 1, language: str = "rules", ids: FileIds | None = None):
        """``threads``: strata that don't depend on each other run side by side on as many threads.

        ``language``: of the trees that context predicates look at, ``rules`` (rule programs,
        which patterns and ``sources`` are about) or ``java`` (trees given as tables only).
        """
        self.spark, self.facts, self.out, self.max_rounds, self.threads = spark, facts, out, max_rounds, threads
        if language not in IDENTIFIERS:
            raise ProgramError(f"Unknown language {language}.")
        self.language, self.ids = language, ids or FileIds()
        self.seconds: dict[str, float] = {}
        self.rounds: dict[str, int] = {}

    def run(self, program: str | Program, tables: dict[str, DataFrame] | None = None, want: set[str] | None = None, keep: set[str] | None = None, sources: DataFrame | dict[str, str] | None = None, types: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
        """All relations of the program, or with ``want`` those that the named ones and the program's inputs and outputs depend on.

        ``tables`` bind predicates to DataFrames by position (integers and texts; rows with
        nulls are refused by the language and left out).  A table may hold a row again and
        again: rules make sets, so only a table that is itself a result is made distinct.
        ``sources``: programs to look at, a DataFrame (file_id, file, text) or a mapping of files
        to changes; their trees become the relations ``A_PR`` and ``A_SLOC``.
        ``types``: column types of tables that hold node ids.
        Relations in ``keep`` are written to the shared folder, for who reads them repeatedly.
        """
        program = parse(program) if isinstance(program, str) else program
        tables = dict(tables or {})
        if sources is not None:
            if self.language != "rules":
                raise ProgramError("Sources of this language can't be read, give their trees as tables.")
            tables.update(trees(texts_of(self.spark, sources, self.ids) if isinstance(sources, dict) else sources))
        program = self._expanded(program, tables)
        kinds_of = {"bigint": "Integer", "int": "Integer", "smallint": "Integer", "tinyint": "Integer", "string": "String"}
        known, base = {}, {}
        for p, df in tables.items():
            odd = [c for c, t in df.dtypes if t not in kinds_of]
            if odd:
                raise ProgramError(f"Columns {odd} of the table for {p} are neither integers nor texts.")
            known[p] = tuple((types or {}).get(p) or _kinds(p, [kinds_of[t] for _, t in df.dtypes]))
        kinds = check(program, known)
        with wrapping_integers(self.spark):
            for p, df in tables.items():
                if p in kinds and len(kinds[p]) != len(df.columns):
                    raise ProgramError(f"The table for {p} has {len(df.columns)} columns, the program uses {len(kinds[p])}.")
                kinds.setdefault(p, list(known[p]))
                base[p] = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).na.drop().selectExpr(*[f"cast(c{i} as {SPARK_TYPES[k]}) c{i}" for i, k in enumerate(known[p])])
            for name in ("EDB", "IMPORT"):
                if name in kinds:
                    early = Evaluator(self.spark, kinds, base, self.max_rounds).run(needed_for(program, {name}))
                    for row in early[name].collect() if name in early else []:
                        self._load(name, row, kinds, base)
            outputs = []
            if "OUTPUT" in kinds:
                early = Evaluator(self.spark, kinds, base, self.max_rounds).run(needed_for(program, {"OUTPUT"}))
                outputs = early["OUTPUT"].collect() if "OUTPUT" in early else []
            for row in outputs:
                if row[0] not in kinds:
                    raise ProgramError(f"OUTPUT of unknown predicate {row[0]}.")
            names = set(want) | {"OUTPUT"} | {row[0] for row in outputs} if want else set(kinds)
            clauses = needed_for(program, names) if want else program.clauses
            run = Evaluator(self.spark, kinds, base, self.max_rounds, self.threads)
            run.run(clauses, keep or set())
            names |= {x.name for c in clauses for x in [*c.heads, *c.body] if isinstance(x, Atom)}
            relations = {p: run.result(p) for p in kinds if p in names}
            self.rounds, self.seconds = run.rounds, run.seconds
            for row in outputs:
                files.write(relations[row[0]], files.place(self.out, row[1]), row[2], row[0], kinds[row[0]])
        return relations

    def explain(self, program: str | Program, tables: dict[str, DataFrame] | None = None) -> str:
        """Column types and strata of a checked program, in evaluation order; nothing runs."""
        program = parse(program) if isinstance(program, str) else program
        kinds_of = {"bigint": "Integer", "int": "Integer", "string": "String"}
        unclear = ambiguous(program)
        program = self._expanded(program, tables or {})
        kinds = check(program, {p: _kinds(p, [kinds_of.get(t, "Integer") for _, t in df.dtypes]) for p, df in (tables or {}).items()})
        lines = [f"{p}({', '.join(k)})" for p, k in sorted(kinds.items())]
        domains = Domains(program, kinds)
        lines += [f"domains of {p}: {' '.join('{' + ', '.join(map(str, d)) + '}' for d in domains.signature(p))}" for p in sorted(kinds) if domains.signature(p)]
        lines += [f"warning: {p} is used but has no clause and no table." for p in undefined(program, set(tables or {}))]
        lines += [f"warning: {m}" for m in unclear]
        for n, group in enumerate(strata(program.clauses)):
            lines.append(f"stratum {n}" + (" (recursive)" if recursive(program.clauses, group) else ""))
            lines += ["  " + " ".join(str(program.clauses[i]).split()) for i in group]
        return "\n".join(lines)

    def _expanded(self, program: Program, tables: dict[str, DataFrame]) -> Program:
        return expand(program, self.language, set(tables))

    def _load(self, source: str, row, kinds: dict, base: dict[str, DataFrame]) -> None:
        p = row[0]
        if p not in kinds:
            return
        if source == "EDB":
            new = files.read(self.spark, files.place(self.facts, row[1]), row[2], p, kinds[p])
        else:
            new = files.listed(self.spark, files.place(self.facts, row[1]), row[2])
        base[p] = base[p].union(new) if p in base else new
