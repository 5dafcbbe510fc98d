"""Re-evaluation after some sources have changed.

The local part of a program (see ``plans.locality``) is kept between runs, in partitions by
tag bucket.  An update derives the local relations anew for the changed tags, from the rows
of those tags alone; partitions that hold such a tag are written anew, with what they held
of other tags.  The global part then runs on the kept relations.  The result equals that of
a full run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, _kinds
from .operators.rules import schema_of
from .plans.analysis import check
from .plans.domains import SUFFIX, by_file
from .plans.locality import split
from .plans.patterns import expand
from .plans.syntax import Program, parse
from .sources.cache import TAG, Cache
from .sources.store import written
from .sources.trees import trees


class Incremental:
    """``tagged``: the tag column of each input table that has one; ``root``: the folder for what is kept; the number of ``buckets`` stays the same for a folder."""

    def __init__(self, spark: SparkSession, program: str | Program, tagged: dict[str, int], root: str, buckets: int = 64):
        self.spark, self.tagged, self.buckets = spark, tagged, buckets
        self.program = parse(program) if isinstance(program, str) else program
        self.local, self.rest, self.tag_of = split(self.program, tagged)
        self.cache = Cache(spark, root)

    def _bucket(self, tag: Column) -> Column:
        return F.pmod(F.xxhash64(tag.cast("string")), F.lit(self.buckets))

    def run(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A full run."""
        return self._run(tables, {p: self._plain(tables[p]) for p in self.tagged}, None)

    def update(self, tables: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
        """``tables`` as they are now; ``changed``: one column with every tag that was added, modified or deleted since the last run."""
        tags = self.tags(changed)
        return self._run(tables, {p: self._plain(tables[p]).join(tags, F.col(f"c{i}").cast("string") == F.col(TAG), "left_semi") for p, i in self.tagged.items()}, tags)

    @staticmethod
    def tags(changed: DataFrame) -> DataFrame:
        """Changed tags as texts, each once, written as several joins use them."""
        return written(changed.select(F.col(f"`{changed.columns[0]}`").cast("string").alias(TAG)).distinct(), "changed")

    @staticmethod
    def _plain(rows: DataFrame) -> DataFrame:
        return rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])

    def _run(self, tables: dict[str, DataFrame], now: dict[str, DataFrame], changed: DataFrame | None) -> dict[str, DataFrame]:
        """``now``: the rows of the tagged tables to derive from, all or those of the tags ``changed``."""
        kinds_of = {"bigint": "Integer", "int": "Integer", "smallint": "Integer", "tinyint": "Integer", "string": "String"}
        kinds = check(self.program, {p: _kinds(p, [kinds_of[t] for _, t in df.dtypes]) for p, df in tables.items()})
        touched = None if changed is None else sorted(r[0] for r in changed.select(self._bucket(F.col(TAG))).distinct().collect())
        if self.local.clauses and touched != []:
            for p, rows in Engine(self.spark).run(self.local, now, set(self.tag_of), set(self.tag_of)).items():
                if p not in self.tag_of:
                    continue
                tag = F.col(f"c{self.tag_of[p]}")
                bucket = self._bucket(tag)
                if touched is None:
                    self.cache.clear(p)
                elif self.cache.contains(p):
                    old = self.cache.get(p, touched, schema_of(kinds[p]))
                    rows = written(old.join(changed, tag.cast("string") == F.col(TAG), "left_anti").unionByName(rows), p)
                self.cache.put(p, rows, bucket)
                if touched:  # buckets that have no rows any more
                    self.cache.clear(p, sorted(set(touched) - {r[0] for r in rows.select(bucket).distinct().collect()}))
        kept = {p: self.cache.get(p, schema=schema_of(kinds[p])) for p in self.tag_of if self.cache.contains(p)}
        kept |= {p: self.spark.createDataFrame([], schema_of(kinds[p])) for p in self.tag_of if p not in kept}
        if not self.rest.clauses:
            return kept
        used = {p: df for p, df in {**tables, **kept}.items()}
        return {**Engine(self.spark).run(self.rest, used, types={p: kinds[p] for p in kept}), **kept}


class IncrementalTrees:
    """A program with patterns over sources (file_id, file, text), of which an update parses only the changed files."""

    def __init__(self, spark: SparkSession, program: str | Program, root: str, buckets: int = 64):
        program = expand(parse(program) if isinstance(program, str) else program, bound={"A_PR", "A_SLOC"})
        program, self.trees = by_file(program, check(program))
        self.inner = Incremental(spark, program, {p + SUFFIX: 0 for p in self.trees}, root, buckets)

    def _tables(self, texts: DataFrame) -> dict[str, DataFrame]:
        found = trees(texts, "A_SLOC" in self.trees)
        node = {"A_PR": "c1", "A_SLOC": "c0"}
        return {p + SUFFIX: found[p].select(F.shiftrightunsigned(node[p], 32).alias("file"), "*") for p in self.trees}

    def run(self, texts: DataFrame) -> dict[str, DataFrame]:
        """A full run."""
        return self.inner.run(self._tables(texts))

    def update(self, texts: DataFrame, changed: DataFrame) -> dict[str, DataFrame]:
        """``texts`` as they are now; ``changed``: one column with the id of every file that was added, modified or deleted since the last run."""
        tags = self.inner.tags(changed.select(F.col(f"`{changed.columns[0]}`").cast("long")))
        tables = self._tables(texts.select("file_id", "file", "text").join(tags, F.col("file_id").cast("long").cast("string") == F.col(TAG), "left_semi"))
        return self.inner._run(tables, {p: self.inner._plain(df) for p, df in tables.items()}, tags)
