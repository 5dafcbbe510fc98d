"""Relations in CSV, Parquet and SQLite files, and lists of files.

CSV fields are quoted where they need it, so texts with commas come back as they were;
predicate references carry a leading quote mark.  An empty field is an empty text, never a
null.  Rows that don't fit a relation's types are errors.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import UNIT, schema_of
from ..plans.syntax import ProgramError

_CSV = {"emptyValue": "", "nullValue": "\u0001none", "mode": "FAILFAST", "escape": '"'}


def _marked(df: DataFrame, kinds: list[str]) -> DataFrame:
    return df.select(*[F.concat(F.lit("'"), F.col(f"c{i}")).alias(f"c{i}") if k == "PredicateRef" else F.col(f"c{i}") for i, k in enumerate(kinds)])


def _unmarked(df: DataFrame, kinds: list[str]) -> DataFrame:
    return df.select(*[F.regexp_replace(f"c{i}", r"\A'", "").alias(f"c{i}") if k == "PredicateRef" else F.col(f"c{i}") for i, k in enumerate(kinds)])


def read(spark: SparkSession, path: str, form: str, name: str, kinds: list[str]) -> DataFrame:
    """The rows of a file, repeated ones too; ``csv-lines`` is CSV whose fields may hold line ends, a file of which is one task."""
    if form in ("csv", "csv-lines"):
        df = _unmarked(spark.read.schema(schema_of(kinds)).options(**_CSV, multiLine=form != "csv").csv(path).na.fill(""), kinds)
    elif form == "parquet":
        df = spark.read.parquet(path)
        if len(df.columns) != len(kinds):
            raise ProgramError(f"{path} has {len(df.columns)} columns, {name} has {len(kinds)}.")
        want = [x.split(" ")[1] for x in schema_of(kinds).split(", ")]
        df = df.select(*[F.col(c).cast(t).alias(f"c{i}") for i, (c, t) in enumerate(zip(df.columns, want))])
    elif form == "sqlite":
        import sqlite3

        file, _, tag = path.partition("#tag=")
        with sqlite3.connect(file) as db:
            only = f" WHERE _tag = {int(tag)}" if tag else ""
            rows = db.execute(f'SELECT {", ".join(f"""\"{i}\"""" for i in range(len(kinds)))} FROM "{name}"{only}').fetchall()
        df = _unmarked(spark.createDataFrame(rows, schema_of(kinds)), kinds)
    else:
        raise ProgramError(f"Unknown format {form}.")
    return df


def write(df: DataFrame, path: str, form: str, name: str, kinds: list[str]) -> None:
    """CSV and Parquet are folders of part files; SQLite appends to a table, and with ``#tag=N`` after its path puts the rows in place of those of that tag."""
    if form in ("csv", "csv-lines"):
        (_marked(df, kinds) if kinds else df.select(UNIT)).write.mode("overwrite").options(emptyValue="", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif form == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif form == "sqlite":
        import sqlite3

        names = [f'"{i}"' for i in range(len(kinds))]
        file, _, tag = path.partition("#tag=")
        with sqlite3.connect(file) as db:
            columns = [n + (" INTEGER" if k in ("Integer", "ASTNode") else " TEXT") for n, k in zip(names, kinds)]
            db.execute(f'CREATE TABLE IF NOT EXISTS "{name}" ({", ".join([*columns, "_tag INTEGER"])})')
            db.execute(f'CREATE INDEX IF NOT EXISTS "{name}_by_tag" ON "{name}" (_tag)')
            if tag:
                db.execute(f'DELETE FROM "{name}" WHERE _tag = {int(tag)}')
            db.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" for _ in [*names, 0])})', ((*r, int(tag) if tag else None) for r in _marked(df, kinds).toLocalIterator()))
    else:
        raise ProgramError(f"Unknown format {form}.")


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, "A") of the files under a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern or "*").load(folder)
    return df.select(F.col("path").alias("c0"), F.lit("A").alias("c1"))


def named(spark: SparkSession, sources: dict[str, str] | str) -> DataFrame:
    """(path, change) of a list ``path,A:path,M`` or a mapping; a change is A (added), M (modified) or D (deleted)."""
    if isinstance(sources, str):
        sources = dict(x.rsplit(",", 1) if "," in x else (x, "A") for x in sources.split(":") if x)
    odd = sorted(set(sources.values()) - {"A", "M", "D"})
    if odd:
        raise ProgramError(f"Unknown changes {', '.join(odd)}.")
    return spark.createDataFrame(sorted(sources.items()), "c0 string, c1 string")


def place(folder: str | None, file: str) -> str:
    return file if "://" in file or os.path.isabs(file) or not folder else f"{folder.rstrip('/')}/{file}"
