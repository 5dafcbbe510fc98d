"""Trees of programs as relations: ``A_PR`` (kind, node, place, child, token) and ``A_SLOC`` (node, first line and column, last line and column, file).

Each source is parsed by itself.  Sources are dealt out first, as texts are small beside their
trees and a table of them may be one file, which one task would parse.  A node's id is its file's id in
the upper 32 bits and its number in the file in the lower ones, so trees need no shuffle and
``bshru(node_to_id(n), 32)`` gives the file back.  A null text has no tree; a text that is
no program is an error that names its file.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.objects import Tree, read_program
from ..plans.syntax import ProgramError
from .store import written

_COLUMNS = ["kind", "node", "place", "child", "token", "end_line", "end_column"]
_SCHEMA = "kind string, node long, place long, child long, token string, end_line long, end_column long"
#: Rows that a task hands over at once.
CHUNK = 50_000
TASKS_A_CORE = 4


class FileIds:
    """Ids of files that stay the same between runs: names to numbers from 1, kept in a JSON file where ``path`` is given."""

    def __init__(self, path: str | None = None):
        self.path, self.ids = path, {}
        if path and os.path.exists(path):
            with open(path) as f:
                self.ids = json.load(f)

    def __call__(self, names: list[str]) -> dict[str, int]:
        new = sorted(set(names) - set(self.ids))
        top = max(self.ids.values(), default=0)
        self.ids.update({name: top + i for i, name in enumerate(new, 1)})
        if new and self.path:
            with open(self.path + ".new", "w") as f:
                json.dump(self.ids, f)
            os.replace(self.path + ".new", self.path)
        return {name: self.ids[name] for name in names}


def tree_rows(tree: Tree, base: int, file: str) -> Iterator[tuple]:
    """Rows of both relations; those of ``A_SLOC`` have no kind, and the file as their token.  Children are numbered before their parents."""
    number = base
    done: list[list[int]] = [[]]  # numbers of the children met, for each node on the way
    way: list[tuple[Tree, bool]] = [(tree, False)]
    while way:
        node, left = way.pop()
        if not left:
            way.append((node, True))
            way += [(c, False) for c in reversed(node.children)]
            done.append([])
            continue
        places = done.pop()
        number += 1
        me = number
        done[-1].append(me)
        for name, text in node.tokens:
            number += 1
            places.append(number)
            yield name, number, 0, 0, text, None, None
        for i, child in enumerate(places):
            yield node.kind, me, i, child, "", None, None
        if not places:
            yield node.kind, me, -1, -1, "", None, None
        first_line, first_column, last_line, last_column = node.span
        yield None, me, first_line, first_column, file, last_line, last_column


def _parsed(batches: Iterator[pd.DataFrame], places: bool = True) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for file_id, file, text in zip(batch["file_id"], batch["file"], batch["text"]):
            if text is None:
                continue
            try:
                tree = read_program(text)
            except ProgramError as e:
                raise ProgramError(f"{file}: {e}") from None
            for row in tree_rows(tree, int(file_id) << 32, file):
                if row[0] is None and not places:
                    continue
                rows.append(row)
                if len(rows) == CHUNK:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=_COLUMNS)


def trees(texts: DataFrame, places: bool = True) -> dict[str, DataFrame]:
    """``A_PR`` and ``A_SLOC`` of a DataFrame (file_id, file, text), written once; rows of a kind lie together, so that scans of a kind skip the rest.

    Without ``places``, for programs that don't use ``A_SLOC``, there is ``A_PR`` alone.
    """
    spark = texts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    dealt = texts.selectExpr("cast(file_id AS bigint) file_id", "cast(file AS string) file", "text").repartition(tasks, "file_id")
    rows = dealt.mapInPandas(partial(_parsed, places=places), _SCHEMA)
    rows = written(rows.sortWithinPartitions("kind"), "trees")
    found = {"A_PR": rows.where("kind IS NOT NULL").selectExpr("kind c0", "node c1", "place c2", "child c3", "token c4")}
    if places:
        found["A_SLOC"] = rows.where("kind IS NULL").selectExpr("node c0", "place c1", "child c2", "end_line c3", "end_column c4", "token c5")
    return found


def texts_of(spark: SparkSession, changes: dict[str, str], ids: FileIds) -> DataFrame:
    """(file_id, file, text) of the files in a mapping of names to changes (A, M or D); deleted ones are left out."""
    odd = sorted(set(changes.values()) - {"A", "M", "D"})
    if odd:
        raise ProgramError(f"Unknown changes {', '.join(odd)}.")
    there = sorted(name for name, change in changes.items() if change != "D")
    number = ids(there)
    if not there:
        return spark.createDataFrame([], "file_id long, file string, text string")
    # a name with a scheme is the file's whole address, another one its path on the default file system
    key = {n: re.sub(r"^file:/+", "file:/", n) if "://" in n else os.path.abspath(n) for n in there}
    read = spark.read.text(sorted(n if "://" in n else key[n] for n in there), wholetext=True).select(F.col("value").alias("text"), F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("uri"))
    names = spark.createDataFrame([(number[n], n, key[n]) for n in there], "file_id long, file string, key string")
    keys = F.array(F.regexp_replace("uri", "^file:/+", "file:/"), F.regexp_replace("uri", "^[A-Za-z0-9+.-]+:(//[^/]*)?/+", "/"))
    return read.select("text", F.explode(keys).alias("key")).join(names, "key").select("file_id", "file", "text")
