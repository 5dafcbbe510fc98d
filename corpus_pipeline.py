"""From raw documents to packed training sequences.

``STAGES`` are applied in order; each writes Parquet that the next one reads.  Together
they drop low-quality and toxic documents, keep one document of each group of near
duplicates, drop documents that hold test items, replace secrets by placeholders, and pack
what is left.  Every stage passes on all columns of ``documents`` but the last, which returns
pieces and their places.

Nulls, empty texts, repeated rows and empty tables have the results that the stages'
operators define; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tuplewright.llm import op1_decontaminate, op4_packing, op6_quality, op9_secrets, op10_jaccard
from tuplewright.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.wanted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_secrets.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_packing.pack_texts(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the trained classifier nor the tokenizer; tests/llm checks each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
