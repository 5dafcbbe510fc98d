"""Intermediate relations in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder for what is written between steps: under ``spark.checkpoint.dir``, or one of our own where it is unset in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/tuplewright-checkpoints"
    return f"{root.rstrip('/')}/tuplewright"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}-{label}"
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # nobody reads the shuffles of a written relation again
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``written``, and the number of rows, which the same job counts."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), label)
    return out, seen.get["rows"]
