"""Relations kept between runs as Parquet, a partition for each tag (the source file a row comes from).

A run that has seen some files anew puts their partitions in place of the old ones and
leaves the others as they are; deleted files lose theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = "_tag"


class Cache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def contains(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def put(self, name: str, rows: DataFrame, tag) -> None:
        """``rows`` with their tag (a column or a number); of each tag in them the old rows go."""
        tagged = rows.withColumn(TAG, tag if not isinstance(tag, int) else F.lit(tag).cast("long"))
        tagged.repartition(F.col(TAG)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(TAG).parquet(f"{self.root}/{name}")

    def get(self, name: str, tags: list[int] | None = None, schema: str | None = None) -> DataFrame:
        """The rows of all tags or of some, which prunes partitions; without its own column for the tag."""
        reader = self.spark.read.schema(f"{schema}, {TAG} long") if schema else self.spark.read
        df = reader.parquet(f"{self.root}/{name}")
        return (df if tags is None else df.where(F.col(TAG).isin(tags))).drop(TAG)

    def clear(self, name: str, tags: list[int] | None = None) -> None:
        """Drops a relation, or its rows of some tags."""
        path, fs = self._path(name)
        if tags is None:
            fs.delete(path, True)
        for t in tags or []:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{TAG}={t}"), True)
