"""Intermediate tables of an operator, kept in the shared folder only while they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.session import scratch


class Tables:
    """Writes tables once and drops them again; lost executors lose none of them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, DataFrame] = {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = table
        return table

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Deletes every table but ``kept``; nothing that is still lazy may read them."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path, table in list(self.paths.items()):
            if not any(table is k for k in kept):
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(hadoop).delete(where, True)
                del self.paths[path]
