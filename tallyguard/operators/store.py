"""Written tables that are split by a key, so that a small batch reads a small part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.session import scratch, shuffles_dropped


@dataclass(frozen=True)
class Parted:
    """A table in ``parts`` folders by the hash of its ``keys``, sorted by them inside.

    Choose ``parts`` so that one holds some 100 megabytes. A part with a hot key is
    written as several files by several tasks.
    """
    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    parts: int

    @classmethod
    def write(cls, df: DataFrame, keys: list[str], parts: int, label: str) -> Parted:
        spark = df.sparkSession
        made = cls(spark, scratch(spark, label), df.schema, tuple(keys), parts)
        rows = df.withColumn("_part", made._part())
        with shuffles_dropped(spark):
            (rows.hint("rebalance", F.col("_part")).sortWithinPartitions("_part", *keys)
             .write.partitionBy("_part").parquet(made.path))
        return made

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def rows(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("_part", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def near(self, asked: DataFrame) -> DataFrame:
        """The parts that hold the key values of ``asked``: all of their rows and some others.

        The list of parts is bounded by ``parts``; the scan skips all other folders.
        """
        return self.read(self.parts_of(asked))

    def parts_of(self, asked: DataFrame) -> list[int]:
        return [r[0] for r in asked.select(self._part()).distinct().collect()]

    def read(self, parts: list[int]) -> DataFrame:
        return self.rows().where(F.col("_part").isin(parts)).drop("_part")

    def beyond(self, parts: list[int]) -> Column:
        """Whether a row with the key columns lies in none of the parts."""
        return ~self._part().isin(parts)


def near(table: Parted | DataFrame, asked: DataFrame) -> DataFrame:
    return table.near(asked) if isinstance(table, Parted) else table
