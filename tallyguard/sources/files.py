"""File scans and sinks with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.functions.numeric import nan_to_null
from tallyguard.schemas import INVOICE, LABEL
from tallyguard.session import materialize, shuffles_dropped

#: Partitions of an upsert table; fixed for its life.
BUCKETS = 64
#: Rounds in which the buckets of a versioned table are merged; their shuffles follow each other.
ROUNDS = 4


def read_csv(spark: SparkSession, path: str, schema: T.StructType = INVOICE) -> DataFrame:
    """CSV with a header; NaN numbers become null, since Spark sorts NaN highest."""
    df = spark.read.schema(schema).csv(path, header=True)
    for f in schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            df = df.withColumn(f.name, nan_to_null(F.col(f.name)))
    return df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, LABEL)


def read_documents(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """One row per text file: its name and its whole text."""
    return (spark.read.option("pathGlobFilter", suffix).text(path, wholetext=True)
            .select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"),
                    F.col("value").alias("text")))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def append(df: DataFrame, path: str) -> None:
    """Append-only sink for the event log and the run history."""
    df.write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Append-only table; columns added later are merged in as null for older files."""
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def upsert(rows: DataFrame, path: str, key: str = "invoice_id", buckets: int = BUCKETS) -> None:
    """Replaces rows of a table by ``key``; only the hash buckets that rows fall in are rewritten.

    ``rows`` has each key once. The table is partitioned by bucket, so what an upsert
    reads and writes follows the buckets it touches. The merged buckets are written
    aside first: a table is never read while it is overwritten, and a run that breaks
    off leaves it as it was or can be repeated.
    """
    spark = rows.sparkSession
    new = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in new.select("_bucket").distinct().collect()]     # at most ``buckets``
    try:
        old = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = new
    else:
        kept = old.alias("o").join(
            new.select(F.col(key).alias("_key")),
            F.col(f"o.{key}").eqNullSafe(F.col("_key")), "left_anti")
        merged = kept.unionByName(new, allowMissingColumns=True)
    (materialize(merged, "upsert").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path))


@dataclass(frozen=True)
class VersionedTable:
    """A table of one row per ``key`` in hash buckets that a stream updates exactly once.

    Micro-batch n writes every bucket it touches anew as version n, from the newest version
    below n. A batch that runs again therefore starts from what it started from before and
    replaces what it wrote. Readers see versions up to the last finished batch, whose
    number is recorded when all of its buckets are written. Versions that a finished one
    replaced stay until :meth:`compact`, so a reader that has begun still finds its files.
    """
    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    buckets: int = BUCKETS

    def _all(self) -> DataFrame:
        parts = [T.StructField("_bucket", T.IntegerType()), T.StructField("_version", T.LongType())]
        return self.spark.read.schema(T.StructType([*self.schema.fields, *parts])).parquet(
            f"{self.path}/rows")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        where = jvm.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path

    def _folders(self, below: str) -> list[str]:
        fs, path = self._fs()
        here = path(f"{self.path}/{below}")
        return [s.getPath().getName() for s in fs.listStatus(here)] if fs.exists(here) else []

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket, oldest first; at most ``buckets`` entries."""
        return {int(b.removeprefix("_bucket=")): sorted(
            int(v.removeprefix("_version=")) for v in self._folders(f"rows/{b}") if v.startswith("_version="))
            for b in self._folders("rows") if b.startswith("_bucket=")}

    def finished(self) -> int:
        """The last finished batch, -1 before the first."""
        return max((int(n) for n in self._folders("finished")), default=-1)

    def _at(self, newest: dict[int, int]) -> DataFrame:
        """The given version of each bucket; the scan skips every other folder."""
        chosen = [(F.col("_bucket") == b) & (F.col("_version") == v) for b, v in newest.items()]
        rows = self._all() if newest else self.spark.createDataFrame(
            [], T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())]))
        return rows.where(reduce(lambda a, b: a | b, chosen)).drop("_version") if newest else rows

    def rows(self) -> DataFrame:
        """The table as of the last finished batch."""
        last = self.finished()
        newest = {b: max(old) for b, vs in self.versions().items() if (old := [v for v in vs if v <= last])}
        return self._at(newest).drop("_bucket")

    def update(self, batch: DataFrame, batch_id: int,
               merge: Callable[[DataFrame], DataFrame]) -> None:
        """Applies micro-batch ``batch_id``: rows of the schema, any number per key.

        ``merge`` turns old and new rows together into one row per key. It has to be a
        mergeable aggregate, as the rows of a key come from several batches. The buckets are
        merged in a few rounds, each of which reads the batch and shuffles its share of the table.
        """
        if batch_id <= self.finished():
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.schema.names).withColumn("_bucket", bucket)
        touched = {r[0] for r in new.select("_bucket").distinct().collect()}
        newest = {b: max(old) for b, vs in self.versions().items()
                  if b in touched and (old := [v for v in vs if v < batch_id])}
        for i in range(min(ROUNDS, len(touched))):
            some = sorted(touched)[i::ROUNDS]
            old = self._at({b: newest[b] for b in some if b in newest}).select(*new.columns)
            both = old.unionByName(new.where(F.col("_bucket").isin(some)))
            merged = merge(both.drop("_bucket")).select(*self.schema.names).withColumn("_bucket", bucket)
            with shuffles_dropped(batch.sparkSession):
                (merged.withColumn("_version", F.lit(batch_id)).write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version")
                 .parquet(f"{self.path}/rows"))
        fs, path = self._fs()
        fs.create(path(f"{self.path}/finished/{batch_id}"), True).close()

    def compact(self) -> int:
        """Deletes versions that a finished one replaced; returns how many."""
        fs, path = self._fs()
        last, dropped = self.finished(), 0
        for b, vs in self.versions().items():
            done = [v for v in vs if v <= last]
            for v in done[:-1]:
                fs.delete(path(f"{self.path}/rows/_bucket={b}/_version={v}"), True)
                dropped += 1
        return dropped
