"""Session helpers: builder for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of Parquet, a few hundred thousand rows, that one task of a shuffle takes.
TASK_BYTES = 4_000_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", name: str = "tallyguard", **conf: str) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    cores = str(cores)
    settings = {
        "spark.sql.shuffle.partitions": "8" if cores == "*" else cores,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only where the session names none and runs on one machine (tests) is one made here;
    on a cluster a folder of this machine would be out of the executors' reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyguard-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so nothing is overwritten."""
    return os.path.join(shared_dir(spark), "tallyguard", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a reusable table that
    survives lost executors, for inputs that several jobs read."""
    spark = df.sparkSession
    path = scratch(spark, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes in here delete the files of their shuffles when they end. Otherwise these stay on
    the executors' disks until the driver's garbage collector meets the plan."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize`; nothing that is still lazy may read them."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def storage_memory(spark: SparkSession) -> int:
    """Bytes that the executors have left for cached blocks."""
    found = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    total = 0
    while found.hasNext():
        total += found.next()._2()
    return total


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of a file or of the files of a folder; none if it is gone."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    return sorted((s.getPath().toString(), s.getLen(), s.getModificationTime())
                  for s in fs.listStatus(where))


def tasks_for(spark: SparkSession, path: str) -> int:
    """Tasks for a shuffle of the rows of a file or folder, by its size; one for each core at least."""
    size = sum(length for _, length, _ in file_states(spark, path))
    return max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
