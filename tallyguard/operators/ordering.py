"""Helpers that keep every group bounded: previous rows, top rows, per-key joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 100_000
SALTS = 16
#: Rows of one key from which it is spread over tasks. Of n rows at most n / HOT_ROWS keys
#: have so many, which bounds the list of hot keys (100 thousand for 10**11 rows).
HOT_ROWS = 1_000_000


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], spread: str,
                 how: str = "left", salts: int = SALTS, count: str | None = None,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Joins a table with one row per key, spreading large keys over ``salts`` tasks.

    A key may hold a large share of ``rows``, and adaptive execution does not
    split a join whose other side is an aggregate. ``spread`` is a column that
    varies within a key. Where ``per_key`` says in ``count`` how many rows a key has,
    only keys over ``hot_rows`` are spread and repeated; the list of them is bounded
    and goes to every task. Without a count every key is repeated once per salt.
    """
    keys = [key] if isinstance(key, str) else key
    if count:
        large = F.col(count) > hot_rows
        hot = per_key.where(large).select(*keys, F.lit(True).alias("_hot"))
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        marked = rows.join(F.broadcast(hot), keys, "left").withColumn(
            "_salt", F.coalesce(salt, F.lit(0))).drop("_hot")
        spread_out = per_key.withColumn("_salt", F.explode(F.when(
            large, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
        return marked.join(spread_out, [*keys, "_salt"], how).drop("_salt")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def with_previous(df: DataFrame, key: str, seq: str, value: Column, name: str,
                  chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: ``value`` of the previous row of the same key in ``seq`` order.

    A plain ``lag`` sorts a whole key in one task. Here a key is cut into ranges
    of ``chunk`` sequence numbers, each at most ``chunk`` rows because a sequence
    number is unique in its key; only the last row of each range crosses over.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk))).withColumn(
        "_value", F.struct(value.alias("v")))
    inside = W.partitionBy(key, "_chunk").orderBy(seq)
    rows = rows.withColumn("_lag", F.lag("_value").over(inside))
    tails = rows.groupBy(key, "_chunk").agg(F.max_by("_value", seq).alias("_tail"))
    carried = tails.select(
        key, "_chunk",
        F.lag("_tail").over(W.partitionBy(key).orderBy("_chunk")).alias("_carry"))
    same = (F.col(f"r.{key}").eqNullSafe(F.col(f"c.{key}"))
            & F.col("r._chunk").eqNullSafe(F.col("c._chunk")))
    return (rows.alias("r").join(carried.alias("c"), same, "left")
            .withColumn(name, F.coalesce("_lag", "_carry")["v"])
            .select(*[F.col(f"r.{x}") for x in df.columns], name))


def top(df: DataFrame, order: list[Column], limit: int, position: str = "position") -> DataFrame:
    """The first ``limit`` rows with their rank; the window sees only those rows."""
    first = df.orderBy(*order).limit(limit)
    return first.withColumn(position, F.row_number().over(W.orderBy(*order)))
