"""Per-key joins with a key that holds half of all rows."""

import pytest
from pyspark.sql import functions as F

from tallyguard.operators.ordering import join_per_key


@pytest.mark.parametrize("count", [None, "n"])
def test_hot_key_is_spread_and_nothing_is_lost(spark, count):
    rows = spark.range(2000).select(
        F.when(F.col("id") < 1000, 0).when(F.col("id") < 1990, F.col("id") % 50 + 1).alias("k"),
        F.col("id").alias("x"))
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("top"))
    got = join_per_key(rows, per_key, "k", "x", count=count, hot_rows=100, salts=8)
    assert set(got.columns) == {"k", "x", "n", "top"}
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(r.x)
    seen = got.collect()
    assert sorted(r.x for r in seen) == list(range(2000))
    assert all((r.n, r.top) == ((len(want[r.k]), max(want[r.k])) if r.k is not None else (None, None))
               for r in seen)
