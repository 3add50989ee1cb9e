"""Computing a costly expression once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns as the output of a one-row generator.

    A later filter or projection then refers to the value. With ``withColumn``
    the optimizer would copy the whole expression into each of them. Add flat
    values: fields of a struct that are read above may be pruned too early.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
