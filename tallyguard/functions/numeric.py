"""Numeric column helpers whose results do not depend on the engine's rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Round half up by plain arithmetic, so any SQL engine gives the same bits."""
    p = float(10 ** digits)
    return F.floor(x * p + F.lit(0.5)).cast("double") / F.lit(p)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null (least/greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ratio(num: Column, den: Column) -> Column:
    """Null instead of an error or infinity at a zero denominator."""
    return F.when(den != 0, num / den)


def count_where(cond: Column) -> Column:
    """Conditional count; a null condition does not count, an empty input gives 0."""
    return F.count(F.when(cond, F.lit(1)))


def nan_to_null(x: Column) -> Column:
    """Spark sorts NaN above all numbers, so a missing amount must be null."""
    return F.nanvl(x, F.lit(None).cast("double"))
