"""Similarity of two invoices.

score = vendor * (0.75 * amount + 0.25 * date); the vendor term gates the rest.
All terms are built-in expressions. The vendor term is the edit ratio of the normalised
names; the matching-blocks ratio stays as an optional Arrow UDF for distinct name pairs.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.policy import AMOUNT_TOLERANCE, DATE_WINDOW_DAYS, W_AMOUNT, W_DATE


def amount_similarity(a: Column, b: Column) -> Column:
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    sim = F.greatest(F.lit(0.0), 1.0 - (F.abs(a - b) / scale) / AMOUNT_TOLERANCE)
    return F.when(a.isNotNull() & b.isNotNull(), sim).otherwise(F.lit(0.0))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def date_proximity(a: Column, b: Column) -> Column:
    gap = days_apart(a, b)
    return F.when(
        gap.isNotNull(), F.greatest(F.lit(0.0), 1.0 - gap / float(DATE_WINDOW_DAYS))
    ).otherwise(F.lit(0.0))


def weigh(vendor: Column, amount: Column, date: Column) -> Column:
    return vendor * (W_AMOUNT * amount + W_DATE * date)


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two normalised names (argument order matters)."""
    return pd.Series([
        0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
        for x, y in zip(a, b)
    ], dtype="float64")


def name_edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 for an empty or missing name."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(shorter > 0, 1.0 - F.levenshtein(a, b) / longer).otherwise(F.lit(0.0))
