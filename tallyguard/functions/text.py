"""Text column helpers: vendor keys and the money and percent formats."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.policy import LEGAL_SUFFIXES


def vendor_key(name: Column) -> Column:
    """Lower case, punctuation to blanks, legal-form words dropped; null gives ''."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.coalesce(
        F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_SUFFIXES)), " "), F.lit(""))


def money(x: Column, digits: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, digits))


def percent(x: Column) -> Column:
    """Whole percent, ties to even as in the alerts' wording."""
    return F.concat(F.format_number(x * 100, 0), F.lit("%"))


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)
