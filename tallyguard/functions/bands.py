"""Probability bands."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyguard.functions.numeric import clip
from tallyguard.policy import BANDS, lookup


def band_for(p: Column) -> Column:
    clamped = clip(p, 0.0, 1.0)
    out = None
    for key, _, upper in BANDS[:-1]:
        cond = clamped < upper
        out = F.when(cond, key) if out is None else out.when(cond, key)
    return F.when(p.isNotNull(), out.otherwise(BANDS[-1][0]))


def band_label(band: Column) -> Column:
    return lookup(band, {k: label for k, label, _ in BANDS})


def band_rank(band: Column) -> Column:
    return lookup(band, {k: i for i, (k, _, _) in enumerate(BANDS)})


def at_or_above(band: Column, floor: str) -> Column:
    return band_rank(band) >= [k for k, _, _ in BANDS].index(floor)
