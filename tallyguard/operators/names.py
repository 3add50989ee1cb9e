"""Vendor names that are alike: links between names, and names on file for new ones.

Two names are linked if their edit ratio (1 - distance / longer length) reaches a bound.
Candidates come from an inverted index that loses nothing. A name on file is cut into one
segment more than the edits d it may differ by, so at least one of them stands unchanged in
every name within d edits. Segment i can be taken such that at most i edits lie before it and
d - i behind it, which leaves few places to look for it. Length, edits and place are part of
the key, so two names meet only over a segment of equal text in a possible place; the index
never changes for a new name.

Names are compared in normalised form; empty names are linked with nothing and equal
names always, with 1.0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions import similarity as sim
from tallyguard.functions.staging import once
from tallyguard.functions.text import vendor_key
from tallyguard.operators.store import Parted, near
from tallyguard.policy import NEAR_DUPLICATE
from tallyguard.session import materialize

#: Names below this ratio count as different vendors. No pair of them could reach the
#: near-duplicate score, which the vendor term bounds.
LINK_RATIO = NEAR_DUPLICATE
#: Below this bound a segment could become short or empty.
LEAST_RATIO = 0.75


def vendor_names(rows: DataFrame, column: str = "vendor") -> DataFrame:
    """Distinct normalised names as ``a``; each spelling is normalised once.

    The filter stays behind the generator; pushed below the first ``distinct`` it would
    normalise the name of every row.
    """
    spellings = rows.select(F.col(column).alias("_name")).distinct()
    return once(spellings, a=vendor_key(F.col("_name"))).select("a").where("a != ''").distinct()


def _edits(longer: Column, ratio: float) -> Column:
    """Most edits between two names within the ratio, by the longer one's length."""
    return F.floor(longer * F.lit(1.0 - ratio) + 1e-9).cast("int")


def _cuts(names: DataFrame) -> DataFrame:
    """Per row (_l, _d) the places ``_at`` and sizes ``_n`` of the segments ``_i``."""
    def start(i: Column) -> Column:
        return F.floor(i * F.col("_l") / (F.col("_d") + 1)).cast("int")

    i = F.col("_i")
    return names.select("*", F.explode(F.sequence(F.lit(0), "_d")).alias("_i")).select(
        "*", start(i).alias("_at"), (start(i + 1) - start(i)).alias("_n"))


def _key(at: Column) -> Column:
    """A hash; names that meet by a collision are told apart like all candidates."""
    return F.xxhash64("_l", "_d", "_i", F.substring(F.col("a"), at + 1, F.col("_n"))).alias("g")


def _segments(names: DataFrame, ratio: float) -> DataFrame:
    """(a, g): the segments of each name, for every number of edits a partner may allow."""
    size = F.length("a")
    most = _edits(F.floor(size / F.lit(ratio) + 1e-9), ratio)
    edits = names.select("a", size.alias("_l"), F.explode(
        F.sequence(_edits(size, ratio), most)).alias("_d")).where("_d > 0")
    return _cuts(edits).select("a", _key(F.col("_at")))


def _probes(names: DataFrame, ratio: float) -> DataFrame:
    """(a, g): where a name may hold a segment of a name on file within the ratio."""
    size = F.length("a")
    lengths = F.sequence(F.ceil(size * F.lit(ratio) - 1e-9).cast("int"),
                         F.floor(size / F.lit(ratio) + 1e-9).cast("int"))
    met = names.select("a", size.alias("_m"), F.explode(lengths).alias("_l")).withColumn(
        "_d", _edits(F.greatest("_m", "_l"), ratio)).where("_d > 0 AND abs(_m - _l) <= _d")
    at, before, behind = F.col("_at"), F.col("_i"), F.col("_d") - F.col("_i")
    moved = at + F.col("_m") - F.col("_l")
    first = F.greatest(F.lit(0), at - before, moved - behind)
    last = F.least(F.col("_m") - F.col("_n"), at + before, moved + behind)
    places = _cuts(met).select("*", first.alias("_first"), last.alias("_last")).where("_first <= _last")
    return places.select("*", F.explode(F.sequence("_first", "_last")).alias("_p")).select(
        "a", _key(F.col("_p")))


def _verified(pairs: DataFrame, ratio: float) -> DataFrame:
    """Candidate pairs (a, b) of different names that reach the ratio, with ``v``."""
    return pairs.where(F.col("a") != F.col("b")).withColumn(
        "v", sim.name_edit_ratio(F.col("a"), F.col("b"))).where(F.col("v") >= ratio).distinct()


def _checked(ratio: float) -> float:
    if not LEAST_RATIO <= ratio <= 1.0:
        raise ValueError(f"the ratio must lie in [{LEAST_RATIO}, 1]")
    return ratio


def _linked(asked: DataFrame, index: DataFrame, ratio: float) -> DataFrame:
    same = asked.select("a", F.col("a").alias("b"), F.lit(1.0).alias("v"))
    pairs = _probes(asked, ratio).join(index.select("g", F.col("a").alias("b")), "g").select("a", "b")
    return same.unionByName(_verified(pairs, ratio))


def links(names: DataFrame, ratio: float = LINK_RATIO) -> DataFrame:
    """Written table (a, b, v): every ordered pair of the names ``a`` that are alike."""
    _checked(ratio)
    names = materialize(names.select("a"), "names")
    return materialize(_linked(names, _segments(names, ratio), ratio), "name-links")


@dataclass(frozen=True)
class NameStore:
    """Names on file: their links with each other, and the index that new names probe."""
    links: Parted
    index: Parted
    ratio: float

    @classmethod
    def file(cls, names: DataFrame, ratio: float, parts: int) -> NameStore:
        names = materialize(names.select("a"), "names")
        index = Parted.write(_segments(names, _checked(ratio)), ["g"], parts, "name-index")
        made = _linked(names, index.rows().drop("_part"), ratio)
        return cls(Parted.write(made, ["a"], parts, "name-links"), index, ratio)

    def of(self, names: DataFrame) -> DataFrame:
        """Links (a, b, v) from the names ``a`` to names on file.

        Names on file are read from the link table; only others probe the index.
        """
        known = near(self.links, names).join(names, "a", "left_semi")
        fresh = names.join(known.where("a = b").select("a"), "a", "left_anti")
        met = self.index.near(_probes(fresh, self.ratio).select("g"))
        return known.unionByName(_linked(fresh, met, self.ratio))
