"""Closest earlier-filed invoice per invoice: an exact nearest-match join.

The score is ``v * (0.75 a + 0.25 d)``. A result of at least ``min_score``
bounds the amount gap and, above 0.75, the date gap, so invoices are compared
only inside (vendor key, amount bucket, date bucket) blocks; nothing that could
reach the score is lost. Groups of names that are linked with no others and have few
invoices are searched apart and whole by array arithmetic (:mod:`.whole`), each invoice sent
once, with its columns, to its group. Names of larger groups that meet few invoices are
searched likewise, each invoice sent once to each name that meets it. The measures below serve the other names: they keep the work near linear
when one vendor, day or group of copies holds a large share of all rows:

* equal (vendor key, amount, date) rows collapse into one profile before any
  join, keeping its two first ids; a copy is answered from its own profile;
* blocks with more than ``dense_limit`` profiles are not paired. On a fixed day
  the score only falls as the amount gap widens, so the neighbour below and the
  neighbour above in amount order are enough: a nearest search per vendor and day;
* matches more than 89 days apart score on the amount alone, so one more nearest search
  over (vendor, amount) finds them without pairing dates;
* pairs whose amounts are too far apart score on the date alone, so the nearest days
  of the vendor before and after are enough: a nearest search over distinct days.

The last two are only run for rows whose best near match a far one could still reach. A
nearest search works on chunks of its axis (:func:`_nearest`), so one vendor is many tasks.
All give the same answer as comparing every pair; ties go to the smallest invoice id.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyguard.functions import similarity as sim
from tallyguard.functions.numeric import half_up
from tallyguard.functions.staging import once
from tallyguard.functions.text import percent, vendor_key
from tallyguard.policy import (
    AMOUNT_TOLERANCE, CONFIRMED_DUPLICATE, DATE_WINDOW_DAYS, NEAR_DUPLICATE, W_AMOUNT, W_DATE,
)
from tallyguard.operators.names import LINK_RATIO, NameStore, vendor_names
from tallyguard.operators.ordering import CHUNK, join_per_key
from tallyguard.operators.store import Parted, near
from tallyguard.operators.whole import (
    ASKED, BEST, FOUND, GROUPED, best_of_groups, best_of_points,
)
from tallyguard.session import drop, materialize

DEFAULT_MIN_SCORE = 0.0         # any likeness at all
DENSE_LIMIT = 400
WHOLE_BLOCKS = 10               # names that meet up to so many dense limits are searched whole
GROUP_NAMES = 64                # names of a group, each of which has its likeness to all of them
LABEL_ROUNDS = 2                # links that lead from a group's names to its label, less one
ASKED_TOGETHER = 50_000         # rows that ask under one name in one task
TASK_ROWS = 400_000
AMOUNT_STEP = 0.001             # amounts have at most three decimals; a chunk counts these
STORE_PARTS = 32

_KEY = ["_vkey", "_amount", "_date", "_excl"]
_EPOCH = "1970-01-01"


class _Blocks:
    """How far apart matches may lie, and blocks twice that wide.

    A search row then meets two blocks per dimension on average; narrower blocks
    would pair fewer rows but copy every search row more often.
    """

    def __init__(self, min_score: float):
        if not 0.0 <= min_score <= 1.0:
            raise ValueError("min_score must lie in [0, 1]")
        self.min_score = min_score
        # Up to the date's weight a pair may share nothing but a date.
        self.by_date = min_score <= W_DATE
        self.gap = AMOUNT_TOLERANCE * (1.0 - (max(min_score, W_DATE) - W_DATE) / W_AMOUNT)
        self.reach = -math.log(1.0 - self.gap - 1e-9)
        self.far = min_score <= W_AMOUNT
        self.days = DATE_WINDOW_DAYS - 1 if self.far else math.floor(
            DATE_WINDOW_DAYS * (1.0 - (min_score - W_AMOUNT) / W_DATE) + 1e-9)

    def amount_bucket(self, amount: Column, shift: float = 0.0) -> Column:
        log = F.log(F.greatest(F.abs(amount), F.lit(1.0)))
        return F.floor((log + F.lit(shift)) / F.lit(2 * self.reach)).cast("int")

    def amount_buckets(self, amount: Column) -> Column:
        reach = self.reach + 1e-9
        return F.sequence(self.amount_bucket(amount, -reach), self.amount_bucket(amount, reach))

    @property
    def day_width(self) -> int:
        return 2 * self.days + 1

    def date_bucket(self, day: Column) -> Column:
        return F.floor(day / F.lit(self.day_width)).cast("int")

    def date_buckets(self, day: Column) -> Column:
        return F.sequence(self.date_bucket(day - self.days), self.date_bucket(day + self.days))

    def keeps(self, score: Column) -> Column:
        return score > self.min_score if self.min_score in (0.0, W_DATE) else score >= self.min_score


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit(_EPOCH).cast("date"))


def _first_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the two smallest distinct ids, as structs ``r1`` and ``r2``.

    The limit on the row number is applied before the shuffle as well, so a key
    with any number of copies sends at most two rows per map task.
    """
    one = rows.groupBy(*keys, "id").agg(F.min(F.struct("date", "vendor")).alias("_r"))
    order = W.partitionBy(*keys).orderBy("id")
    two = one.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    rep = F.struct("id", F.col("_r.date").alias("date"), F.col("_r.vendor").alias("vendor"))
    return (two.select(*keys, "_rn", rep.alias("r1"), F.lead(rep).over(order).alias("r2"))
            .where("_rn = 1").drop("_rn"))


def _pick(profile: Column, excl: Column) -> Column:
    """First id of a profile that is not the excluded one."""
    return F.when(profile["r1"]["id"].eqNullSafe(excl), profile["r2"]).otherwise(profile["r1"])


def _scored(pairs: DataFrame, blocks: _Blocks) -> DataFrame:
    """Score (search row, candidate) pairs and keep those that reach the score."""
    amt = sim.amount_similarity(F.col("_amount"), F.col("c_amount"))
    dat = sim.date_proximity(F.col("_date"), F.col("c.date"))
    scored = (pairs.where(F.col("c.id").isNotNull())
              .withColumn("_score", sim.weigh(F.col("_v"), amt, dat))
              .where(blocks.keeps(F.col("_score"))))
    return scored.select(*_KEY, F.struct(
        (-F.col("_score")).alias("neg"), F.col("c.id").alias("id"),
        F.col("c.vendor").alias("vendor"), F.col("c_amount").alias("amount"),
        F.col("c.date").alias("date"), F.col("_v").alias("v")).alias("best"))


def _steps(rows: DataFrame, group: W, order: list[Column], side: str) -> DataFrame:
    """Adds the last profile ``_p`` at or before each row, and the one to step back to.

    The second one answers whoever has to skip the only id of the first: it precedes the
    whole run of profiles that hold nothing but that id. Running frames keep one profile
    in memory however long a group is.
    """
    ordered = group.orderBy(*order)
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    upto = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_prev", F.last("_p", ignorenulls=True).over(before))
    head = F.col("_p").isNotNull() & ~F.coalesce(_sole("_p") == _sole("_prev"), F.lit(False))
    return (rows
            .withColumn(f"_{side}", F.last("_p", ignorenulls=True).over(upto))
            .withColumn(f"_{side}_alt", F.last(F.when(head, F.struct(F.col("_prev").alias("p"))),
                                               ignorenulls=True).over(upto)["p"])
            .drop("_prev"))


def _sole(p: str) -> Column:
    """The id of a profile that holds no other."""
    return F.when(F.col(f"{p}.r2").isNull(), F.col(f"{p}.r1.id"))


def _nearest(points: DataFrame, asked: DataFrame, cells: list[str], chunk: Column) -> DataFrame:
    """Per asked position of a cell the nearest profiles at or below and at or above.

    ``points`` (cells, _pos, _p) and ``asked`` (cells, _pos) each hold a position once,
    so a cell is as long as its axis is, however many rows share a position. The axis is
    cut into chunks of a fixed width, searched apart; of each chunk only the profiles that
    matter beyond its ends go on to a second step over whole cells. ``_lo_alt`` and
    ``_hi_alt`` answer whoever has to skip the only id of ``_lo`` and ``_hi``.
    """
    every = points.withColumn("_q", F.lit(False)).unionByName(
        asked.select(*cells, "_pos", F.lit(None).cast(points.schema["_p"].dataType).alias("_p"),
                     F.lit(True).alias("_q")))
    # One shuffle by chunk serves the grouping and both windows.
    part = [*cells, "_chunk"]
    rows = every.withColumn("_chunk", chunk).repartition(*part).groupBy(*part, "_pos").agg(
        F.first("_p", ignorenulls=True).alias("_p"), F.bool_or("_q").alias("_q"))
    pos = F.col("_pos")
    for side, order in (("lo", pos.asc()), ("hi", pos.desc())):
        rows = _steps(rows, W.partitionBy(*part), [order], side)
    # Read three times from here on.
    rows = materialize(rows.drop("_p"), "nearest")
    ends = None
    for side in ("lo", "hi"):
        last = F.max_by(F.struct(f"_{side}", f"_{side}_alt"), pos if side == "lo" else -pos)
        end = rows.groupBy(*part).agg(last.alias("_end"))
        # The chunk's last profile and the one before its run, in axis order.
        two = F.array(F.struct(F.lit(0).alias("i"), F.col(f"_end._{side}_alt").alias("p")),
                      F.struct(F.lit(1).alias("i"), F.col(f"_end._{side}").alias("p")))
        summary = end.select(*part, F.explode(two).alias("_x")).select(
            *part, F.col("_x.i").alias("_i"), F.col("_x.p").alias("_p"))
        along = F.col("_chunk").asc() if side == "lo" else F.col("_chunk").desc()
        carried = _steps(summary, W.partitionBy(*cells), [along, F.col("_i")], "c")
        # What a chunk receives is what the chunk before it in this direction passes on.
        passed = carried.where("_i = 1").select(
            *part, F.lag(F.struct("_c", "_c_alt")).over(
                W.partitionBy(*cells).orderBy(along)).alias(f"_{side}_in"))
        ends = passed if ends is None else ends.join(passed, part)
    rows = rows.where("_q").join(ends, part)
    for side in ("lo", "hi"):
        inner, alt, given = F.col(f"_{side}"), F.col(f"_{side}_alt"), F.col(f"_{side}_in")
        skips = F.coalesce(_sole(f"_{side}") == _sole(f"_{side}_in._c"), F.lit(False))
        beyond = F.when(skips, given["_c_alt"]).otherwise(given["_c"])
        rows = rows.withColumn(f"_{side}_alt", F.when(inner.isNull(), given["_c_alt"]).otherwise(
            F.coalesce(alt, beyond))).withColumn(f"_{side}", F.coalesce(inner, given["_c"]))
    return rows.select(*cells, "_pos", "_lo", "_lo_alt", "_hi", "_hi_alt")


def _hits(search: DataFrame, points: DataFrame, cells: list[str], pos: str, chunk: Column,
          blocks: _Blocks, amount: Callable[[Column], Column]) -> DataFrame:
    """Scores each search row against its nearest usable profiles on one axis."""
    asked = search.select(*cells, F.col(pos).alias("_pos")).distinct()
    found = _nearest(points, asked, cells, chunk).withColumnRenamed("_pos", "_at")
    near = search.withColumn("_at", F.col(pos)).join(found, [*cells, "_at"])
    picked = [F.struct(F.coalesce(_pick(F.col(f"_{s}"), F.col("_excl")),
                                  _pick(F.col(f"_{s}_alt"), F.col("_excl"))).alias("c"))
              for s in ("lo", "hi")]
    pairs = near.select(*_KEY, "_v", F.explode(F.array(*picked)).alias("_c")).select(
        *_KEY, "_v", F.col("_c.c").alias("c")).where("c IS NOT NULL")
    return _scored(pairs.withColumn("c_amount", amount(F.col("c"))), blocks)


def _with_amount(profiles: DataFrame) -> DataFrame:
    """Profiles as ``_p`` whose two ids carry their amount."""
    def rep(r: str) -> Column:
        return F.when(F.col(r).isNotNull(), F.struct(
            F.col(f"{r}.id").alias("id"), F.col(f"{r}.date").alias("date"),
            F.col(f"{r}.vendor").alias("vendor"), F.col("amount").alias("amount")))

    return profiles.withColumn("_p", F.struct(rep("r1").alias("r1"), rep("r2").alias("r2")))


def _by_amount(profiles: DataFrame) -> DataFrame:
    """Per vendor and amount the two smallest ids, whatever their date."""
    reps = profiles.select("vkey", "amount", F.explode(F.array("r1", "r2")).alias("r"))
    return _first_two(
        reps.where("r IS NOT NULL").select("vkey", "amount", "r.id", "r.date", "r.vendor"),
        ["vkey", "amount"])


def _by_day(profiles: DataFrame) -> DataFrame:
    """Per vendor and day the two smallest ids as ``_p``, with their amounts."""
    reps = profiles.where("date IS NOT NULL").select(
        "vkey", "date", "amount", F.explode(F.array("r1", "r2")).alias("r")).where("r IS NOT NULL")
    one = reps.groupBy("vkey", "date", "r.id").agg(F.min(F.struct("amount", "r.vendor")).alias("x"))
    order = W.partitionBy("vkey", "date").orderBy("id")
    rep = F.struct("id", "date", F.col("x.vendor").alias("vendor"), F.col("x.amount").alias("amount"))
    two = one.withColumn("_rn", F.row_number().over(order)).where("_rn <= 2")
    filed = two.select("vkey", "date", "_rn", rep.alias("r1"), F.lead(rep).over(order).alias("r2"))
    return filed.where("_rn = 1").select("vkey", "date", F.struct("r1", "r2").alias("_p"))


def _search_keys(
    rows: DataFrame, profiles: DataFrame, blocks: _Blocks, same_table: bool
) -> DataFrame:
    """Distinct (vendor key, amount, date, id to skip) that their own profile does not answer."""
    if same_table:
        # An id is only ever alone in its profile here, unless the date is missing.
        alone = profiles.where("r2 IS NULL AND date IS NOT NULL").select(
            F.col("vkey").alias("_vkey"), F.col("amount").alias("_amount"),
            F.col("date").alias("_date"), F.col("r1.id").alias("_excl"))
        if not blocks.far:      # without a date no score above 0.75 is possible
            return alone
        undated = rows.where("_date IS NULL").select(*_KEY).distinct()
        return alone.unionByName(undated)
    own = profiles.select(
        F.col("vkey").alias("_vkey"), F.col("amount").alias("_amount"),
        F.col("date").alias("_date"), "r1", "r2")
    open_rows = rows.join(own, ["_vkey", "_amount", "_date"], "left").where(
        _pick(F.struct("r1", "r2"), F.col("_excl")).isNull())
    return open_rows.select(*_KEY).distinct()


@dataclass(frozen=True)
class Filed:
    """Invoices on file as the search reads them, made once for any number of searches.

    As tables (:func:`file_invoices`) they are read whole; in a store (:func:`store_invoices`)
    a search reads the parts that its vendors and amounts can meet.
    """
    blocks: _Blocks
    dense_limit: int
    profiles: DataFrame | Parted        # vkey, amount, date, r1, r2, _k, _h; in a store _dense
    by_amount: DataFrame | Parted       # vkey, amount, r1, r2, _k
    by_day: DataFrame | Parted          # vkey, date, _p
    ids: DataFrame | Parted             # _excl
    names: NameStore | None = None


def _filed(invoices: DataFrame, blocks: _Blocks, dense_limit: int) -> Filed:
    usable = invoices.select(
        vendor_key(F.col("vendor")).alias("vkey"), "amount", F.col("posting_date").alias("date"),
        F.col("invoice_id").alias("id"), "vendor",
    ).where("vkey != '' AND amount IS NOT NULL AND NOT isnan(amount)")
    # The date is part of the key and of the representative.
    one = _first_two(usable.withColumn("pdate", F.col("date")), ["vkey", "amount", "pdate"])
    profiles = materialize(one.withColumnRenamed("pdate", "date"), "profiles")
    blocked = profiles.withColumns({
        "_k": blocks.amount_bucket(F.col("amount")), "_h": blocks.date_bucket(_day(F.col("date")))})
    by_amount = _by_amount(profiles).withColumn("_k", blocks.amount_bucket(F.col("amount")))
    ids = invoices.select(F.col("invoice_id").alias("_excl")).where("_excl IS NOT NULL").distinct()
    return Filed(blocks, dense_limit, blocked, by_amount, _by_day(profiles), ids)


def _flagged(blocked: DataFrame, dense_limit: int) -> DataFrame:
    """Adds ``_dense``: whether the profile's block holds more than the limit."""
    block = ["vkey", "_k", "_h"]
    dense = blocked.where("date IS NOT NULL").groupBy(*block).count().where(
        F.col("count") > dense_limit)
    crowded = materialize(dense.select(*block, F.lit(True).alias("_dense")), "crowded-blocks")
    return blocked.join(crowded, block, "left").withColumn(
        "_dense", F.coalesce("_dense", F.lit(False)))


def file_invoices(invoices: DataFrame, min_score: float = DEFAULT_MIN_SCORE,
                  dense_limit: int = DENSE_LIMIT) -> Filed:
    """Invoices as one search reads them; their profiles are written once."""
    return _filed(invoices, _Blocks(min_score), dense_limit)


def store_invoices(invoices: DataFrame, parts: int = STORE_PARTS, *,
                   min_score: float = DEFAULT_MIN_SCORE, dense_limit: int = DENSE_LIMIT,
                   link_ratio: float | None = LINK_RATIO) -> Filed:
    """Invoices on file in tables that are split by what a search looks them up by.

    Profiles are split by vendor and amount block with a flag for crowded blocks, days by
    vendor, ids by themselves; with ``link_ratio`` the names on file, their links and their
    index come along, so that also arrivals under a new spelling find them.
    """
    plain = _filed(invoices, _Blocks(min_score), dense_limit)
    names = None if link_ratio is None else NameStore.file(vendor_names(invoices), link_ratio, parts)
    stored = Filed(
        plain.blocks, dense_limit,
        Parted.write(_flagged(plain.profiles, dense_limit), ["vkey", "_k"], parts, "filed-profiles"),
        Parted.write(plain.by_amount, ["vkey", "_k"], parts, "filed-amounts"),
        Parted.write(plain.by_day, ["vkey"], parts, "filed-days"),
        Parted.write(plain.ids, ["_excl"], parts, "filed-ids"), names)
    drop(plain.profiles)
    return stored


def _plain() -> dict[str, Column]:
    """Date and id to skip as values that a join can meet also where they are missing."""
    return {"_on_date": F.coalesce("_date", F.lit("0001-01-01").cast("date")),
            "_on_excl": F.coalesce("_excl", F.lit("")), "_on_none": F.col("_excl").isNull()}


def _met(asking: DataFrame, profiles: DataFrame, links: DataFrame | None, limit: int) -> DataFrame:
    """Written table of the names that ask: rows that do, ids they meet, whether these are many."""
    asked = asking.groupBy(F.col("_vkey").alias("a")).agg(F.count(F.lit(1)).alias("_asked"))
    filed = profiles.groupBy(F.col("vkey").alias("b")).agg(F.count(F.lit(1)).alias("_filed"))
    if links is None:
        met = filed.select(F.col("b").alias("a"), "_filed")
    else:
        met = links.select("a", "b").join(filed, "b").groupBy("a").agg(F.sum("_filed").alias("_filed"))
    return materialize(asked.join(met, "a").select(
        F.col("a").alias("_vkey"), "_asked", "_filed", (F.col("_filed") > limit).alias("_many")), "met")


def _points(profiles: DataFrame) -> DataFrame:
    """One row per id of a profile."""
    def rep(r: str) -> Column:
        amount = F.col(r)["amount"] if "amount" not in profiles.columns else F.col("amount")
        return F.when(F.col(r).isNotNull(), F.struct(
            F.col(r)["id"].alias("id"), F.col(r)["vendor"].alias("vendor"),
            amount.alias("amount"), F.col(r)["date"].alias("date")))

    return profiles.select("vkey", F.explode(F.array(rep("r1"), rep("r2"))).alias("p")).where(
        "p.id IS NOT NULL").select("vkey", "p.*")


def _best_of_few(asking: DataFrame, points: list[DataFrame], met: DataFrame,
                 links: DataFrame | None, blocks: _Blocks) -> DataFrame:
    """Best match of each asking row under a name of ``met``, over all points the name meets.

    Points go to each name that asks for them; a name under which very many rows ask is
    dealt over several tasks, each with all points.
    """
    parts = F.ceil(F.col("_asked") / F.lit(ASKED_TOGETHER)).cast("int")
    names = met.select(F.col("_vkey").alias("name"), parts.alias("parts"))
    rows = met.agg(F.sum(F.col("_asked") + parts * F.col("_filed"))).first()[0] or 0
    spark = met.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    if links is None:
        routes = names.select(F.col("name").alias("vkey"), "name", "parts", F.lit(1.0).alias("v"))
    else:
        routes = names.join(links.select(
            F.col("a").alias("name"), F.col("b").alias("vkey"), "v"), "name")
    order = ["name", "part", "kind", "id", "vendor", "amount", "date"]
    every = asking.join(names, asking["_vkey"] == names["name"]).select(
        "name", F.pmod(F.xxhash64("_amount", "_date", "_excl"), F.col("parts")).cast("int").alias("part"),
        F.lit(1).alias("kind"), F.col("_excl").alias("id"), F.lit(None).cast("string").alias("vendor"),
        F.col("_amount").alias("amount"), F.col("_date").alias("date"),
        F.lit(None).cast("double").alias("v"))
    for some in points:
        every = every.unionByName(some.join(routes, "vkey").select(
            "name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.lit(0).alias("kind"), "id", "vendor", "amount", "date", "v"))
    schema = StructType.fromDDL(FOUND)
    columns = [f.name for f in StructType.fromDDL(ASKED)]
    found = (every.select(*columns).repartition(tasks, "name", "part").sortWithinPartitions(*order)
             .mapInArrow(best_of_points(blocks.min_score, to_arrow_schema(schema)), schema))
    return found.where(blocks.keeps(-F.col("neg"))).select(
        *_KEY, F.struct("neg", "id", "vendor", "amount", "date", "v").alias("_best"))


def _best_of_many(search: DataFrame, profiles: DataFrame, by_amount: DataFrame, by_day: DataFrame,
                  blocks: _Blocks, chunk: int) -> DataFrame:
    """Best match of each search row (keys, vkey, _v) by blocks and nearest searches."""
    plain = _plain()
    keys = ["_vkey", "_amount", *plain]
    # Blocks near in date: pair the sparse ones, search the crowded ones day by day.
    block = ["vkey", "_k", "_h"]
    dated = profiles.where("date IS NOT NULL")
    sparse, dense = dated.where("NOT _dense"), dated.where("_dense")
    probes = search.where("_date IS NOT NULL").select(
        "*", F.explode(blocks.amount_buckets(F.col("_amount"))).alias("_k")
    ).select("*", F.explode(blocks.date_buckets(_day(F.col("_date")))).alias("_h"))
    pairs = probes.join(
        sparse.select(*block, F.col("amount").alias("c_amount"), "r1", "r2"), block)
    pairs = pairs.select(*_KEY, "_v", "c_amount", _pick(F.struct("r1", "r2"), F.col("_excl")).alias("c"))
    hits = _scored(pairs, blocks)

    # Only days that hold something are searched: at most 2 * days + 1 per row.
    cell = _day(F.col("date")).alias("_cell")
    days = dense.groupBy("vkey", "_h").agg(F.collect_set(cell).alias("_cells"))
    crowded = (probes.join(dense.select(*block).distinct(), block, "left_semi")
               .select(*_KEY, "vkey", "_v", "_h").distinct())
    cells = crowded.join(days, ["vkey", "_h"]).select(
        *_KEY, "vkey", "_v", F.explode("_cells").alias("_cell")).where(
        F.abs(F.col("_cell") - _day(F.col("_date"))) <= blocks.days)
    axis = F.floor(F.col("_pos") / F.lit(chunk * AMOUNT_STEP))
    hits = hits.unionByName(_hits(
        cells, _with_amount(dense).select("vkey", _day(F.col("date")).alias("_cell"),
                                   F.col("amount").alias("_pos"), "_p"),
        ["vkey", "_cell"], "_amount", axis, blocks, lambda c: c["amount"]))

    best = hits.groupBy(*_KEY).agg(F.min("best").alias("_best"))

    if blocks.far or blocks.by_date:
        # Far matches share an amount or a date only. They are searched for rows that have
        # nothing yet that such a match could not reach.
        best = materialize(best, "near-best")
        known = best.withColumns(plain).select(*keys, (-F.col("_best.neg")).alias("_had"))
        had = F.coalesce("_had", F.lit(0.0))
        most = (W_AMOUNT if blocks.far else W_DATE) * F.col("_v")
        left = materialize(search.withColumns(plain).join(known, keys, "left").where(had <= most)
                           .drop(*plain), "far-search")
        hits = best.select(*_KEY, F.col("_best").alias("best"))
        if blocks.far:
            hits = hits.unionByName(_hits(
                left, _with_amount(by_amount).select("vkey", F.col("amount").alias("_pos"), "_p"),
                ["vkey"], "_amount", axis, blocks, lambda c: c["amount"]))
        if blocks.by_date:
            wanted = left.where((had <= W_DATE * F.col("_v")) & F.col("_date").isNotNull())
            hits = hits.unionByName(_hits(
                wanted.withColumn("_on_day", _day(F.col("_date"))),
                by_day.select("vkey", _day(F.col("date")).alias("_pos"), "_p"),
                ["vkey"], "_on_day", F.floor(F.col("_pos") / F.lit(chunk)), blocks,
                lambda c: c["amount"]))
        best = hits.groupBy(*_KEY).agg(F.min("best").alias("_best"))
    return best


def _named_groups(names: DataFrame, links: DataFrame | None, limit: int) -> DataFrame:
    """(vkey, _group, _i, _vs): the names of groups that are linked with no others and are small.

    ``names`` (vkey, n) counts rows. A name's label is the smallest name a few links away;
    names of one label are a group if no link leaves it. Others are left out.
    """
    if links is None:
        return names.where(F.col("n") <= limit).select(
            "vkey", F.col("vkey").alias("_group"), F.lit(0).alias("_i"),
            F.array(F.lit(1.0)).alias("_vs"))
    here = names.select("vkey")
    given = (links.join(here.withColumnRenamed("vkey", "a"), "a", "left_semi")
             .join(here.withColumnRenamed("vkey", "b"), "b", "left_semi").select("a", "b", "v"))
    both = given.select("a", "b").unionByName(
        given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = both.groupBy("a").agg(F.min("b").alias("label"))
    for _ in range(LABEL_ROUNDS):
        labels = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(
            F.min("label").alias("label"))
    labels = materialize(labels, "name-labels")
    ends = both.join(labels, "a").join(labels.select(F.col("a").alias("b"), F.col("label").alias("to")), "b")
    closed = ends.groupBy("label").agg(F.bool_and(F.col("label") == F.col("to")).alias("closed"))
    sizes = labels.join(names.withColumnRenamed("vkey", "a"), "a").groupBy("label").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    small = closed.join(sizes, "label").where(
        F.col("closed") & (F.col("n") <= limit) & (F.col("k") <= GROUP_NAMES)).select("label")
    kept = labels.join(small, "label", "left_semi")
    members = kept.groupBy("label").agg(F.array_sort(F.collect_set("a")).alias("_names"))
    alike = given.join(kept.select("a"), "a", "left_semi").groupBy("a").agg(
        F.map_from_entries(F.collect_set(F.struct("b", "v"))).alias("_alike"))
    vs = F.transform("_names", lambda b: F.coalesce(F.try_element_at("_alike", b), F.lit(0.0)))
    # A name that nobody asks under has no likeness of its own.
    return kept.join(members, "label").join(alike, "a", "left").select(
        F.col("a").alias("vkey"), F.col("label").alias("_group"),
        (F.array_position("_names", F.col("a")) - 1).cast("int").alias("_i"), vs.alias("_vs"))


def _spellings(queries: DataFrame, history: DataFrame | None, links: DataFrame | None,
               limit: int) -> DataFrame:
    """Written table of the spellings: rows, and the group of the name; ``_rest`` without one."""
    every = queries.select("vendor") if history is None else queries.select("vendor").unionByName(
        history.select("vendor"))
    counted = every.where("vendor IS NOT NULL").groupBy("vendor").agg(F.count(F.lit(1)).alias("n"))
    # Each spelling is normalised once: filters do not pass the generator.
    counted = materialize(once(counted, vkey=vendor_key(F.col("vendor"))), "spellings")
    named = counted.where("vkey != ''")
    groups = _named_groups(named.groupBy("vkey").agg(F.sum("n").alias("n")), links, limit)
    return materialize(named.join(groups, "vkey", "left").select(
        "vendor", "n", "_group", "_i", "_vs", F.col("_group").isNull().alias("_rest")), "name-groups")


def _within_groups(queries: DataFrame, history: DataFrame | None, spelled: DataFrame, rows: int,
                   blocks: _Blocks) -> DataFrame:
    """``match`` of the rows of ``queries`` that no name of ``_rest`` asks for.

    Every row goes once to the task of its group and leaves it with its best match.
    """
    own = queries.columns
    every = queries.withColumn("_kind", F.lit(2 if history is None else 1))
    if history is not None:
        filed = ["invoice_id", "vendor", "amount", "posting_date"]
        every = every.unionByName(history.select(*filed, F.lit(0).alias("_kind")), allowMissingColumns=True)
    # No name starts with a mark, so rows without one are dealt out.
    alone = F.concat(F.lit("!"), F.pmod(F.xxhash64("invoice_id", "amount"), F.lit(4096)).cast("string"))
    every = every.join(spelled.drop("n"), "vendor", "left").where(
        ~F.coalesce("_rest", F.lit(False))).select(
        *own, F.coalesce("_group", alone).alias("_group"), "_i", "_vs", "_kind")
    best = StructType.fromDDL(BEST)
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    found = every.repartition(tasks, "_group").sortWithinPartitions("_group").mapInArrow(
        best_of_groups(blocks.min_score, own, to_arrow_schema(best)),
        StructType([*every.select(*own).schema.fields, *best.fields]))
    kept = F.col("_id").isNotNull() & blocks.keeps(-F.col("_neg"))
    names = {"_neg": "neg", "_id": "id", "_vendor": "vendor", "_on_amount": "amount",
             "_on_date": "date", "_v": "v"}
    hit = F.when(kept, F.struct(*[F.col(c).alias(n) for c, n in names.items()]))
    return found.select(*own, _match(hit, F.col("amount"), F.col("posting_date")).alias("match"))


def _match(best: Column, amount: Column, date: Column, copy: Column | None = None) -> Column:
    """The match as it is returned: the copy if there is one, else the best hit, else empty."""
    hit = best.isNotNull()

    def either(if_copy: Column, if_hit: Column, default: Column) -> Column:
        if copy is None:
            return F.when(hit, if_hit).otherwise(default)
        return F.when(copy.isNotNull(), if_copy).when(hit, if_hit).otherwise(default)

    given = F.struct(F.lit("").alias("id"), F.lit("").alias("vendor")) if copy is None else copy
    zero, none = F.lit(0.0), F.lit(None)
    return F.struct(
        either(F.lit(1.0), -best["neg"], zero).alias("score"),
        either(given["id"], best["id"], none).alias("matched_invoice_id"),
        either(F.lit(1.0), best["v"], zero).alias("vendor_similarity"),
        either(F.lit(1.0), sim.amount_similarity(amount, best["amount"]), zero).alias("amount_similarity"),
        either(F.lit(1.0), sim.date_proximity(date, best["date"]), zero).alias("date_proximity"),
        either(given["vendor"], best["vendor"], none).alias("matched_vendor"),
        either(amount, best["amount"], none).alias("matched_amount"),
        either(F.lit(0), sim.days_apart(date, best["date"]), none).alias("days_apart"))


def closest_matches(
    queries: DataFrame,
    history: DataFrame | Filed | None = None,
    *,
    min_score: float = DEFAULT_MIN_SCORE,
    links: DataFrame | None = None,
    dense_limit: int = DENSE_LIMIT,
    chunk: int = CHUNK,
) -> DataFrame:
    """Every row of ``queries`` with its closest match in ``history`` as ``match``.

    ``history`` defaults to ``queries`` itself. Both need invoice_id, vendor,
    amount and posting_date; other columns of ``queries`` pass through. Rows
    that carry the query's own id never match it. ``links`` (a, b, v) tells which
    spellings are one vendor and how alike they are (see :mod:`.names`); names without a
    link are different vendors, and without ``links`` the normalised names must be equal.
    A store brings its own links. Below ``min_score`` the match is empty.

    Rows of small groups of names (:func:`_within_groups`) are answered in one pass; the
    names that are left, if any, and arrivals that meet tables of profiles, by what follows.
    Rows without an id are no match for others.
    """
    filed = history if isinstance(history, Filed) else None
    if filed is not None and not isinstance(filed.profiles, Parted):
        return _by_profiles(queries, filed, min_score, links, dense_limit, chunk)
    blocks = _Blocks(min_score)
    if filed is not None:
        if filed.blocks.min_score != min_score:
            raise ValueError(f"the invoices are filed for scores from {filed.blocks.min_score}")
        if links is None and filed.names is not None:
            links = materialize(filed.names.of(vendor_names(queries)), "links-met")
        history, dense_limit = _stored(queries, filed, links), filed.dense_limit
    spelled = _spellings(queries, history, links, WHOLE_BLOCKS * dense_limit)
    rows, rest = spelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("_rest"), 1))).first()
    found = _within_groups(queries, history, spelled, rows, blocks)
    if not rest:
        return found

    def left(df: DataFrame) -> DataFrame:
        names = spelled.where("_rest").select("vendor")
        return df.join(names, "vendor", "left_semi").select(*df.columns)

    return found.unionByName(_by_profiles(
        left(queries), filed or (None if history is None else left(history)), min_score, links,
        dense_limit, chunk))


def _stored(queries: DataFrame, filed: Filed, links: DataFrame | None) -> DataFrame:
    """Written table of the invoices of a store that rows of ``queries`` can match: of the
    parts that their names and amounts meet all, of other parts two a day."""
    rows = queries.where("amount IS NOT NULL AND NOT isnan(amount)")
    spelled = once(rows.select("vendor").distinct(), a=vendor_key(F.col("vendor"))).where("a != ''")
    met = spelled.select("vendor", "a", F.col("a").alias("vkey")) if links is None else spelled.join(
        links.select("a", F.col("b").alias("vkey")), "a")
    met = materialize(met.select("vendor", "vkey"), "names-met")
    amounts = rows.select("vendor", F.explode(filed.blocks.amount_buckets(F.col("amount"))).alias("_k"))
    parts = filed.profiles.parts_of(amounts.distinct().join(met, "vendor"))
    found = _points(filed.profiles.read(parts))
    if len(parts) < filed.profiles.parts:
        days = _points(near(filed.by_day, met).select("vkey", "_p.*")).withColumn(
            "_k", filed.blocks.amount_bucket(F.col("amount")))
        found = found.unionByName(days.where(filed.profiles.beyond(parts)).drop("_k"))
    names = met.select("vkey").distinct()
    return materialize(found.join(names, "vkey", "left_semi").select(
        F.col("id").alias("invoice_id"), "vendor", "amount", F.col("date").alias("posting_date")), "stored")


def _by_profiles(queries: DataFrame, history: DataFrame | Filed | None, min_score: float,
                 links: DataFrame | None, dense_limit: int, chunk: int) -> DataFrame:
    """The closest matches over profiles, block by block where names meet many of them.

    The profile table is read by several branches, so it is written once to the
    shared folder when this is called, or comes written as ``Filed``.
    """
    same_table = history is None
    filed = history if isinstance(history, Filed) else file_invoices(
        queries if same_table else history, min_score, dense_limit)
    blocks = filed.blocks
    if blocks.min_score != min_score:
        raise ValueError(f"the invoices are filed for scores from {blocks.min_score}")

    rows = (queries.withColumn("_vkey", vendor_key(F.col("vendor")))
            .withColumn("_amount", F.col("amount")).withColumn("_date", F.col("posting_date")))
    if same_table:
        rows = rows.withColumn("_excl", F.col("invoice_id"))
    else:
        ids = near(filed.ids, queries.select(F.col("invoice_id").alias("_excl")))
        rows = rows.join(ids, rows["invoice_id"] == ids["_excl"], "left")
    eligible = rows.where("_vkey != '' AND _amount IS NOT NULL AND NOT isnan(_amount)")
    if links is None and filed.names is not None:
        links = materialize(filed.names.of(
            eligible.select(F.col("_vkey").alias("a")).distinct()), "links-met")

    def named(keys: DataFrame) -> DataFrame:
        if links is None:
            return keys.withColumn("vkey", F.col("_vkey")).withColumn("_v", F.lit(1.0))
        return keys.join(links.select(F.col("a").alias("_vkey"), F.col("b").alias("vkey"),
                                      F.col("v").alias("_v")), "_vkey")

    if isinstance(filed.profiles, Parted):
        met = named(eligible.select("_vkey", "_amount")).select(
            "vkey", F.explode(blocks.amount_buckets(F.col("_amount"))).alias("_k"))
        profiles, by_amount = near(filed.profiles, met), near(filed.by_amount, met)
        by_day = near(filed.by_day, met)
    else:
        profiles, by_amount, by_day = filed.profiles, filed.by_amount, filed.by_day
    asking = _search_keys(eligible, profiles, blocks, same_table)
    met = _met(asking, profiles, links, WHOLE_BLOCKS * filed.dense_limit)
    few = met.where("NOT _many")
    points = [_points(profiles)]
    if isinstance(filed.profiles, Parted):      # profiles of other amounts may not be read
        points.append(_points(by_day.select("vkey", "_p.*")))
    best = _best_of_few(asking, points, few, links, blocks)
    many = met.where("_many").select("_vkey")
    if not many.isEmpty():
        if not isinstance(filed.profiles, Parted):
            reached = profiles.join(named(many).select("vkey").distinct(), "vkey", "left_semi")
            reached = materialize(reached, "profiles-reached")
            by_amount, by_day = _by_amount(reached), _by_day(reached)
            reached = _flagged(reached, filed.dense_limit)
        else:
            reached = profiles
        best = best.unionByName(_best_of_many(
            named(asking.join(many, "_vkey", "left_semi")), reached, by_amount, by_day, blocks, chunk))

    # Keys as plain values: a missing date or id to skip still has to meet itself.
    plain = _plain()
    keys = ["_vkey", "_amount", *plain]

    # A row's own profile can answer it if it holds two ids; on file it may also hold another's.
    answers = profiles.where("date IS NOT NULL")
    if same_table:      # few as a rule, and of known size once written
        answers = materialize(answers.where("r2 IS NOT NULL").select(
            "vkey", "amount", "date", "r1", "r2"), "copies")
    own = answers.select(
        F.col("vkey").alias("_vkey"), F.col("amount").alias("_amount"),
        F.col("date").alias("_date"), F.struct("r1", "r2").alias("_own"))
    joined = join_per_key(rows, own, ["_vkey", "_amount", "_date"], "invoice_id", salts=4)
    best = best.withColumns(plain).drop("_date", "_excl")
    joined = joined.withColumns(plain)
    # In one table the skipped id is the row's own, so no key repeats; arrivals may be copies.
    joined = joined.join(best, keys, "left") if same_table else join_per_key(
        joined, best, keys, "invoice_id", salts=4)

    match = _match(F.col("_best"), F.col("_amount"), F.col("_date"),
                   _pick(F.col("_own"), F.col("_excl")))
    return joined.select(*[joined[c] for c in queries.columns], match.alias("match"))


def duplicate_score(match: Column) -> Column:
    """The score as the feature table carries it: four decimals."""
    return half_up(match["score"], 4)


def flat(found: DataFrame) -> DataFrame:
    """``match`` reduced to the two columns that features and rules read."""
    return (found.withColumn("duplicate_score", duplicate_score(F.col("match")))
            .withColumn("duplicate_match_id", F.col("match.matched_invoice_id")).drop("match"))


def is_confirmed(match: Column) -> Column:
    return match["score"] >= CONFIRMED_DUPLICATE


def is_near(match: Column) -> Column:
    return match["score"] >= NEAR_DUPLICATE


def describe(match: Column) -> Column:
    """One line for a reviewer."""
    gap = F.when(match["days_apart"] == 0, F.lit("same day")).otherwise(
        F.concat(F.coalesce(match["days_apart"].cast("string"), F.lit("None")), F.lit("d apart")))
    text = F.concat(
        match["matched_invoice_id"], F.lit(" at "), percent(match["score"]),
        F.lit(" similarity (vendor "), percent(match["vendor_similarity"]),
        F.lit(", amount "), percent(match["amount_similarity"]), F.lit(", "), gap, F.lit(")"))
    return F.coalesce(text, F.lit("No comparable invoice on file."))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Score given pairs (vendor_a, amount_a, date_a, vendor_b, ...).

    The vendor term is the edit ratio of the normalised names, whatever its size.
    """
    named = F.struct(vendor_key(F.col("vendor_a")).alias("a"), vendor_key(F.col("vendor_b")).alias("b"))
    keyed = pairs.withColumn("_names", named)
    v = sim.name_edit_ratio(F.col("_names.a"), F.col("_names.b"))
    amt = sim.amount_similarity(F.col("amount_a"), F.col("amount_b"))
    dat = sim.date_proximity(F.col("date_a"), F.col("date_b"))
    out = keyed.withColumn("vendor_similarity", v)
    return (out.withColumn("amount_similarity", amt).withColumn("date_proximity", dat)
            .withColumn("score", sim.weigh(F.col("vendor_similarity"), amt, dat))
            .select(*pairs.columns, "vendor_similarity", "amount_similarity", "date_proximity",
                    "score"))
