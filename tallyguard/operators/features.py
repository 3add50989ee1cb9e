"""The five risk features, for a whole table or for new invoices against history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.numeric import clip, half_up
from tallyguard.functions.staging import once
from tallyguard.operators.ordering import join_per_key
from tallyguard.policy import FEATURES, REPORTING_THRESHOLD
from tallyguard.session import materialize


def threshold_proximity(amount: Column) -> Column:
    gap = F.abs(F.lit(REPORTING_THRESHOLD) - amount)
    return clip(1.0 - clip(gap, 0.0, REPORTING_THRESHOLD) / REPORTING_THRESHOLD, 0.0, 1.0)


def weekend_flag(posting_date: Column) -> Column:
    return F.coalesce((F.weekday(posting_date) >= 5).cast("double"), F.lit(0.0))


def days_to_due(posting_date: Column, due_date: Column) -> Column:
    return F.datediff(due_date, posting_date)


def safe_std(sd: Column) -> Column:
    """A vendor with one invoice, or with equal amounts, gets a divisor of 1."""
    return F.when(sd > 0, sd).otherwise(F.lit(1.0))


def vendor_stats(invoices: DataFrame) -> DataFrame:
    """Per-vendor count, mean and sample deviation, combined before the shuffle."""
    return invoices.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("vendor_n"),
        F.avg("amount").alias("vendor_mean"),
        F.stddev_samp("amount").alias("vendor_sd"))


def with_zscore(invoices: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Adds ``amount_zscore``: distance from the vendor's mean in deviations.

    Grouped statistics joined back, not a window: a vendor with a large share of
    the rows is pre-aggregated, and the join spreads its invoices over several tasks.
    """
    stats = vendor_stats(invoices if over is None else over)
    z = F.abs(F.col("amount") - F.col("vendor_mean")) / safe_std(F.col("vendor_sd"))
    return join_per_key(invoices, stats, "vendor", "invoice_id", count="vendor_n").withColumn("amount_zscore", z)


def _bounds(df: DataFrame, *names: str) -> Column:
    """[min, max] of each column as one scalar subquery."""
    parts = [f(n).cast("double") for n in names for f in (F.min, F.max)]
    return df.agg(F.array(*parts).alias("bounds")).scalar()


def min_max(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, x * 0.0).otherwise((x - lo) / (hi - lo))


def _raw(invoices: DataFrame, over: DataFrame | None = None) -> DataFrame:
    return with_zscore(invoices, over).withColumn(
        "days_to_due", days_to_due(F.col("posting_date"), F.col("due_date")))


def base_features(invoices: DataFrame, over: DataFrame | None = None) -> DataFrame:
    """Adds every feature that needs no duplicate search, and its raw inputs.

    Statistics come from ``over``, by default the same rows; pass the plain
    invoice table when ``invoices`` already carries costly columns.
    """
    over = invoices if over is None else over
    scored = _raw(invoices, over)
    b = _bounds(_raw(over), "amount_zscore", "days_to_due")
    return (
        once(scored, _b=b)
        .withColumn("amount_zscore_norm", min_max(
            F.col("amount_zscore"), F.col("_b")[0], F.col("_b")[1]))
        .withColumn("threshold_proximity", threshold_proximity(F.col("amount")))
        .withColumn("weekend_flag", weekend_flag(F.col("posting_date")))
        .withColumn("days_to_due_norm", min_max(
            F.col("days_to_due").cast("double"), F.col("_b")[2], F.col("_b")[3]))
        .drop("_b", "vendor_n", "vendor_mean", "vendor_sd"))


@dataclass(frozen=True)
class Statistics:
    """What new invoices are set against: per vendor a written table, overall a few numbers."""
    vendors: DataFrame
    bounds: Column
    overall: Column


def history_statistics(history: DataFrame) -> Statistics:
    """One pass per figure over the history, for any number of incoming batches."""
    b = history.sparkSession.range(1).select(
        _bounds(_raw(history), "amount_zscore", "days_to_due").alias("b"),
        history.agg(F.array(F.avg("amount"), F.stddev_samp("amount")).alias("o")).scalar().alias("o"),
    ).first()
    return Statistics(
        materialize(vendor_stats(history), "vendor-stats"),
        *[F.array(*[F.lit(x).cast("double") for x in row]) for row in (b.b, b.o)])


def incremental_features(incoming: DataFrame, history: DataFrame | Statistics) -> DataFrame:
    """Features of new invoices from the statistics of invoices on file.

    The smallest value comes from history; the largest is extended by the new
    value, so a value below all history gives a negative result. A vendor with
    fewer than two invoices on file falls back to the overall statistics.
    Values are rounded to four decimals.
    """
    stats = history if isinstance(history, Statistics) else history_statistics(history)
    rows = join_per_key(incoming, stats.vendors, "vendor", "invoice_id", count="vendor_n")
    rows = once(rows, _b=stats.bounds, _all=stats.overall)
    own = F.col("vendor_n") >= 2
    mean = F.when(own, F.col("vendor_mean")).otherwise(F.col("_all")[0])
    sd = F.when(own, F.col("vendor_sd")).otherwise(F.col("_all")[1])

    def extended(x: Column, i: int) -> Column:
        lo, hi = F.col("_b")[i], F.greatest(F.col("_b")[i + 1], x)
        return F.when(x.isNotNull(), F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0)))

    rows = once(rows, _z=F.abs(F.col("amount") - mean) / safe_std(sd),
                _d=days_to_due(F.col("posting_date"), F.col("due_date")).cast("double"))
    return (
        rows.withColumn("amount_zscore_norm", half_up(extended(F.col("_z"), 0), 4))
        .withColumn("threshold_proximity", half_up(threshold_proximity(F.col("amount")), 4))
        .withColumn("weekend_flag", weekend_flag(F.col("posting_date")))
        .withColumn("days_to_due_norm", half_up(extended(F.col("_d"), 2), 4))
        .drop("_b", "_all", "_z", "_d", "vendor_n", "vendor_mean", "vendor_sd"))


def join_labels(invoices: DataFrame, labels: DataFrame) -> DataFrame:
    return invoices.join(labels.select("invoice_id", "label"), "invoice_id", "left")


def feature_profile(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """Min, max and mean per feature, one pass over the table."""
    aggs = [f(n).alias(f"{n}__{s}") for n in names
            for f, s in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))]
    one = features.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"{n}__min").alias("min"),
                 F.col(f"{n}__max").alias("max"), F.col(f"{n}__mean").alias("mean"))
        for n in names])
    return one.select(F.inline(rows))


def class_balance(features: DataFrame) -> DataFrame:
    return features.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
