"""Reviewer decisions as training signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.functions.numeric import count_where
from tallyguard.functions.staging import once
from tallyguard.schemas import FEATURE_BLOB


def reviewer_feedback(status: Column) -> Column:
    """An approved flag was a false positive; automatic approvals say nothing."""
    return F.when(status == "approved", "false_positive").when(status == "rejected", "true_positive")


def true_label(feedback: Column) -> Column:
    return F.when(feedback == "false_positive", 0).when(feedback == "true_positive", 1)


def with_feedback(queue: DataFrame) -> DataFrame:
    """Adds reviewer_feedback and feedback_at to decided rows."""
    reviewed = P.is_flagged(F.col("route"))
    return queue.withColumn(
        "reviewer_feedback", F.when(reviewed, reviewer_feedback(F.col("status")))
    ).withColumn("feedback_at", F.when(F.col("reviewer_feedback").isNotNull(), F.col("decided_at")))


def load_feedback(queue: DataFrame, limit: int | None = None, newest_first: bool = True) -> DataFrame:
    """Rows with feedback, newest first; sorting computes the queue twice, so leave it to readers."""
    rows = queue.where("reviewer_feedback IS NOT NULL").withColumn(
        "true_label", true_label(F.col("reviewer_feedback")))
    if newest_first or limit:
        rows = rows.orderBy(F.desc("feedback_at"), "invoice_id")
    return rows.limit(limit) if limit else rows


def feedback_summary(queue: DataFrame) -> DataFrame:
    """Counts and retraining readiness."""
    fb = F.col("reviewer_feedback")
    out = queue.agg(
        F.count(fb).alias("total"), count_where(fb == "false_positive").alias("false_positives"),
        count_where(fb == "true_positive").alias("true_positives"))
    total = F.col("total")
    return out.select(
        "*", (total >= P.RETRAIN_THRESHOLD).alias("ready"),
        F.lit(P.RETRAIN_THRESHOLD).alias("threshold"),
        F.least(F.lit(1.0), total / float(P.RETRAIN_THRESHOLD)).alias("progress"),
        (F.lit(P.RETRAIN_THRESHOLD) - total).alias("remaining"))


def features_json(row: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[row[n].alias(n) for n in sorted(row)]))


def training_rows(feedback: DataFrame) -> DataFrame:
    """Feature columns from the stored JSON and the label.

    A missing feature counts as 0; text that is no JSON object drops the row.
    The result is empty below the retraining threshold.
    """
    # No more rows are counted than decide it.
    enough = feedback.limit(P.RETRAIN_THRESHOLD).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n") >= P.RETRAIN_THRESHOLD).scalar()
    parsed = once(feedback.where(F.try_parse_json("features_json").isNotNull()),
                  _f=F.from_json("features_json", FEATURE_BLOB))
    return parsed.where(F.col("_f").isNotNull()).where(enough).select(
        "invoice_id", *[F.coalesce(F.col(f"_f.{n}"), F.lit(0.0)).alias(n) for n in P.FEATURES],
        F.col("true_label").alias("label"))
