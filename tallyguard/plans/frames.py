"""Intermediate tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.operators import (
    chain, confidence, duplicates, features, kpis, names, review, rules,
)
from tallyguard.operators.extract import extract_fields
from tallyguard.operators.feedback import with_feedback
from tallyguard.session import drop, file_states, materialize
from tallyguard.sources import testdata as td

#: Matches already written by this application: input files as they were, to the table.
_MATCHED: dict[tuple, DataFrame] = {}


def assess(df: DataFrame) -> DataFrame:
    """Adds the assessment of the three closed-form scorers."""
    p = td.model_scores(F.col("amount_zscore_norm"), F.col("threshold_proximity"),
                        F.col("weekend_flag"), F.col("days_to_due_norm"))
    return confidence.with_assessment(df, p)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with features (duplicates aside) and their assessment."""
    return assess(features.base_features(td.invoices(spark, sf_dir)))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with their closest match, whatever its score, as columns.

    Features, rules, queue and training rows all start here, so the search runs once per
    application and input and its result is a written table.
    """
    key = (spark.sparkContext.applicationId, *(
        state for name in ("lineitem", "orders", "supplier")
        for state in file_states(spark, f"{sf_dir}/{name}.parquet")))
    if key not in _MATCHED or not file_states(spark, _MATCHED[key].inputFiles()[0]):
        rows = materialize(td.invoices(spark, sf_dir), "invoices")
        found = duplicates.closest_matches(rows, links=names.links(names.vendor_names(rows)))
        _MATCHED[key] = materialize(
            found.withColumn("duplicate_score", duplicates.duplicate_score(F.col("match")))
            .withColumn("duplicate_match_id", F.col("match.matched_invoice_id")), "matched")
        drop(rows)
    return _MATCHED[key]


def full_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with all five features; the written table holds all that statistics need."""
    return features.base_features(matched(spark, sf_dir).drop("match"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice with all features, assessment, fired rules and route."""
    return rules.evaluate(assess(full_features(spark, sf_dir)), texts=False)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queue: routed invoices whose order status tells how review ended."""
    decided = F.when(F.col("order_status") == "F", "approved").when(
        F.col("order_status") == "O", "rejected")
    waiting = (F.when(F.col("order_key") % 5 == 0, "info_requested")
               .when((F.col("route") == "dual_control") & (F.col("order_key") % 5 == 1),
                     "awaiting_second_approval").otherwise("pending_review"))
    status = F.when(F.col("is_auto"), "auto_approved").otherwise(F.coalesce(decided, waiting))
    wait = F.make_dt_interval((1 + F.col("order_key") % 5).cast("int"))
    out = (decisions(spark, sf_dir).withColumn("status", status)
           .withColumn("submitted_at", F.col("posting_date").cast("timestamp")))
    out = out.withColumn("decided_at", F.when(
        F.col("status").isin(*P.DECIDED_STATUSES), F.col("submitted_at") + wait))
    return with_feedback(out.withColumn("updated_at", F.coalesce("decided_at", "submitted_at")))


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-invoice batch rows; one run per posting month. A document that could not be read
    in full failed: it has no scores and is routed on that and on its amount."""
    unread = unreadable(spark, sf_dir)
    read = decisions(spark, sf_dir).join(unread.select("invoice_id"), "invoice_id", "left_anti")
    run = [F.date_format("posting_date", "yyyyMM").cast("long").alias("run_id"),
           F.trunc("posting_date", "month").cast("timestamp").alias("started_at")]
    scored = read.select(
        *run, "invoice_id", "vendor", "amount", F.col("confidence_mean").alias("confidence"),
        F.col("confidence_band").alias("band"), F.col("is_split").alias("split"),
        "duplicate_score", "duplicate_match_id", "route", "rules", F.lit(False).alias("failed"))
    failed = rules.evaluate(unread, texts=False).select(
        *run, "invoice_id", "vendor", "amount", F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("band"), F.lit(False).alias("split"),
        F.lit(None).cast("double").alias("duplicate_score"),
        F.lit(None).cast("string").alias("duplicate_match_id"), "route", "rules",
        F.lit(True).alias("failed"))
    return scored.unionByName(failed)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = kpis.summarize_results(batch_results(spark, sf_dir), "run_id", "started_at")
    return kpis.run_rows(summary, "batch_intake", "batch-intake")


def routed_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission log routed on amount and posting day; some ids were unreadable."""
    subs = td.submissions(spark, sf_dir).withColumn(
        "weekend_flag", features.weekend_flag(F.col("posting_date")))
    routed = rules.evaluate(subs, texts=False)
    return routed.select(
        F.when(F.col("order_key") % 43 != 0, F.col("invoice_id")).alias("invoice_id"),
        F.concat("invoice_id", F.lit(".pdf")).alias("source_file"), "vendor", "amount",
        "route", "rules", "policy_version", F.col("attempt").alias("seq"),
        (F.col("posting_date").cast("timestamp")
         + F.make_dt_interval(F.col("attempt").cast("int"))).alias("ts"),
        F.concat(F.lit("intake-"), (F.col("attempt") % 2).cast("string")).alias("actor"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_fields(td.invoice_text(spark, sf_dir))


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written table of the documents, one per matched invoice, that cannot be read in full."""
    texts = td.invoice_text(spark, sf_dir, matched(spark, sf_dir))
    return materialize(extract_fields(texts).where("NOT extraction_ok"), "unreadable")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.build_chain(td.audit_payloads(spark, sf_dir), "chain_id")


def tampered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log after somebody edited one event in a thousand and removed some."""
    edited = F.when(F.col("seq") % 1000 == 7, F.concat("payload", F.lit("!"))).otherwise(
        F.col("payload"))
    return audit_log(spark, sf_dir).where("seq % 1700 <> 1699").withColumn("payload", edited)


def half_damaged_log(log: DataFrame, half: Column) -> DataFrame:
    """The log after events of its second half were edited or removed, and every seventh
    chain was cut off in the first quarter."""
    late, seq = F.col("seq") > half, F.col("seq")
    edited = F.when(late & (seq % 1000 == 7), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    gone = (late & (seq % 1700 == 1699)) | ((F.col("chain_id") % 7 == 0) & (seq > half / 2))
    return log.where(~gone).withColumn("payload", edited)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit log: what submissions, reviewers and batch runs left, in canonical form,
    chained per invoice; runs have no invoice and form a chain of their own."""
    when = td.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    done = review.fold_interleaved(td.workflow_items(spark, sf_dir)).where("refusal IS NULL")
    columns = ("invoice_id", "seq", "ts", "event_type", "actor", "from_status", "to_status", "detail")
    workflow = done.join(when, "seq").withColumn("detail", F.to_json(
        F.struct("first_approver", "route_after", "route_before"), {"ignoreNullFields": "false"}))
    none = F.lit(None).cast("string")
    batches = kpis.run_events(runs(spark, sf_dir)).withColumns({"from_status": none, "to_status": none})
    log = workflow.select(*columns).unionByName(batches.select(*columns))
    return chain.build_chain(log.withColumn("payload", chain.canonical_event()), "invoice_id")


def damaged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after somebody renamed an actor in some events and removed others."""
    edited = F.when(F.col("seq") % 500 == 8, F.replace("payload", F.lit("actor"), F.lit("Actor")))
    return (ledger(spark, sf_dir).where("seq % 900 <> 21")
            .withColumn("payload", F.coalesce(edited, F.col("payload"))))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events in one log with statuses, detail text and chained hashes."""
    statuses = F.array(*[F.lit(s) for s in P.STATUS_LABELS])
    n = len(P.STATUS_LABELS)
    ev = td.table(spark, sf_dir, "events")
    note = F.to_json(F.struct(F.concat(F.lit("n"), F.col("event_id")).alias("note")))
    why = F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id")).alias("reason")))
    detail = F.when(F.col("event_id") % 3 == 0, note).when(
        F.col("event_id") % 3 == 1, why).otherwise(F.lit("{}"))
    rows = ev.select(
        F.col("user_id").alias("chain_id"), F.col("event_id").alias("seq"),
        F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("invoice_id"),
        "event_type", F.concat(F.lit("rev"), (F.col("event_id") % 3).cast("string")).alias("actor"),
        F.when(F.col("event_id") % 4 != 0, F.element_at(
            statuses, (F.col("event_id") % n + 1).cast("int"))).alias("from_status"),
        F.element_at(statuses, (F.col("event_id") % 5 + 1).cast("int")).alias("to_status"),
        detail.alias("detail"),
        F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))
    return chain.build_chain(rows, "chain_id")
