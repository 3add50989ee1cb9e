"""The registered queries: plain functions (spark, sf_dir) -> DataFrame.

Sorted results carry their sort keys; rows that are limited also carry their
position. Dates and times leave as text so that any engine prints them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.functions import bands
from tallyguard.functions import similarity as sim
from tallyguard.functions.numeric import half_up
from tallyguard.functions.staging import once
from tallyguard.functions.text import vendor_key
from tallyguard.operators import (
    chain, confidence, duplicates, extract, features, feedback, kpis, models, names, notify,
    queue, review, rules,
)
from tallyguard.operators.ordering import top
from tallyguard.plans import frames
from tallyguard.session import drop, materialize, scratch
from tallyguard.sources.files import VersionedTable
from tallyguard.sources import testdata as td
from tallyguard.streaming import jobs
from tallyguard.streaming.workflow import OUTCOME as WORK_OUTCOME

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str | Column) -> Column:
    return half_up(F.col(c) if isinstance(c, str) else c, 6)


def day(c: str) -> Column:
    return F.col(c).cast("string").alias(c)


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# ---- intake ----------------------------------------------------------------

@register
def extract_fields(spark, d):
    return frames.extracted(spark, d).select(
        "source_file", "invoice_id", "vendor", "amount", day("posting_date"), day("due_date"),
        "extraction_ok")


@register
def extraction_report(spark, d):
    return extract.extraction_report(frames.extracted(spark, d)).withColumn(
        "fill_rate", r6("fill_rate"))


@register
def intake_validation(spark, d):
    checked = extract.validate_submissions(td.submission_json(spark, d).drop("invoice_id"))
    return extract.intake_report(checked)


@register
def intake_accepted(spark, d):
    checked = extract.validate_submissions(td.submission_json(spark, d).drop("invoice_id"))
    return checked.where("error IS NULL").select(
        "invoice_id", "vendor", "amount", day("posting_date"), day("due_date"))


# ---- features --------------------------------------------------------------

@register
def feat_threshold_proximity(spark, d):
    return td.invoices(spark, d).select(
        "invoice_id", features.threshold_proximity(F.col("amount")).alias("threshold_proximity"))


@register
def feat_weekend_flag(spark, d):
    return td.invoices(spark, d).select(
        "invoice_id", features.weekend_flag(F.col("posting_date")).alias("weekend_flag"))


@register
def feat_days_to_due(spark, d):
    return features.base_features(td.invoices(spark, d)).select(
        "invoice_id", "days_to_due", r6("days_to_due_norm").alias("days_to_due_norm"))


@register
def feat_amount_zscore(spark, d):
    return features.base_features(td.invoices(spark, d)).select(
        "invoice_id", r6("amount_zscore").alias("amount_zscore"),
        r6("amount_zscore_norm").alias("amount_zscore_norm"))


@register
def features_incremental(spark, d):
    rows = materialize(td.invoices(spark, d), "invoices")
    past, new = td.before(rows), td.since(rows)
    links = names.links(names.vendor_names(past.unionByName(new)))
    rows = duplicates.flat(duplicates.closest_matches(new, past, links=links))
    return features.incremental_features(rows, past).select(
        "invoice_id", "amount_zscore_norm", "threshold_proximity", "duplicate_score",
        "weekend_flag", "days_to_due_norm", "duplicate_match_id")


@register
def feature_profile(spark, d):
    out = features.feature_profile(frames.full_features(spark, d))
    return out.select("feature", r6("min").alias("min"), r6("max").alias("max"),
                      r6("mean").alias("mean"))


@register
def label_join(spark, d):
    joined = features.join_labels(td.invoices(spark, d), td.ground_truth(spark, d))
    return joined.select("invoice_id", "label")


@register
def class_balance(spark, d):
    return features.class_balance(
        features.join_labels(td.invoices(spark, d), td.ground_truth(spark, d)))


# ---- duplicates ------------------------------------------------------------

@register
def vendor_normalize(spark, d):
    return td.labelled_pairs(spark, d).groupBy(vendor_key(F.col("vendor")).alias("vendor_key")).agg(
        F.count(F.lit(1)).alias("invoices"), F.countDistinct("vendor").alias("spellings"))


def _alike(spark, d):
    """Every ordered pair of vendor spellings on the invoices that are linked."""
    return names.links(names.vendor_names(td.invoices(spark, d)))


@register
def vendor_links(spark, d):
    return _alike(spark, d).select("a", "b", r6("v").alias("similarity"))


@register
def vendor_links_incremental(spark, d):
    """Links of the names that arrive to those on file: known ones read, new ones probed."""
    store = names.NameStore.file(names.vendor_names(td.history(spark, d)), names.LINK_RATIO, 8)
    return store.of(names.vendor_names(td.incoming(spark, d))).select(
        "a", "b", r6("v").alias("similarity"))


@register
def vendor_similarity(spark, d):
    """The matching-blocks ratio of every linked pair; reviewers see it beside the edit ratio."""
    return _alike(spark, d).select("a", "b", r6(sim.name_ratio("a", "b")).alias("similarity"))


@register
def vendor_levenshtein(spark, d):
    """Each linked pair once, with the number of edits between the names."""
    pairs = _alike(spark, d).where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"),
                        r6(sim.name_edit_ratio(F.col("a"), F.col("b"))).alias("similarity"))


@register
def pair_similarity(spark, d):
    """Every invoice against the one it matches best, scored anew as a given pair."""
    rows = td.invoices(spark, d)
    other = rows.select(F.col("invoice_id").alias("id_b"), F.col("vendor").alias("vendor_b"),
                        F.col("amount").alias("amount_b"), F.col("posting_date").alias("date_b"))
    found = frames.matched(spark, d).where("duplicate_match_id IS NOT NULL").select(
        "invoice_id", F.col("duplicate_match_id").alias("id_b"), F.col("vendor").alias("vendor_a"),
        F.col("amount").alias("amount_a"), F.col("posting_date").alias("date_a"))
    return duplicates.pair_scores(found.join(other, "id_b")).select(
        "invoice_id", "id_b", r6("vendor_similarity").alias("vendor_similarity"),
        r6("amount_similarity").alias("amount_similarity"),
        r6("date_proximity").alias("date_proximity"), r6("score").alias("score"))


def _match_columns() -> list[Column]:
    m = F.col("match")
    return [F.col("invoice_id"), r6(m["score"]).alias("score"),
            m["matched_invoice_id"].alias("matched_invoice_id"),
            r6(m["vendor_similarity"]).alias("vendor_similarity"),
            m["matched_vendor"].alias("matched_vendor"),
            r6(m["amount_similarity"]).alias("amount_similarity"),
            r6(m["date_proximity"]).alias("date_proximity"),
            m["matched_amount"].alias("matched_amount"), m["days_apart"].alias("days_apart"),
            duplicates.is_near(m).alias("is_near"), duplicates.is_confirmed(m).alias("is_confirmed")]


@register
def closest_match(spark, d):
    rows = materialize(td.invoices(spark, d), "invoices")
    links = names.links(names.vendor_names(rows))
    return duplicates.closest_matches(rows, links=links).select(*_match_columns())


@register
def duplicate_screen(spark, d):
    found = frames.matched(spark, d)
    return found.where(duplicates.is_near(F.col("match"))).select(*_match_columns())


@register
def duplicate_screen_fuzzy(spark, d):
    """The screen across spellings: names linked by edit ratio, down to the screen's score."""
    rows = materialize(td.respelled(spark, d), "respelled")
    links = names.links(names.vendor_names(rows))
    found = duplicates.closest_matches(rows, min_score=P.NEAR_DUPLICATE, links=links)
    m = F.col("match")
    return found.where(duplicates.is_near(m)).select(
        "invoice_id", r6(m["score"]).alias("score"), m["matched_invoice_id"].alias("matched_invoice_id"),
        r6(m["vendor_similarity"]).alias("vendor_similarity"), m["matched_vendor"].alias("matched_vendor"),
        m["days_apart"].alias("days_apart"))


@register
def top_duplicates(spark, d):
    found = frames.matched(spark, d).where(F.col("duplicate_score") >= P.NEAR_DUPLICATE)
    return top(found.select("invoice_id", "duplicate_match_id", "duplicate_score"),
               [F.desc("duplicate_score"), F.col("invoice_id")], 10)


def _pairs_and_matches(spark, d):
    rows = materialize(td.labelled_pairs(spark, d), "pairs")
    found = duplicates.closest_matches(
        rows.drop("is_duplicate_of"), min_score=P.NEAR_DUPLICATE,
        links=names.links(names.vendor_names(rows)))
    labelled = rows.where("is_duplicate_of IS NOT NULL").select("invoice_id", "is_duplicate_of")
    return labelled, found


@register
def duplicate_recall(spark, d):
    out = kpis.duplicate_recall(*_pairs_and_matches(spark, d))
    return out.withColumn("recall", r6("recall"))


@register
def duplicate_false_positives(spark, d):
    hits = kpis.unlabelled_hits(*_pairs_and_matches(spark, d))
    return hits.select("invoice_id", F.col("match.matched_invoice_id").alias("matched_invoice_id"),
                       r6(F.col("match.score")).alias("score"))


# ---- scores, rules and routes ----------------------------------------------

@register
def band_for(spark, d):
    p = F.explode("probabilities").alias("model", "p")
    rows = frames.scored(spark, d).select("invoice_id", p)
    band = bands.band_for(F.col("p"))
    return rows.select("invoice_id", "model", band.alias("band"), bands.band_label(band).alias("label"),
                       bands.at_or_above(band, "elevated").alias("at_least_elevated"))


@register
def ensemble_assess(spark, d):
    return frames.scored(spark, d).select(
        "invoice_id", r6("confidence_mean").alias("mean"), r6("confidence_spread").alias("spread"),
        F.col("confidence_band").alias("band"), F.col("confidence_label").alias("label"),
        F.col("confidence_rank").alias("rank"), "is_split", "agreement")


def _fired(df: DataFrame, code: str) -> DataFrame:
    hit = rules.RULES[code](rules.inputs_from(df))
    return once(df, hit=hit).where("hit IS NOT NULL").select(
        "invoice_id", F.col("hit.name").alias("rule"), F.col("hit.route").alias("route"))


@register
def rule_r01(spark, d):
    return _fired(td.invoices(spark, d), "R-01")


@register
def rule_r02(spark, d):
    return _fired(td.invoices(spark, d), "R-02")


@register
def rule_r03(spark, d):
    return _fired(frames.matched(spark, d), "R-03")


@register
def rule_r04(spark, d):
    return _fired(frames.scored(spark, d), "R-04")


@register
def rule_r05(spark, d):
    return _fired(features.base_features(td.invoices(spark, d)), "R-05")


@register
def rule_r06(spark, d):
    rows = td.invoices(spark, d).withColumn(
        "amount", F.when(F.col("order_key") % 41 != 0, F.col("amount"))).withColumn(
        "weekend_flag", features.weekend_flag(F.col("posting_date")))
    return _fired(rows, "R-06")


@register
def rule_r07(spark, d):
    return _fired(features.base_features(td.invoices(spark, d)), "R-07")


@register
def rule_r08(spark, d):
    return _fired(frames.extracted(spark, d), "R-08")


@register
def rule_r09(spark, d):
    return _fired(frames.scored(spark, d), "R-09")


@register
def route_decisions(spark, d):
    return frames.decisions(spark, d).select(
        "invoice_id", "route", "route_label", "approver", "tier", "sla_hours", "is_auto",
        rules.rule_codes(F.col("rules")).alias("rules_fired"),
        rules.decision_summary(F.col("rules"), F.col("route_label")).alias("summary"),
        "duplicate_match_id", "policy_version")


@register
def unscored_routing(spark, d):
    """Documents that could not be read in full: no features, no scores, only R-01/02/08."""
    unread = frames.extracted(spark, d).where("NOT extraction_ok")
    return rules.evaluate(unread).select(
        "invoice_id", "route", rules.rule_codes(F.col("rules")).alias("rules_fired"))


@register
def escalate(spark, d):
    return frames.queue(spark, d).where(P.is_open(F.col("status"))).select(
        "invoice_id", "route", P.escalate(F.col("route")).alias("escalated"))


@register
def notifications(spark, d):
    out = notify.build_notifications(frames.queue(spark, d))
    return out.select(
        "invoice_id", "route", "is_actionable", "priority",
        F.array_join("recipients", ";").alias("recipients"), "subject", "summary_line",
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"), "sla_line")


@register
def batch_report(spark, d):
    rows = kpis.batch_report(frames.batch_results(spark, d))
    return rows.select(
        "route_rank", r6(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), "invoice_id",
        "route", "band", "split", "duplicate_score",
        rules.rule_codes(F.col("rules")).alias("rules_fired"))


# ---- queue and ledger ------------------------------------------------------

@register
def queue_upsert(spark, d):
    return queue.fold_submissions(frames.routed_submissions(spark, d)).select(*_queue_columns())


def _queue_columns() -> list:
    return ["invoice_id", "source_file", "vendor", "amount", "route", "status", stamp("submitted_at"),
            "submitted_by", stamp("updated_at"), "resubmissions", "resubmissions_refused"]


@register
def intake_events(spark, d):
    return queue.intake_events(frames.routed_submissions(spark, d)).select(
        "invoice_id", "seq", "pos", "event_type", "actor", "from_status", "to_status")


@register
def queue_view(spark, d):
    rows = queue.view(frames.queue(spark, d), statuses=P.OPEN_STATUSES)
    return rows.select("route_rank", stamp("submitted_at"), "invoice_id", "route", "status",
                       "vendor", "amount", rules.rule_codes(F.col("rules")).alias("rules_fired"))


@register
def queue_facets(spark, d):
    return queue.facets(frames.queue(spark, d))


@register
def queue_stats(spark, d):
    n = td.table(spark, d, "events").agg(F.count(F.lit(1))).scalar()
    return kpis.queue_stats(frames.queue(spark, d), n)


def _replayed(spark, d):
    return review.replay(td.review_intake(spark, d), td.review_actions(spark, d))


@register
def review_replay(spark, d):
    out = review.reviewed_queue(td.review_intake(spark, d), _replayed(spark, d))
    return out.select("invoice_id", "status", "route", "first_approver", "decided_by",
                      "decision_note", stamp("decided_at"), stamp("updated_at"), "applied")


@register
def review_events(spark, d):
    return review.events(_replayed(spark, d)).select(
        "invoice_id", "seq", "event_type", "actor", "from_status", "to_status", "route_before",
        "route_after", "first_approver")


@register
def review_rejects(spark, d):
    return review.rejects(_replayed(spark, d))


@register
def workflow_replay(spark, d):
    """Submissions and actions interleaved: cases enter, are resubmitted and closed in one log."""
    return review.fold_interleaved(td.workflow_items(spark, d))


@register
def chain_build(spark, d):
    return frames.audit_log(spark, d).select("chain_id", "seq", "prev_hash", "entry_hash")


@register
def chain_verify(spark, d):
    out = chain.verify_chain(frames.tampered_log(spark, d), "chain_id")
    return out.select("chain_id", "events", "ok", "first_bad_seq", "reason",
                      chain.verdict().alias("message"))


@register
def chain_verify_resumed(spark, d):
    """The second half of the log, verified from checkpoints at its middle; some chains were
    shortened, some events changed or taken out since."""
    log = frames.audit_log(spark, d)
    half = log.agg(F.floor(F.max("seq") / 2)).scalar()
    known = chain.checkpoints(log.where(F.col("seq") <= half), "chain_id")
    out = chain.verify_from(frames.half_damaged_log(log, half), known, "chain_id")
    return out.select("chain_id", "events", "ok", "first_bad_seq", "reason",
                      chain.verdict().alias("message"))


@register
def ledger_chain(spark, d):
    return frames.ledger(spark, d).select("invoice_id", "seq", "event_type", "payload", "prev_hash",
                                          "entry_hash")


@register
def ledger_verify(spark, d):
    out = chain.verify_chain(frames.damaged_ledger(spark, d), "invoice_id")
    return out.select("invoice_id", "events", "ok", "first_bad_seq", "reason",
                      chain.verdict().alias("message"))


@register
def event_timeline(spark, d):
    newest = chain.load_events(frames.event_log(spark, d), limit=P.EVENT_VIEW_ROWS)
    return chain.display(newest).select("position", "seq", "invoice_id", "event_type", "actor",
                                        "transition", "note", "short_hash")


@register
def event_facets(spark, d):
    return chain.event_facets(td.table(spark, d, "events").select(
        "event_type", F.col("user_id").alias("invoice_id")))


@register
def event_facets_daily(spark, d):
    """Distinct invoices from one stored sketch a day, and whether they are as near as promised."""
    log = td.table(spark, d, "events").select(
        "event_type", F.col("user_id").alias("invoice_id"), F.col("ts").cast("timestamp").alias("ts"))
    root = scratch(spark, "facets")
    chain.store_daily_facets(log, root)
    days = spark.read.parquet(root)
    estimate = chain.facets_of_days(days).withColumnRenamed("invoices", "estimate").drop("events")
    near = F.abs(F.col("estimate") - F.col("invoices")) <= F.greatest(
        3 * chain.SKETCH_ERROR * F.col("invoices"), F.lit(1.0))
    rows = days.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"))
    return chain.event_facets(log).join(estimate, "event_type").join(rows, "event_type").select(
        "event_type", "events", "invoices", "days", near.alias("within_error"))


# ---- figures ---------------------------------------------------------------

@register
def batch_summary(spark, d):
    out = kpis.summarize_results(frames.batch_results(spark, d), "run_id")
    return out.select("run_id", "total", "auto_approved", "routed", "failed", "high_band", "split",
                      "duplicates", r6("touchless_rate").alias("touchless_rate"),
                      r6("touch_rate").alias("touch_rate"))


@register
def run_history(spark, d):
    out = kpis.run_history(frames.runs(spark, d))
    return out.select(
        "run_id", stamp("started_at"), "run_label", "source", "invoice_count",
        "auto_approved_count", "flagged_count", r6("touchless_rate").alias("touchless_rate"),
        r6("cumulative_touchless_rate").alias("cumulative_touchless_rate"))


@register
def touchless_rate(spark, d):
    return kpis.touchless_rate(frames.queue(spark, d)).select(
        r6("touchless_rate").alias("touchless_rate"))


@register
def fp_summary(spark, d):
    out = kpis.false_positive_summary(frames.queue(spark, d))
    return out.select("flagged", "decided", "false_positives",
                      r6("false_positive_rate").alias("false_positive_rate"),
                      r6("coverage").alias("coverage"), "low_sample")


@register
def fp_trend(spark, d):
    out = kpis.false_positive_trend(frames.queue(spark, d))
    return out.select(day("date"), "decided", "false_positives",
                      r6("false_positive_rate").alias("false_positive_rate"))


@register
def vendor_risk_summary(spark, d):
    return kpis.vendor_risk_summary(frames.queue(spark, d))


@register
def vendor_profiles(spark, d):
    return kpis.vendor_profiles(frames.queue(spark, d)).withColumn("updated_at", stamp("updated_at"))


# ---- feedback and models ---------------------------------------------------

@register
def feedback_dataset(spark, d):
    rows = feedback.load_feedback(frames.queue(spark, d))
    return rows.select(stamp("feedback_at"), "invoice_id", "vendor", "route", "reviewer_feedback",
                       "true_label")


@register
def feedback_summary(spark, d):
    return feedback.feedback_summary(frames.queue(spark, d))


def _feedback_rows(spark, d):
    """Feedback with the features stored as JSON, as the queue keeps them."""
    rows = frames.queue(spark, d)
    blob = feedback.features_json({n: F.col(n) for n in P.FEATURES})
    broken = F.col("order_key") % 71 == 0
    return feedback.load_feedback(once(
        rows, features_json=F.when(broken, F.lit("{broken")).otherwise(blob)), newest_first=False)


@register
def training_rows(spark, d):
    out = feedback.training_rows(_feedback_rows(spark, d))
    return out.select("invoice_id", *[r6(n).alias(n) for n in P.FEATURES], "label")


@register
def classification_metrics(spark, d):
    labelled = features.join_labels(frames.scored(spark, d), td.ground_truth(spark, d)).where("label IS NOT NULL")
    out = kpis.classification_metrics(kpis.confusion(models.predictions(labelled)))
    return out.select("model", "tp", "fp", "fn", "tn",
                      *[half_up(F.col(c), 3).alias(c)
                        for c in ("accuracy", "precision", "recall", "f1")])


@register
def stratified_split(spark, d):
    split = models.stratified_split(td.ground_truth(spark, d))
    return split.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_train"), 1)).alias("n_train"))


def _with_labels(spark, d):
    """Every invoice with its features; the label is null where nobody gave one."""
    rows = features.join_labels(frames.full_features(spark, d), td.ground_truth(spark, d))
    return materialize(rows.select(
        "invoice_id", "amount", *P.FEATURES, "duplicate_match_id", "label"), "labelled")


@register
def train_models(spark, d):
    rows = _with_labels(spark, d)
    split = materialize(models.stratified_split(rows.where("label IS NOT NULL")), "split")
    drop(rows)
    ensemble = models.train(split.where("is_train"))
    held_out = ensemble.score(split.where("NOT is_train"))
    out = kpis.classification_metrics(kpis.confusion(models.predictions(held_out)))
    return out.select("model", *[half_up(F.col(c), 3).alias(c)
                                 for c in ("accuracy", "precision", "recall", "f1")])


@register
def score_and_route(spark, d):
    """Every invoice: fitted on labelled rows, unreadable documents routed without scores."""
    rows = _with_labels(spark, d)
    ensemble = models.train(rows)
    scores = ensemble.score(rows)
    routed = rules.evaluate(confidence.with_assessment(scores, F.col("probabilities")), texts=False)
    return _read_and_unread(spark, d, routed)


def _read_and_unread(spark, d, routed):
    unread = frames.unreadable(spark, d)
    readable = routed.join(unread.select("invoice_id"), "invoice_id", "left_anti")
    codes = rules.rule_codes(F.col("rules")).alias("rules_fired")
    none = F.lit(None)
    return readable.select(
        "invoice_id", r6("confidence_mean").alias("mean"), F.col("confidence_band").alias("band"),
        "route", codes).unionByName(rules.evaluate(unread).select(
            "invoice_id", none.cast("double").alias("mean"), none.cast("string").alias("band"),
            "route", codes))


@register
def score_and_route_fixed(spark, d):
    """The same path with the closed-form scorers in place of fitted models."""
    return _read_and_unread(spark, d, frames.decisions(spark, d))


@register
def retrain(spark, d):
    fb = _feedback_rows(spark, d)
    root = scratch(spark, "models")
    models.retrain(feedback.training_rows(fb), feedback.feedback_summary(fb), root,
                   "2026-01-01T00-00-00")
    return spark.read.parquet(f"{root}/index").select(
        "stamp", F.array_join("models", ",").alias("models_trained"), "feedback_count",
        "false_positives", "true_positives", "training_samples")


# ---- streams: the tables arrive in slices, the result is read from the sink ----

def _stream(spark: SparkSession, df: DataFrame, order: str, job, slices: int = 3) -> str:
    """Feeds ``df`` to ``job(stream, out, checkpoint)`` and returns the sink path."""
    source, out, mark = (scratch(spark, n) for n in ("source", "sink", "checkpoint"))
    jobs.feed_in_slices(df, order, source, lambda s: job(s, out, mark), slices)
    return out


@register
def stream_score_route(spark, d):
    every = materialize(td.invoices(spark, d), "invoices")
    past = td.before(every)
    filed, stats = duplicates.store_invoices(past, 8), features.history_statistics(past)
    rows = td.since(every).withColumn("_day", F.unix_date("posting_date"))
    out = _stream(spark, rows, "_day", lambda s, path, mark: jobs.score_stream(
        s.drop("_day"), filed, stats, frames.assess, path, mark), slices=2)
    return spark.read.parquet(out).select(
        "invoice_id", "amount_zscore_norm", "threshold_proximity", "duplicate_score",
        "weekend_flag", "days_to_due_norm", "duplicate_match_id", "route",
        r6("confidence_mean").alias("mean"), F.col("confidence_band").alias("band"),
        rules.rule_codes(F.col("rules")).alias("rules_fired"))


@register
def stream_queue_state(spark, d):
    none = F.lit(None).cast("string")
    first = td.review_intake(spark, d).select(
        "invoice_id", F.lit(-1).cast("long").alias("seq"), F.lit("submit").alias("kind"), "route",
        none.alias("action"), F.lit("intake").alias("actor"))
    acts = td.review_actions(spark, d).select(
        "invoice_id", F.col("action_seq").alias("seq"), F.lit("action").alias("kind"),
        none.alias("route"), "action", "actor")
    out = _stream(spark, first.unionByName(acts), "seq", lambda s, path, mark: jobs.append_to(
        jobs.queue_state(s), path, mark))
    return spark.read.parquet(out).where("refusal IS NULL AND seq >= 0").select(
        "invoice_id", "seq", "event_type", "actor", "from_status", "to_status", "route_before",
        "route_after", "first_approver")


@register
def stream_queue_upsert(spark, d):
    """The queue from submissions that arrive in slices, folded into a versioned table."""
    subs = frames.routed_submissions(spark, d).withColumn("_day", F.unix_date(F.to_date("ts")))
    empty = queue.merge_folds(queue.submission_folds(subs.drop("_day")))
    table = VersionedTable(spark, scratch(spark, "queue"), empty.schema, "_key", 16)

    def job(stream, path, mark):
        table.compact()     # nobody reads the table meanwhile
        return jobs.upsert_queue(stream.drop("_day"), table, mark)

    _stream(spark, subs, "_day", job)
    table.compact()
    return queue.folded_queue(table.rows()).select(*_queue_columns())


@register
def stream_workflow(spark, d):
    out = _stream(spark, td.workflow_items(spark, d), "seq", lambda s, path, mark: jobs.append_to(
        jobs.queue_state(s), path, mark))
    return spark.read.parquet(out)


@register
def stream_workflow_closing(spark, d):
    """The workflow stream whose state forgets closed cases; event time is one minute a step."""
    rows = td.workflow_items(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seq") * 60 + 86_400))

    def job(stream, out, mark):
        outcomes = spark.read.schema(WORK_OUTCOME).parquet(made(out))
        return jobs.append_to(jobs.queue_state(stream, jobs.closed_cases(outcomes), "30 minutes"), out, mark)

    def made(out):
        spark.createDataFrame([], WORK_OUTCOME).write.mode("append").parquet(out)
        return out

    return spark.read.parquet(_stream(spark, rows, "seq", job, slices=5))


@register
def stream_once_only(spark, d):
    ev = td.table(spark, d, "events").select(
        F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    twice = ev.unionByName(ev.where("event_id % 3 = 0"))
    out = _stream(spark, twice, "ts", lambda s, path, mark: jobs.append_to(
        jobs.once_only(s, ["event_id"]), path, mark))
    return spark.read.parquet(out).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("distinct_events"))


@register
def stream_fp_trend(spark, d):
    rows = frames.queue(spark, d).where("decided_at IS NOT NULL").select(
        "route", "status", "decided_at")
    out = _stream(spark, rows, "decided_at", lambda s, path, mark: jobs.append_to(
        jobs.false_positive_days(s), path, mark))
    return spark.read.parquet(out).select(
        day("date"), "decided", "false_positives",
        r6("false_positive_rate").alias("false_positive_rate"))


@register
def stream_vendor_counters(spark, d):
    rows = frames.queue(spark, d).select("vendor", "route", "status", "submitted_at", "invoice_id")
    out = _stream(spark, rows, "submitted_at", lambda s, path, mark: jobs.versions_to(
        jobs.vendor_counters(s), path, mark))
    return jobs.latest_versions(spark, out, "vendor")


@register
def stream_chain(spark, d):
    out = _stream(spark, td.audit_payloads(spark, d), "seq", lambda s, path, mark: jobs.append_to(
        jobs.chained(s), path, mark))
    return spark.read.parquet(out).select("chain_id", "seq", "prev_hash", "entry_hash")
