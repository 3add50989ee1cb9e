"""Review queue from a log of routed submissions, and the events each one leaves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.operators.notify import build_notifications
from tallyguard.operators.ordering import join_per_key


def queue_key() -> Column:
    """The invoice id, or a stand-in named after the file it could not be read from."""
    def filled(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))

    return F.coalesce(filled("invoice_id"), F.concat(
        F.lit("UNREAD::"), F.coalesce(filled("source_file"), F.lit("unknown"))))


def first_status(route: Column) -> Column:
    return F.when(route == P.LADDER[0], "auto_approved").otherwise("pending_review")


def fold_submissions(submissions: DataFrame) -> DataFrame:
    """Current queue row per invoice from its submissions in ``seq`` order.

    Needs invoice_id, source_file, route, seq, ts, actor; other columns are
    payload. The first submission decides the status. If that closes the
    invoice, later ones are refused; otherwise they replace the payload and the
    route while the status and the place in the queue stay. First and last row
    are mergeable aggregates, so repeats of one invoice collapse before the shuffle.
    """
    return folded_queue(merge_folds(submission_folds(submissions)))


def submission_folds(submissions: DataFrame) -> DataFrame:
    """Each submission as a fold of itself: key, first and last submission, their number.

    ``_last`` is null where it is the first, so that a lone submission is kept once.
    """
    payload = [c for c in submissions.columns if c not in ("invoice_id", "seq", "ts", "actor")]
    row = F.struct("seq", F.struct(*payload, "ts", "actor").alias("row"))
    rows = submissions.select(queue_key().alias("_key"), row.alias("_first"))
    none = F.lit(None).cast(rows.schema["_first"].dataType)
    return rows.select("_key", "_first", none.alias("_last"), F.lit(1).cast("long").alias("_n"))


def merge_folds(folds: DataFrame) -> DataFrame:
    """One fold per key from any folds of its submissions, in whatever order they come."""
    last = F.coalesce("_last", "_first")
    merged = folds.groupBy("_key").agg(
        F.min_by("_first", "_first.seq").alias("_first"),
        F.max_by(last, last["seq"]).alias("_last"), F.sum("_n").alias("_n"))
    return merged.withColumn("_last", F.when(~F.col("_last").eqNullSafe(F.col("_first")), F.col("_last")))


def folded_queue(folds: DataFrame) -> DataFrame:
    """Queue rows from one fold per key."""
    folded = folds.select("_key", F.col("_first.row").alias("_first"),
                          F.coalesce("_last", "_first")["row"].alias("_last"), "_n")
    status = first_status(F.col("_first.route"))
    closed = P.is_terminal(status)
    kept = F.when(closed, F.col("_first")).otherwise(F.col("_last"))
    return folded.withColumn("_kept", kept).select(
        F.col("_key").alias("invoice_id"), "_kept.*", status.alias("status"),
        F.col("_first.ts").alias("submitted_at"), F.col("_first.actor").alias("submitted_by"),
        (F.col("_n") - 1).alias("resubmissions"), closed.alias("resubmissions_refused"),
    ).withColumnRenamed("ts", "updated_at").drop("actor")


def submission_outcomes(submissions: DataFrame) -> DataFrame:
    """Adds ``queue_id``, ``was_new`` and the ``status`` each submission returned."""
    keyed = submissions.withColumn("queue_id", queue_key())
    first = keyed.groupBy("queue_id").agg(
        F.min("seq").alias("_first_seq"), F.min_by("route", "seq").alias("_first_route"),
        F.count(F.lit(1)).alias("_n"))
    return (join_per_key(keyed, first, "queue_id", "seq", "inner", count="_n")
            .withColumn("was_new", F.col("seq") == F.col("_first_seq"))
            .withColumn("status", first_status(F.col("_first_route")))
            .drop("_first_seq", "_first_route", "_n"))


def intake_events(submissions: DataFrame) -> DataFrame:
    """The audit events of every submission, numbered ``pos`` within it."""
    rows = submission_outcomes(submissions)
    new, auto = F.col("was_new"), F.col("route") == P.LADDER[0]
    refused = ~new & P.is_terminal(F.col("status"))
    none = F.lit(None).cast("string")

    def event(kind: str, actor: Column, before: Column, after: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("event_type"), actor.alias("actor"),
                        before.alias("from_status"), after.alias("to_status"),
                        detail.alias("detail"))

    def blob(**cols: Column) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(cols.items())]),
                         {"ignoreNullFields": "false"})

    status, actor, engine = F.col("status"), F.col("actor"), F.lit("policy-engine")
    scored = blob(source_file=F.col("source_file"), vendor=F.col("vendor"), amount=F.col("amount"))
    assigned = blob(route=F.col("route"), tier=P.route_tier(F.col("route")),
                    approver=P.route_approver(F.col("route")),
                    policy_version=F.lit(P.POLICY_VERSION))
    alert = blob(route=F.col("route"), invoice_id=F.col("queue_id"))
    events = F.array_compact(F.array(
        F.when(refused, event("intake.duplicate_submission", actor, status, status, blob(
            reason=F.lit("invoice already decided; re-scoring skipped"),
            source_file=F.col("source_file")))),
        F.when(new, event("intake.scored", actor, none, status, scored)),
        F.when(~new & ~refused, event("intake.rescored", actor, status, status, scored)),
        F.when(~refused, event("routing.assigned", engine, none, status, assigned)),
        F.when(new & auto, event("approval.automatic", engine, none, F.lit("auto_approved"),
                                 blob(reason=F.lit("no approval rules triggered")))),
        F.when(new & ~auto, event("notification.generated", engine, none, status, alert))))
    return rows.select(
        F.col("queue_id").alias("invoice_id"), "seq", "ts", F.posexplode(events).alias("pos", "e")
    ).select("invoice_id", "seq", "pos", "ts", "e.*")


def alerts_for_new(submissions: DataFrame) -> DataFrame:
    """Full alert records of the submissions that entered the queue for review."""
    rows = submission_outcomes(submissions).where(
        F.col("was_new") & (F.col("route") != P.LADDER[0]))
    return build_notifications(
        rows.withColumn("invoice_id", F.col("queue_id")).withColumn("submitted_at", F.col("ts")))


def view(queue: DataFrame, statuses: Iterable[str] | None = None,
         routes: Iterable[str] | None = None) -> DataFrame:
    """Queue rows, highest route first, then oldest; the filters reach the scan."""
    if statuses:
        queue = queue.where(F.col("status").isin(*statuses))
    if routes:
        queue = queue.where(F.col("route").isin(*routes))
    return queue.withColumn("route_rank", P.route_rank(F.col("route"))).orderBy(
        F.desc("route_rank"), "submitted_at", "invoice_id")


def facets(queue: DataFrame) -> DataFrame:
    """Statuses and routes that occur, with their place in the ladder and row counts."""
    def counted(name: str, order: tuple[str, ...], labels: dict[str, str]) -> DataFrame:
        known = {v: i for i, v in enumerate(order)}
        return (queue.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("value").isin(*order))
                .select(F.lit(name).alias("facet"), "value",
                        P.lookup(F.col("value"), labels).alias("label"),
                        P.lookup(F.col("value"), known).alias("position"), "n"))

    status = counted("status", tuple(P.STATUS_LABELS), P.STATUS_LABELS)
    route = counted("route", P.LADDER, {r: m[0] for r, m in P.ROUTES.items()})
    return status.unionByName(route)
