"""Reviewer actions replayed over the queue: new status, events and refusals.

The workflow is a state machine per invoice, but its outcome has a closed form,
so no invoice is folded row by row and none has to fit into one task:

* the route at any time is the first route plus the accepted escalations so far,
  so the first three escalations of an invoice tell when it reached dual control;
* a rejection always closes an invoice, an approval below dual control too;
* under dual control an approval closes it exactly when the action right before
  it is an approval by somebody else;
* the earliest closing action ends the case: everything after it is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.operators.ordering import CHUNK, join_per_key, with_previous
from tallyguard.streaming.workflow import OUTCOME, Effect, State, apply, effects, outcome

#: Everything that counts as white space around a name, as in the stream.
_AROUND = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

_NEVER = 2 ** 62
_TOP = len(P.LADDER) - 1


def replay(intake: DataFrame, actions: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every action with its outcome.

    ``intake``: invoice_id, route and optionally status and first_approver of the queued
    invoices; a row that awaits its second approval goes on from its first.
    ``actions``: invoice_id, action_seq (unique per invoice), action, actor, note, ts.
    Adds ``refusal`` (null when applied), event_type, from_status, to_status,
    route_before, route_after and first_approver.
    """
    status = F.col("status") if "status" in intake.columns else F.lit("pending_review")
    start = intake.select("invoice_id", P.route_rank(F.col("route")).alias("_rank0"),
                          status.alias("_status0"), _signer(intake).alias("_signer0"))
    named = actions.withColumn("actor", F.regexp_replace("actor", _AROUND, ""))
    rows = join_per_key(named, start, "invoice_id", "action_seq")
    bad = (F.when(~F.coalesce(F.col("action").isin(*P.ACTIONS), F.lit(False)), "unknown action")
           .when(F.coalesce(F.col("actor"), F.lit("")) == "", "reviewer name required")
           .when(F.col("_rank0").isNull(), "not in the review queue")
           .when(P.is_terminal(F.col("_status0")), "already decided"))
    rows = rows.withColumn("_bad", bad)
    legal = rows.where("_bad IS NULL")

    order = W.partitionBy("invoice_id").orderBy("action_seq")
    climbs = (legal.where("action = 'escalate'").select("invoice_id", "action_seq")
              .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= _TOP))
    climbs = climbs.groupBy("invoice_id").agg(*[
        F.max(F.when(F.col("_n") == i, F.col("action_seq"))).alias(f"_e{i}")
        for i in range(1, _TOP + 1)])

    legal = join_per_key(legal, climbs, "invoice_id", "action_seq")
    # Sequence number after which the invoice is under dual control.
    dual_after = F.when(F.col("_rank0") == _TOP, F.lit(-_NEVER))
    for i in range(1, _TOP + 1):
        dual_after = dual_after.when(
            F.col("_rank0") == _TOP - i, F.coalesce(F.col(f"_e{i}"), F.lit(_NEVER)))
    climbed = sum((F.coalesce((F.col(f"_e{i}") < F.col("action_seq")).cast("int"), F.lit(0))
                   for i in range(2, _TOP + 1)),
                  F.coalesce((F.col("_e1") < F.col("action_seq")).cast("int"), F.lit(0)))
    legal = (legal.withColumn("_dual", F.col("action_seq") > dual_after)
             .withColumn("_rank", F.least(F.col("_rank0") + climbed, F.lit(_TOP))))
    legal = with_previous(legal, "invoice_id", "action_seq",
                          F.struct("action", F.lower("actor").alias("who")), "_prev", chunk)

    # A pending first approval counts as the action before the first.
    pending = F.when(F.col("_status0") == "awaiting_second_approval", F.struct(
        F.lit("approve").alias("action"), F.lower(F.coalesce("_signer0", F.lit(""))).alias("who")))
    legal = legal.withColumn("_prev", F.coalesce("_prev", pending))

    approve = F.col("action") == "approve"
    after_approval = F.coalesce(F.col("_prev.action") == "approve", F.lit(False))
    same = F.col("_prev.who") == F.lower("actor")
    closes = (F.col("action") == "reject") | (approve & ~F.col("_dual")) | (
        approve & F.col("_dual") & after_approval & ~same)
    legal = legal.withColumn("_closes", closes)
    ends = legal.where("_closes").groupBy("invoice_id").agg(F.min("action_seq").alias("_end"))
    legal = join_per_key(legal, ends, "invoice_id", "action_seq")

    late = F.coalesce(F.col("action_seq") > F.col("_end"), F.lit(False))
    repeat = approve & F.col("_dual") & after_approval & same
    refusal = F.when(late, "already decided").when(repeat, "same approver twice")
    before = (F.when(F.col("_prev").isNull(), F.col("_status0"))
              .when(F.col("_prev.action") == "request_info", "info_requested")
              .when(F.col("_prev.action") == "escalate", "pending_review")
              .otherwise("awaiting_second_approval"))
    first_sign = approve & F.col("_dual") & ~after_approval
    after = (F.when(F.col("action") == "reject", "rejected")
             .when(F.col("action") == "request_info", "info_requested")
             .when(F.col("action") == "escalate", "pending_review")
             .when(first_sign, "awaiting_second_approval").otherwise("approved"))
    event = (F.when(F.col("action") == "reject", "review.rejected")
             .when(F.col("action") == "request_info", "review.info_requested")
             .when(F.col("action") == "escalate", "review.escalated")
             .when(first_sign, "review.first_approval").otherwise("review.approved"))
    new_rank = F.when(F.col("action") == "escalate",
                      F.least(F.col("_rank") + 1, F.lit(_TOP))).otherwise(F.col("_rank"))
    done = (legal.withColumn("refusal", refusal)
            .withColumn("event_type", F.when(refusal.isNull(), event))
            .withColumn("from_status", F.when(refusal.isNull(), before))
            .withColumn("to_status", F.when(refusal.isNull(), after))
            .withColumn("route_before", F.when(refusal.isNull(), _route(F.col("_rank"))))
            .withColumn("route_after", F.when(refusal.isNull(), _route(new_rank)))
            .withColumn("_second", (F.col("event_type") == "review.approved") & F.col("_dual")))
    # The first approver as they signed; the action before may be a refused repeat.
    signed = done.where("event_type = 'review.first_approval'").groupBy("invoice_id").agg(
        F.max_by("actor", "action_seq").alias("_signed"))
    done = join_per_key(done, signed, "invoice_id", "action_seq").withColumn(
        "first_approver", F.when(F.col("_second"), F.coalesce("_signed", "_signer0")))

    shape = [*actions.columns, "refusal", "event_type", "from_status", "to_status",
             "route_before", "route_after", "first_approver"]
    refused = rows.where("_bad IS NOT NULL").withColumn("refusal", F.col("_bad"))
    return done.select(*shape).unionByName(
        refused.select(*actions.columns, "refusal"), allowMissingColumns=True)


def fold_interleaved(items: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Outcome of submissions and reviewer actions in one log, in ``seq`` order per invoice.

    ``items``: invoice_id, seq (unique per invoice), kind (submit or action), route, action,
    actor. A resubmission may change the route between any two actions, which has no closed
    form, so events are walked. A case of up to ``chunk`` events is walked as a whole. Longer
    ones are cut into ranges of ``chunk`` sequence numbers: each range yields its effect on
    every possible start, a case's effects are composed in order, which tells where each
    range starts, and then the ranges are walked apart from each other.
    """
    rows = items.select("invoice_id", "seq", "kind", "route", "action", "actor")
    sizes = rows.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > chunk).select("invoice_id")
    part = ["invoice_id", "_chunk"]
    cut = rows.join(large, "invoice_id").withColumn("_chunk", F.floor(F.col("seq") / F.lit(chunk)))
    effect = ", ".join(f"{n} {t}" for n, t in _EFFECT)
    ranges = cut.repartition(*part).sortWithinPartitions(*part, "seq").mapInPandas(
        _effects, f"invoice_id string, _chunk long, {effect}")
    starts = ranges.repartition("invoice_id").sortWithinPartitions(*part).mapInPandas(
        _starts, f"invoice_id string, _chunk long, {_START}")
    whole = rows.join(large, "invoice_id", "left_anti").select(
        "*", F.lit(0).cast("long").alias("_chunk"),
        *[F.lit(None).cast("string").alias(c) for c in ("_status", "_route", "_signer")])
    begun = whole.unionByName(cut.join(starts, part))
    return begun.repartition(*part).sortWithinPartitions(*part, "seq").mapInPandas(_walk, OUTCOME)


_START = "_status string, _route string, _signer string"
_EFFECT = list(zip(Effect._fields, ("string", "string", "string", "boolean", "string", "string",
                                    "string", "boolean")))


def _none(x: object) -> object:
    """Missing values of a pandas column as None."""
    return None if x is None or x != x else x


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """Runs of equal keys over sorted batches, row by row, none of them held."""
    flat = (r for pdf in batches for r in pdf.itertuples(index=False, name="Row"))
    return groupby(flat, key=lambda r: tuple(_none(r[i]) for i in range(len(keys))))


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for key, rows in _groups((b[["invoice_id", "_chunk", "kind", "route", "action", "actor"]]
                              for b in batches), ["invoice_id", "_chunk"]):
        found = effects(tuple(map(_none, r[2:])) for r in rows)
        yield pd.DataFrame([(*key, *e) for e in found], columns=["invoice_id", "_chunk", *Effect._fields])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, now = object(), State()
    for key, rows in _groups(batches, ["invoice_id", "_chunk"]):
        if key[0] != current:
            current, now = key[0], State()
        yield pd.DataFrame([(*key, *now)], columns=["invoice_id", "_chunk", "_status", "_route", "_signer"])
        now = apply((Effect(*map(_none, r[2:])) for r in rows), now)


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in OUTCOME.split(", ")]
    current, now = object(), State()
    names = {"_chunk": "part", "_status": "start_status", "_route": "start_route", "_signer": "start_signer"}
    for pdf in batches:
        out = []
        for r in pdf.rename(columns=names).itertuples(index=False):
            if (r.invoice_id, r.part) != current:
                current = r.invoice_id, r.part
                now = State(*map(_none, (r.start_status, r.start_route, r.start_signer)))
            now, said = outcome(now, r.kind, _none(r.route), _none(r.action), _none(r.actor))
            out.append((r.invoice_id, r.seq, *said))
        yield pd.DataFrame(out, columns=columns)


def _signer(intake: DataFrame) -> Column:
    return (F.col("first_approver") if "first_approver" in intake.columns
            else F.lit(None).cast("string"))


def _route(rank: Column) -> Column:
    return P.lookup(rank, dict(enumerate(P.LADDER)))


def rejects(replayed: DataFrame) -> DataFrame:
    """Refused actions; they leave no event, so they are kept apart."""
    return replayed.where("refusal IS NOT NULL").select(
        "invoice_id", "action_seq", "action", "actor", "refusal")


def events(replayed: DataFrame) -> DataFrame:
    return replayed.where("refusal IS NULL").select(
        "invoice_id", F.col("action_seq").alias("seq"), "ts", "event_type", "actor",
        "from_status", "to_status", "note", "route_before", "route_after", "first_approver")


def reviewed_queue(intake: DataFrame, replayed: DataFrame) -> DataFrame:
    """Queue rows after all actions: one mergeable aggregate per invoice."""
    ok = replayed.where("refusal IS NULL")
    at = F.col("action_seq")

    def last(value: str, cond: Column) -> Column:
        return F.max_by(F.when(cond, F.col(value)), F.when(cond, at))

    kind = F.col("event_type")
    any_event = kind.isNotNull()
    decided = kind.isin("review.approved", "review.rejected")
    signed = kind == "review.first_approval"
    folded = ok.groupBy("invoice_id").agg(
        last("to_status", any_event).alias("_status"), last("route_after", any_event).alias("_route"),
        last("ts", any_event).alias("updated_at"),
        last("actor", decided).alias("decided_by"), last("ts", decided).alias("decided_at"),
        last("note", kind != "review.first_approval").alias("decision_note"),
        last("actor", signed).alias("_signed_by"), last("ts", signed).alias("_signed_at"),
        F.max(F.when(signed, at)).alias("_sign_seq"),
        F.max(F.when(kind == "review.escalated", at)).alias("_climb_seq"),
        F.count(F.lit(1)).alias("applied"))
    status = F.col("status") if "status" in intake.columns else F.lit("pending_review")
    base = intake.withColumn("_status0", status).withColumnRenamed("route", "_route0")
    base = base.withColumn("_signer0", _signer(intake))
    keep = [c for c in intake.columns if c not in ("route", "status", "first_approver")]
    untouched = F.col("_sign_seq").isNull() & F.col("_climb_seq").isNull()
    # An escalation clears a first approval; asking for information does not.
    valid = F.col("_sign_seq") > F.coalesce(F.col("_climb_seq"), F.lit(-_NEVER))
    return base.join(folded, "invoice_id", "left").select(
        *keep, F.coalesce("_status", "_status0").alias("status"),
        F.coalesce("_route", "_route0").alias("route"), "updated_at",
        F.when(valid, F.col("_signed_by")).when(untouched, F.col("_signer0"))
        .alias("first_approver"),
        F.when(valid, F.col("_signed_at")).alias("first_approved_at"),
        "decided_by", "decided_at", "decision_note",
        F.coalesce("applied", F.lit(0)).alias("applied"))
