import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.operators import queue, review
from tallyguard.streaming import workflow
from tallyguard.streaming.jobs import WORK_ITEM

ACTS = "invoice_id string, action_seq long, action string, actor string, note string, ts timestamp"
T0 = dt.datetime(2025, 1, 1)


def stepwise(intake, actions):
    """One action at a time, as a check on the closed form."""
    state = {i: workflow.submit(workflow.State(), r)[0] for i, r in intake}
    out = {}
    for inv, seq, action, actor, _, _ in sorted(actions, key=lambda a: a[1]):
        before = state.get(inv, workflow.State())
        after, result = workflow.act(before, action, actor)
        state[inv] = after
        done = result.refusal is None
        out[seq] = (result.refusal, result.event_type, before.status if done else None,
                    after.status if done else None, before.route if done else None,
                    after.route if done else None, result.first_approver)
    return out, {i: s for i, s in state.items() if s.status}


@pytest.mark.parametrize("seed,chunk", [(1, 100_000), (2, 3)])
def test_replay_equals_stepwise(spark, seed, chunk):
    rng = random.Random(seed)
    intake = [(f"I{i}", rng.choice(["manager_review", "controller_review", "dual_control",
                                    "auto_approve"])) for i in range(40)]
    names = ["Ann", "ann", "Bob", " ", None, "Cy ", "\t", "\u2003Bob\n"]
    actions = []
    for seq in range(900):
        # one invoice takes a third of all actions
        inv = "I0" if rng.random() < 0.33 else f"I{rng.randrange(44)}"
        act = rng.choices(["approve", "reject", "request_info", "escalate", "shred"],
                          [6, 0.3, 3, 3, 1])[0]
        actions.append((inv, seq, act, rng.choice(names), f"n{seq}", T0 + dt.timedelta(hours=seq)))
    df_i = spark.createDataFrame(intake, "invoice_id string, route string").selectExpr(
        "*", "IF(route = 'auto_approve', 'auto_approved', 'pending_review') AS status")
    df_a = spark.createDataFrame(actions, ACTS).repartition(3)
    replayed = review.replay(df_i, df_a, chunk=chunk)
    got = {r.action_seq: (r.refusal, r.event_type, r.from_status, r.to_status, r.route_before,
                          r.route_after, r.first_approver) for r in replayed.collect()}
    want, final = stepwise(intake, actions)
    assert got == want
    rows = {r.invoice_id: r for r in review.reviewed_queue(df_i, replayed).collect()}
    for inv, s in final.items():
        assert (rows[inv].status, rows[inv].route) == (s.status, s.route), inv
        assert rows[inv].first_approver == s.signer, inv
    assert review.rejects(replayed).count() == sum(w[0] is not None for w in want.values())


def test_replay_goes_on_from_a_pending_approval(spark):
    intake = [(f"I{i}", "dual_control", "awaiting_second_approval", "Ann") for i in range(5)]
    steps = {"I0": [("approve", "Bob")], "I1": [("approve", "ANN ")],
             "I2": [("request_info", "Bob"), ("approve", "Ann"), ("approve", "Bob")],
             "I3": [("escalate", "Cy"), ("approve", "Ann")], "I4": [("shred", "Bob")]}
    actions = [(inv, 10 * i + n, act, who, None, T0) for i, (inv, todo) in enumerate(steps.items())
               for n, (act, who) in enumerate(todo)]
    df_i = spark.createDataFrame(
        intake, "invoice_id string, route string, status string, first_approver string")
    replayed = review.replay(df_i, spark.createDataFrame(actions, ACTS))
    got = {r.action_seq: r for r in replayed.collect()}
    state, last = {i: workflow.State(s, r, f) for i, r, s, f in intake}, {}
    for inv, seq, act, who, _, _ in actions:
        state[inv], want = workflow.act(state[inv], act, who)
        assert (got[seq].refusal, got[seq].event_type, got[seq].first_approver) == (
            want.refusal, want.event_type, want.first_approver)
    rows = {r.invoice_id: r for r in review.reviewed_queue(df_i, replayed).collect()}
    for inv, s in state.items():
        assert (rows[inv].status, rows[inv].first_approver) == (s.status, s.signer), inv


def test_submission_fold(spark):
    auto, mgr, dual = "auto_approve", "manager_review", "dual_control"
    rows = [("A", None, 100.0, auto, 1), ("A", None, 900.0, mgr, 2),        # refused
            ("B", None, 10.0, mgr, 3), ("B", None, 20.0, dual, 4),          # rescored
            ("C", None, 10.0, mgr, 5), ("C", None, 1.0, auto, 6),           # stays open
            (None, "x.pdf", None, mgr, 7), ("", None, None, mgr, 8)]
    df = spark.createDataFrame(rows, "invoice_id string, source_file string, amount double, "
                                     "route string, seq long").selectExpr(
        "*", "'v' AS vendor", "timestamp_seconds(seq) AS ts", "concat('u', seq) AS actor")
    got = {r.invoice_id: r for r in queue.fold_submissions(df).collect()}
    assert set(got) == {"A", "B", "C", "UNREAD::x.pdf", "UNREAD::unknown"}
    assert (got["A"].status, got["A"].amount, got["A"].resubmissions_refused) == (
        "auto_approved", 100.0, True)
    assert (got["B"].status, got["B"].amount, got["B"].route) == ("pending_review", 20.0, dual)
    assert (got["B"].submitted_by, got["B"].submitted_at.second, got["B"].updated_at.second) == (
        "u3", 3, 4)
    assert (got["C"].status, got["C"].route) == ("pending_review", auto)
    kinds = {}
    for e in sorted(queue.intake_events(df).collect(), key=lambda e: (e.seq, e.pos)):
        kinds.setdefault(e.seq, []).append(e.event_type)
    assert kinds[1] == ["intake.scored", "routing.assigned", "approval.automatic"]
    assert kinds[2] == ["intake.duplicate_submission"]
    assert kinds[3] == ["intake.scored", "routing.assigned", "notification.generated"]
    assert kinds[4] == kinds[6] == ["intake.rescored", "routing.assigned"]


NAMES = ["Ann", "ann ", "BOB", "bob", "", None, "cy"]
EVENT = st.one_of(
    st.tuples(st.just("submit"), st.sampled_from(P.LADDER), st.none(), st.just("bot")),
    st.tuples(st.just("action"), st.none(), st.sampled_from(
        ["approve", "approve", "approve", "request_info", "escalate", "reject", "shred"]),
        st.sampled_from(NAMES)))
ANY_STATE = st.one_of(
    st.just(workflow.State()),
    st.builds(workflow.State, st.sampled_from(["approved", "rejected", "auto_approved"]),
              st.sampled_from(P.LADDER)),
    st.builds(workflow.State, st.sampled_from(["pending_review", "info_requested"]),
              st.sampled_from(P.LADDER)),
    st.builds(workflow.State, st.just("awaiting_second_approval"), st.sampled_from(P.LADDER),
              st.sampled_from(["Ann", "bob", "CY", "dee"])))


def visible(state):
    """A signer matters only while a second approval is awaited."""
    return state if state.status == "awaiting_second_approval" else state._replace(signer=None)


@settings(max_examples=500, deadline=None)
@given(ANY_STATE, st.lists(EVENT, max_size=12), st.integers(0, 12))
def test_effects_compose(start, events, cut):
    now = start
    for e in events:
        now, _ = workflow.outcome(now, *e)
    assert visible(workflow.apply(workflow.effects(events), start)) == visible(now)
    middle = workflow.apply(workflow.effects(events[:cut]), start)
    assert visible(workflow.apply(workflow.effects(events[cut:]), middle)) == visible(now)


def test_long_cases_are_walked_in_ranges(spark):
    rng = random.Random(8)
    rows = []
    for seq in range(600):
        inv = rng.choice(["hot", "hot", "hot", "I1", "I2", None, "I3"])
        if rng.random() < 0.25:
            rows.append((inv, seq, "submit", rng.choice(P.LADDER[1:]), None, "bot"))
        else:
            rows.append((inv, seq, "action", None, rng.choices(
                ["approve", "request_info", "escalate", "reject", "shred"], [6, 3, 2, 0.05, 1])[0],
                rng.choice(["ann", "ann", "Ann", ""])))
    items = spark.createDataFrame(rows, WORK_ITEM)
    got = [sorted(map(tuple, review.fold_interleaved(items, chunk).collect()), key=str)
           for chunk in (100_000, 3, 40)]
    assert len(got[0]) == 600 and got[1] == got[0] and got[2] == got[0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = review.fold_interleaved(items, 40).where("invoice_id = 'hot'")
        assert hot.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
