"""The review workflow for one invoice, one event at a time.

Streams meet submissions and reviewer actions interleaved and in small steps, so
the state is kept per invoice and moved on event by event. The batch replay
reaches the same outcomes without a fold.

A stretch of events is also a value of its own: what it makes of every state it may start
from (:class:`Effect`). Effects compose, so a long case need not be walked in one piece.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from tallyguard.policy import ACTIONS, LADDER, TERMINAL_STATUSES


OUTCOME = ("invoice_id string, seq long, event_type string, actor string, refusal string, "
           "from_status string, to_status string, route_before string, route_after string, "
           "first_approver string")


class State(NamedTuple):
    status: str | None = None       # None: not in the queue yet
    route: str | None = None
    signer: str | None = None


class Outcome(NamedTuple):
    event_type: str | None = None
    refusal: str | None = None
    first_approver: str | None = None


def outcome(state: State, kind: str, route: str | None, action: str | None,
            actor: str | None) -> tuple[State, tuple]:
    """The next state and (event_type, actor, refusal, from and to status, route before and
    after, first approver) of one submission or action."""
    after, said = submit(state, route) if kind == "submit" else act(state, action, actor)
    done = said.refusal is None
    return after, (
        said.event_type, (actor or "").strip(), said.refusal,
        state.status if done else None, after.status if done else None,
        state.route if done else None, after.route if done else None, said.first_approver)


def submit(state: State, route: str) -> tuple[State, Outcome]:
    if state.status is None:
        status = "auto_approved" if route == LADDER[0] else "pending_review"
        return State(status, route), Outcome("intake.scored")
    if state.status in TERMINAL_STATUSES:
        return state, Outcome("intake.duplicate_submission")
    return state._replace(route=route), Outcome("intake.rescored")


def act(state: State, action: str | None, actor: str | None) -> tuple[State, Outcome]:
    actor = (actor or "").strip()
    if action not in ACTIONS:
        return state, Outcome(refusal="unknown action")
    if not actor:
        return state, Outcome(refusal="reviewer name required")
    if state.status is None:
        return state, Outcome(refusal="not in the review queue")
    if state.status in TERMINAL_STATUSES:
        return state, Outcome(refusal="already decided")
    if action == "reject":
        return state._replace(status="rejected"), Outcome("review.rejected")
    if action == "request_info":
        return state._replace(status="info_requested"), Outcome("review.info_requested")
    if action == "escalate":
        rung = min(LADDER.index(state.route) + 1, len(LADDER) - 1)
        return State("pending_review", LADDER[rung]), Outcome("review.escalated")
    if state.route != LADDER[-1]:
        return state._replace(status="approved"), Outcome("review.approved")
    if state.status != "awaiting_second_approval":
        return State("awaiting_second_approval", state.route, actor), Outcome(
            "review.first_approval")
    if (state.signer or "").lower() == actor.lower():
        return state, Outcome(refusal="same approver twice")
    return state._replace(status="approved"), Outcome(
        "review.approved", first_approver=state.signer)


class Given(str):
    """The signer a stretch of events starts with, whoever that is."""


class Effect(NamedTuple):
    """One row of a stretch's effect: from a start to an end.

    A signer matters only while a second approval is awaited, and only in comparison with
    the first who approves then (``asks``): ``same`` tells for which outcome of it this row
    holds, null if it is never made. ``inherits`` means the end keeps the given signer.
    """
    status: str | None
    route: str | None
    asks: str | None
    same: bool | None
    end_status: str | None
    end_route: str | None
    end_signer: str | None
    inherits: bool


_AWAITS = "awaiting_second_approval"
#: Every start that is not closed; a closed case stays as it is.
STARTS = (State(), *(State(status, route) for status in ("pending_review", "info_requested", _AWAITS)
                     for route in LADDER))


def effects(events: Iterable[tuple]) -> list[Effect]:
    """The effect of (kind, route, action, actor) events in order, one row per start."""
    events = list(events)
    # Longer than any name here, so equal to none of them.
    nobody = Given("?" * (1 + max((len(e[3] or "") for e in events), default=0)))
    starts = [s._replace(signer=nobody) if s.status == _AWAITS else s for s in STARTS]
    ends, asked = _run(starts, events)
    rows = []
    for start, end in zip(starts, ends):
        asks = asked.get(start)
        rows.append(_effect(start, asks, False if asks else None, end))
    again = [s._replace(signer=Given(asked[s])) for s in starts if s in asked]
    for start, end in zip(again, _run(again, events)[0]):
        rows.append(_effect(start, str(start.signer), True, end))
    return rows


def _effect(start: State, asks: str | None, same: bool | None, end: State) -> Effect:
    inherits = isinstance(end.signer, Given)
    return Effect(start.status, start.route, asks, same, end.status, end.route,
                  None if inherits else end.signer, inherits)


def _run(starts: list[State], events: list[tuple]) -> tuple[list[State], dict[State, str]]:
    """Ends of the starts, and who first met the given signer; equal states walk together."""
    at: dict[State, list[State]] = {}
    for s in starts:
        at.setdefault(s, []).append(s)
    asked: dict[State, str] = {}
    for kind, route, action, actor in events:
        moved: dict[State, list[State]] = {}
        for now, origins in at.items():
            after, said = submit(now, route) if kind == "submit" else act(now, action, actor)
            if isinstance(said.first_approver, Given):
                asked.update(dict.fromkeys(origins, (actor or "").strip().lower()))
            moved.setdefault(after, []).extend(origins)
        at = moved
    end = {start: now for now, origins in at.items() for start in origins}
    return [end[s] for s in starts], asked


def apply(rows: Iterable[Effect], now: State) -> State:
    """The state after a stretch that was entered in state ``now``."""
    if now.status in TERMINAL_STATUSES:
        return now
    for e in rows:
        if (e.status, e.route) == (now.status, now.route):
            same = e.asks is not None and e.asks == (now.signer or "").lower()
            if e.same is None or e.same == same:
                return State(e.end_status, e.end_route, now.signer if e.inherits else e.end_signer)
    raise ValueError(f"no effect on {now}")
