"""Policy values and the small lookup tables that routing and reporting share."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: these must equal the published policy ------------------
POLICY_VERSION = "2.0.0"

AMOUNT_TOLERANCE = 0.10
DATE_WINDOW_DAYS = 90
W_AMOUNT = 0.75
W_DATE = 0.25
CONFIRMED_DUPLICATE = 0.95
NEAR_DUPLICATE = 0.80
LEGAL_SUFFIXES = (
    "ltd", "limited", "inc", "incorporated", "llc", "llp", "plc", "co", "corp",
    "corporation", "company", "pvt", "private", "gmbh", "bv", "sa", "ag",
)

# (key, label, exclusive upper bound); the last band takes everything above.
BANDS = (
    ("cleared", "Cleared", 0.25),
    ("low", "Low", 0.50),
    ("elevated", "Elevated", 0.75),
    ("high", "High", 1.01),
)
SPLIT_SPREAD = 0.50
RISKY_PROBABILITY = 0.50

REPORTING_THRESHOLD = 10_000.0
STRUCTURING_BAND = 0.95
DE_MINIMIS = 1_000.0
MANAGER_LIMIT = 2_500.0
CONTROLLER_LIMIT = 10_000.0
DUAL_CONTROL_LIMIT = 50_000.0
OUTLIER_ZSCORE = 0.70
RUSHED_TERMS = 0.05

# Lowest authority first.
LADDER = ("auto_approve", "manager_review", "controller_review", "dual_control")
# route -> (label, approver, tier, sla_hours)
ROUTES = {
    "auto_approve": ("Auto-approved", "System", "routine", 0),
    "manager_review": ("Manager review", "AP Manager", "elevated", 48),
    "controller_review": ("Controller review", "Financial Controller", "high", 24),
    "dual_control": ("Dual control", "Controller + Internal Audit", "critical", 8),
}
RECIPIENTS = {
    "manager_review": ("ap-manager@yourcompany.example",),
    "controller_review": ("controller@yourcompany.example",),
    "dual_control": ("controller@yourcompany.example", "internal-audit@yourcompany.example"),
}
PRIORITY = {"routine": "Routine", "elevated": "Standard", "high": "High", "critical": "Urgent"}

STATUS_LABELS = {
    "pending_review": "Pending review",
    "info_requested": "Info requested",
    "awaiting_second_approval": "Awaiting 2nd approval",
    "approved": "Approved",
    "auto_approved": "Auto-approved",
    "rejected": "Rejected",
}
OPEN_STATUSES = ("pending_review", "info_requested", "awaiting_second_approval")
TERMINAL_STATUSES = ("approved", "auto_approved", "rejected")
DECIDED_STATUSES = ("approved", "rejected")
ACTIONS = ("approve", "reject", "request_info", "escalate")

GENESIS_HASH = "0" * 64
RETRAIN_THRESHOLD = 10
LOW_SAMPLE = 5
RUN_HISTORY_LIMIT = 200
VENDOR_PROFILE_LIMIT = 100
EVENT_LIMIT = 500
EVENT_VIEW_ROWS = 200

# Sentences that reviewers read; {} stands for a value.
TEXTS = {
    "decision, no rule": "No approval rules triggered, cleared for automatic payment.",
    "decision": "{} rule(s) triggered; highest authority required: {}.",
    "no invoice": "unassigned invoice",
    "no vendor": "an unidentified vendor",
    "no amount": "amount not extracted",
    "two approvers": " Requires sign-off from two different approvers. A single approval will not "
                     "release this invoice.",
    "respond by": "Respond by {} ({}h SLA).",
    "respond within": "Respond within {} hours of assignment.",
    "respond": "Respond as soon as practical.",
    "subject, automatic": "No notification: {} cleared automatically",
    "subject": "[{}] {} needs {}, {}",
    "summary, automatic": "{} from {} for {} triggered no approval rules and was auto-approved. "
                          "No approver is notified.",
    "summary": "{} from {} for {} was routed to {} under policy v{}.",
    "no action": "No action required.",
    "verified": "Verified {} event(s); hash chain intact.",
    "chain break": "Chain break at event #{}: predecessor hash does not match.",
    "tampered content": "Tampered content at event #{}: recomputed hash does not match.",
}
# ---- End of fixed values --------------------------------------------------

TEXTS["shortened log"] = "Shortened log at event #{}: the last verified event is missing."


def say(text: str, *values: Column) -> Column:
    """The sentence with its values in place; null if one of them is."""
    first, *rest = TEXTS[text].split("{}")
    parts = [x for value, piece in zip(values, rest, strict=True) for x in (value, F.lit(piece))]
    return F.concat(F.lit(first), *parts)


FEATURES = (
    "amount_zscore_norm", "threshold_proximity", "duplicate_score",
    "weekend_flag", "days_to_due_norm",
)


def lookup(key: Column, table: dict) -> Column:
    """Literal-map lookup: a handful of entries never needs a join."""
    pairs = [F.lit(x) for x in chain.from_iterable(table.items())]
    return F.try_element_at(F.create_map(*pairs), key)


def route_rank(route: Column) -> Column:
    """0 for the lowest rung; an unknown route ranks with the lowest."""
    return F.coalesce(lookup(route, {r: i for i, r in enumerate(LADDER)}), F.lit(0))


def route_label(route: Column) -> Column:
    return lookup(route, {r: m[0] for r, m in ROUTES.items()})


def route_approver(route: Column) -> Column:
    return lookup(route, {r: m[1] for r, m in ROUTES.items()})


def route_tier(route: Column) -> Column:
    return lookup(route, {r: m[2] for r, m in ROUTES.items()})


def route_sla(route: Column) -> Column:
    return lookup(route, {r: m[3] for r, m in ROUTES.items()})


def status_label(status: Column) -> Column:
    return F.coalesce(lookup(status, STATUS_LABELS), status)


def is_open(status: Column) -> Column:
    return status.isin(*OPEN_STATUSES)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)


def is_flagged(route: Column) -> Column:
    return route != F.lit(LADDER[0])


def is_decided(route: Column, status: Column) -> Column:
    return is_flagged(route) & status.isin(*DECIDED_STATUSES)


def escalate(route: Column) -> Column:
    """One rung up; the top rung stays where it is."""
    up = {r: LADDER[min(i + 1, len(LADDER) - 1)] for i, r in enumerate(LADDER)}
    return lookup(route, up)
