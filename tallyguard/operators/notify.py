"""The alert record each routed invoice would cause; nothing is sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.functions.text import blank_to_null, money


def due_by(submitted_at: Column, sla_hours: Column) -> Column:
    """Absolute deadline text, or null when there is no start or no limit."""
    deadline = submitted_at + F.make_dt_interval(F.lit(0), sla_hours)
    return F.when(sla_hours > 0, F.date_format(deadline, "yyyy-MM-dd HH:mm 'UTC'"))


def build_notifications(queue: DataFrame) -> DataFrame:
    """One alert per row from its current route (after any escalation).

    Needs invoice_id, vendor, amount, route, rules, submitted_at, policy_version.
    """
    route = F.col("route")
    auto = route == P.LADDER[0]
    who = F.coalesce(blank_to_null(F.col("invoice_id")), P.say("no invoice"))
    vendor = F.coalesce(blank_to_null(F.col("vendor")), P.say("no vendor"))
    amount = F.coalesce(money(F.col("amount")), P.say("no amount"))
    label = F.lower(P.route_label(route))
    sla = P.route_sla(route)
    priority = F.coalesce(P.lookup(P.route_tier(route), P.PRIORITY), F.lit("Standard"))
    hours = sla.cast("string")
    deadline = due_by(F.col("submitted_at"), sla)
    two = F.when(route == P.LADDER[-1], P.say("two approvers")).otherwise(F.lit(""))
    sla_line = F.concat(
        F.when(deadline.isNotNull(), P.say("respond by", deadline, hours))
        .when(sla > 0, P.say("respond within", hours)).otherwise(P.say("respond")), two)
    none = F.array().cast("array<string>")
    people = none
    for r, names in P.RECIPIENTS.items():
        people = F.when(route == r, F.array(*[F.lit(n) for n in names])).otherwise(people)
    return queue.select(
        who.alias("invoice_id"), "route", (~auto).alias("is_actionable"),
        F.when(auto, F.lit("None")).otherwise(priority).alias("priority"),
        people.alias("recipients"),
        F.when(auto, P.say("subject, automatic", who))
        .otherwise(P.say("subject", priority, who, label, amount)).alias("subject"),
        F.when(auto, P.say("summary, automatic", who, vendor, amount))
        .otherwise(P.say("summary", who, vendor, amount, label, F.col("policy_version")))
        .alias("summary_line"),
        F.when(auto, F.filter("rules", lambda _: F.lit(False))).otherwise(F.col("rules"))
        .alias("reasons"),
        F.when(auto, P.say("no action")).otherwise(sla_line).alias("sla_line"))
