"""Invoice-shaped views over the star-schema tables.

Each view is a plain projection of the given Parquet tables, so its size grows
with them. Column pruning and filters reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.functions.staging import once
from tallyguard.session import tasks_for

HISTORY_CUTOFF = "2001-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vendor_name(key: Column) -> Column:
    """A name of twelve letters for a supplier; those of different suppliers are unlike."""
    return F.translate(F.substring(F.md5(key.cast("string")), 1, 12), "0123456789", "ghijklmnop")


def typed_name(name: Column, order_key: Column) -> Column:
    """The name as it stands on an invoice: every fifth is mistyped, in one of two ways."""
    return (F.when(order_key % 10 == 0, F.concat(F.substring(name, 1, 11), F.lit("z")))
            .when(order_key % 10 == 5, F.concat(F.substring(name, 1, 4), F.substring(name, 6, 7)))
            .otherwise(name))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice per (order, supplier), under the supplier's name as it was typed.

    Lines join their order on the order key and are then grouped on it, so one
    shuffle serves both; the supplier name is looked up on the smaller result. The number
    of tasks follows the size of the lines, so that of the rows in one does not.
    """
    n = tasks_for(spark, f"{sf_dir}/lineitem.parquet")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus",
        F.to_date("o_orderdate").alias("posting_date"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), vendor_name(F.col("s_suppkey")).alias("name"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    totals = (lines.repartition(n, "l_orderkey").join(orders.repartition(n, "l_orderkey"), "l_orderkey")
              .groupBy("l_orderkey", "l_suppkey", "posting_date", "o_orderstatus")
              .agg(F.sum(cents).alias("cents")))
    scale = F.when(F.col("l_orderkey") % 50 == 0, F.lit(100.0)).otherwise(F.lit(1000.0))
    number = F.concat(F.lit("INV-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"),
                      F.lit("-"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))
    terms = (15 * (1 + (F.col("l_orderkey") + F.col("l_suppkey")) % 4)).cast("int")
    return totals.join(suppliers, "l_suppkey").select(
        number.alias("invoice_id"), typed_name(F.col("name"), F.col("l_orderkey")).alias("vendor"),
        (F.col("cents") / scale).alias("amount"),
        "posting_date", F.date_add("posting_date", terms).alias("due_date"),
        F.col("l_orderkey").alias("order_key"), F.col("o_orderstatus").alias("order_status"))


def before(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("posting_date") < F.lit(HISTORY_CUTOFF).cast("date"))


def since(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("posting_date") >= F.lit(HISTORY_CUTOFF).cast("date"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return before(invoices(spark, sf_dir))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(invoices(spark, sf_dir))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk labels; every tenth order has none, so the label join has gaps."""
    inv = invoices(spark, sf_dir).where("order_key % 10 != 0")
    risk = (F.when(F.weekday("posting_date") >= 5, "weekend")
            .when(F.col("amount").between(9500.0, 9999.99), "threshold")
            .when(F.col("amount") >= 25000.0, "outlier").otherwise("none"))
    return inv.select("invoice_id", risk.alias("risk_type"),
                      F.when(risk == "none", 0).otherwise(1).alias("label"))


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices plus re-keyed copies of every 97th order's, as ``is_duplicate_of``.

    One pass over the invoices yields both.
    """
    inv = invoices(spark, sf_dir)
    both = F.array(F.lit(False), F.lit(True))
    rows = inv.select("*", F.explode(F.when(F.col("order_key") % 97 == 0, both).otherwise(
        F.array(F.lit(False)))).alias("_copy"))
    copy, own = F.col("_copy"), F.col("invoice_id")
    changed = {"invoice_id": F.concat("invoice_id", F.lit("-D")),
               "vendor": F.concat("vendor", F.lit(" Ltd.")),
               "posting_date": F.date_add("posting_date", 3)}
    return rows.select(
        *[F.when(copy, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
          for c in inv.columns], F.when(copy, own).alias("is_duplicate_of"))


def _clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def model_scores(z: Column, t: Column, w: Column, d: Column) -> Column:
    """Three closed-form scorers as a model map, so any SQL engine can check them."""
    m1 = 1.0 / (1.0 + F.exp(-(-1.5 + 4.0 * z + 1.5 * t + w - d)))
    m2 = 1.0 / (1.0 + F.exp(-(-2.5 + 8.0 * z + 2.5 * t * t + 0.5 * w)))
    m3 = _clip01(0.15 + 0.6 * z + 0.55 * t - 0.25 * d + 0.1 * w)
    return F.create_map(F.lit("m1"), m1, F.lit("m2"), m2, F.lit("m3"), m3)


def invoice_text(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """One document text per invoice; some lack the vendor or the amount line.

    ``rows``: the invoices, where they are already written.
    """
    cents = F.round(F.col("amount") * 100).cast("long")
    whole = F.format_number((cents - cents % 100) / 100, 0)
    amount = F.concat(F.lit("Amount Due: $"), whole, F.lit("."),
                      F.lpad((cents % 100).cast("string"), 2, "0"))
    lines = F.array(
        F.lit("INVOICE"),
        F.concat(F.lit("Invoice Number: "), F.col("invoice_id")),
        F.when(F.col("order_key") % 37 != 0, F.concat(F.lit("Vendor: "), F.col("vendor"))),
        F.concat(F.lit("Posting Date: "), F.col("posting_date").cast("string")),
        F.concat(F.lit("Due Date: "), F.col("due_date").cast("string")),
        F.when(F.col("order_key") % 41 != 0, amount),
        F.lit("Thank you for your business."))
    # Whoever searches a text, or filters on what was found there, does not build it anew.
    written = once(invoices(spark, sf_dir) if rows is None else rows, text=F.array_join(lines, "\n"))
    return written.select(F.concat("invoice_id", F.lit(".txt")).alias("source_file"), "text")


def submission_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions as JSON lines, some broken: cut short, not positive, or a field missing."""
    inv = invoices(spark, sf_dir)
    amount = F.when(F.col("order_key") % 59 == 0, -F.col("amount")).otherwise(F.col("amount"))
    vendor = F.when(F.col("order_key") % 61 != 0, F.col("vendor"))
    body = F.to_json(F.struct(
        "invoice_id", vendor.alias("vendor"), amount.alias("amount"),
        F.col("posting_date").cast("string").alias("posting_date"),
        F.col("due_date").cast("string").alias("due_date")))
    cut = F.col("order_key") % 53 == 0
    return (inv.select("invoice_id", cut.alias("cut"), body.alias("body"))
            .select("invoice_id", F.when(F.col("cut"), F.expr("left(body, length(body) - 5)"))
                    .otherwise(F.col("body")).alias("value")))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submission log: every invoice once; every seventh order's again, changed, later.

    One pass over the invoices yields both.
    """
    once_only, twice = (F.array(*[F.lit(n).cast("long") for n in ns]) for ns in ((1,), (1, 2)))
    rows = invoices(spark, sf_dir).select("*", F.explode(
        F.when(F.col("order_key") % 7 == 0, twice).otherwise(once_only)).alias("attempt"))
    return rows.withColumn("amount", F.when(F.col("attempt") == 2, F.col("amount") + 100.0).otherwise(
        F.col("amount")))


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer action log read from the event stream, one invoice per user."""
    ev = table(spark, sf_dir, "events")
    action = (F.when(F.col("event_type") == "click", "approve")
              .when((F.col("event_type") == "purchase") & (F.col("event_id") % 5 == 0), "reject")
              .when(F.col("event_type") == "purchase", "approve")
              .when(F.col("event_type") == "view", "request_info")
              .when(F.col("event_type") == "signup", "escalate")
              .otherwise("shred"))
    actor = F.when(F.col("event_id") % 11 == 0, "").otherwise(
        F.concat(F.lit("rev"), (F.col("event_id") % 3).cast("string")))
    return ev.select(
        F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("invoice_id"),
        F.col("event_id").alias("action_seq"), action.alias("action"), actor.alias("actor"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"),
        F.col("ts").cast("timestamp").alias("ts"))


def review_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queued invoices the reviewer actions refer to, with their first route."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    slot = F.col("user_id") % 4
    route = (F.when(slot == 1, "controller_review").when(slot == 2, "dual_control")
             .otherwise("manager_review"))
    return users.select(F.concat(F.lit("INV-"), F.col("user_id").cast("string")).alias("invoice_id"),
                        route.alias("route"))


def audit_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log payloads, one chain per user."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("chain_id"), F.col("event_id").alias("seq"),
                     F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("payload"))


def workflow_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions and reviewer actions interleaved: a case may be resubmitted at any time."""
    seq = F.col("action_seq")
    submitted = seq % 7 == 3
    route = F.when(seq % 70 == 3, P.LADDER[0]).otherwise(F.element_at(
        F.array(*[F.lit(r) for r in P.LADDER[1:]]), (seq % 3 + 1).cast("int")))
    return review_actions(spark, sf_dir).select(
        "invoice_id", seq.alias("seq"), F.when(submitted, "submit").otherwise("action").alias("kind"),
        F.when(submitted, route).alias("route"), F.when(~submitted, F.col("action")).alias("action"),
        "actor")


def respelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose vendors have names of twelve letters, every third with a slip in the last."""
    key = F.substring(F.split("invoice_id", "-")[2], 1, 6)
    name = F.translate(F.substring(F.md5(key), 1, 12), "0123456789", "ghijklmnop")
    slip = F.concat(F.substring(name, 1, 11), F.lit("z"))
    return invoices(spark, sf_dir).withColumn(
        "vendor", F.when(F.col("order_key") % 3 == 0, slip).otherwise(name))
