"""Hash-chained audit log: canonical text, chain building and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard import policy as P
from tallyguard.operators.ordering import CHUNK, top, with_previous


def canonical_event() -> Column:
    """One event as key-sorted JSON text with explicit nulls."""
    names = ("actor", "detail", "event_type", "from_status", "invoice_id", "to_status")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("ts")
    return F.to_json(F.struct(*names, ts), {"ignoreNullFields": "false"})


def link_hash(prev_hash: Column, payload: Column) -> Column:
    return F.sha2(F.concat(prev_hash, F.lit("|"), payload), 256)


def build_chain(events: DataFrame, key: str, seq: str = "seq", payload: str = "payload",
                heads: DataFrame | None = None) -> DataFrame:
    """Adds prev_hash and entry_hash, one chain per ``key`` in ``seq`` order.

    Every hash needs the one before, so a chain is computed in order; different
    chains run in parallel. Rows arrive sorted and stream through, one running
    hash at a time, so a long chain needs no memory. ``heads`` (key, head) gives
    the last stored hash of chains that are continued.
    """
    if heads is None:
        rows = events
    else:
        rows = events.alias("e").join(
            heads.alias("h"), F.col(f"e.{key}").eqNullSafe(F.col(f"h.{key}")), "left").select(
                "e.*", "h.head")
    if heads is None:
        rows = rows.withColumn("head", F.lit(P.GENESIS_HASH))
    rows = rows.withColumn("head", F.coalesce("head", F.lit(P.GENESIS_HASH)))
    schema = T.StructType(events.schema.fields + [
        T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, running = object(), ""
        for pdf in batches:
            before, after = [], []
            for k, text, head in zip(pdf[key], pdf[payload], pdf["head"]):
                if k != k:      # a null number arrives as NaN
                    k = None
                if k != current:
                    current, running = k, head
                before.append(running)
                running = hashlib.sha256(f"{running}|{text}".encode()).hexdigest()
                after.append(running)
            yield pdf.drop(columns="head").assign(prev_hash=before, entry_hash=after)

    ordered = rows.repartition(key).sortWithinPartitions(key, seq)
    return ordered.mapInPandas(link, schema)


def verify_chain(log: DataFrame, key: str, seq: str = "seq", payload: str = "payload",
                 chunk: int = CHUNK) -> DataFrame:
    """Per chain: event count, ``ok`` and the first bad event with its reason.

    A row is checked against its own stored predecessor hash, so all rows are
    independent; only the stored hash of the row before is needed, also for one
    chain that holds the whole log.
    """
    rows = with_previous(log, key, seq, F.col("entry_hash"), "_stored", chunk)
    expected = F.coalesce("_stored", F.lit(P.GENESIS_HASH))
    reason = (F.when(~F.col("prev_hash").eqNullSafe(expected), "chain break")
              .when(~link_hash(F.col("prev_hash"), F.col(payload)).eqNullSafe(F.col("entry_hash")),
                    "tampered content"))
    checked = rows.withColumn("_reason", reason)
    bad_seq = F.when(F.col("_reason").isNotNull(), F.col(seq))
    return checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"), F.min(bad_seq).alias("first_bad_seq"),
        F.min_by("_reason", bad_seq).alias("reason"),
    ).withColumn("ok", F.col("first_bad_seq").isNull())


def checkpoints(log: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Per chain of a verified log: its last event (``at``), that event's hash and the count.

    Kept apart from the log, they are what a later verification goes on from.
    """
    return log.groupBy(key).agg(
        F.max(seq).alias("at"), F.max_by("entry_hash", seq).alias("head"),
        F.count(F.lit(1)).alias("checked"))


def verify_from(log: DataFrame, known: DataFrame, key: str, seq: str = "seq",
                payload: str = "payload", chunk: int = CHUNK) -> DataFrame:
    """Like :func:`verify_chain`, from ``known`` checkpoints on; new chains from their start.

    Only events behind a checkpoint are hashed. The checkpoint's own event has to be there
    with the hash it had; if it is gone, the log was shortened, also if nothing follows.
    """
    same = F.col(f"e.{key}").eqNullSafe(F.col(f"k.{key}"))
    rows = log.alias("e").join(known.alias("k"), same, "left").where(
        F.col("k.at").isNull() | (F.col(f"e.{seq}") >= F.col("k.at"))).select("e.*", "k.at", "k.head")
    rows = with_previous(rows, key, seq, F.col("entry_hash"), "_stored", chunk)
    boundary = F.col(seq) == F.col("at")
    expected = F.when(F.col("at").isNotNull(), F.coalesce("_stored", F.col("head"))).otherwise(
        F.coalesce("_stored", F.lit(P.GENESIS_HASH)))
    broken = ~F.col("prev_hash").eqNullSafe(expected)
    changed = ~link_hash(F.col("prev_hash"), F.col(payload)).eqNullSafe(F.col("entry_hash"))
    reason = (F.when(boundary, F.when(~F.col("entry_hash").eqNullSafe(F.col("head")), "tampered content"))
              .when(broken, "chain break").when(changed, "tampered content"))
    checked = rows.withColumn("_reason", reason)
    bad_seq = F.when(F.col("_reason").isNotNull(), F.col(seq))
    seen = checked.groupBy(key).agg(
        F.sum(F.when(F.coalesce(boundary, F.lit(False)), 0).otherwise(1)).alias("_new"),
        F.max(F.coalesce(boundary, F.lit(False))).alias("_met"),
        F.min(bad_seq).alias("_bad"), F.min_by("_reason", bad_seq).alias("_why"))
    both = known.alias("k").join(
        seen.alias("s"), F.col(f"k.{key}").eqNullSafe(F.col(f"s.{key}")), "full_outer")
    gone = F.col("k.at").isNotNull() & ~F.coalesce("s._met", F.lit(False))
    out = both.select(
        F.coalesce(f"k.{key}", f"s.{key}").alias(key),
        (F.coalesce("k.checked", F.lit(0)) + F.coalesce("s._new", F.lit(0))).alias("events"),
        F.when(gone, F.col("k.at")).otherwise(F.col("s._bad")).alias("first_bad_seq"),
        F.when(gone, "shortened log").otherwise(F.col("s._why")).alias("reason"))
    return out.withColumn("ok", F.col("first_bad_seq").isNull())


def verdict() -> Column:
    """The reviewer-facing line for one verified chain."""
    at = F.col("first_bad_seq").cast("string")
    said = F.when(F.col("ok"), P.say("verified", F.col("events").cast("string")))
    for reason in ("chain break", "shortened log"):
        said = said.when(F.col("reason") == reason, P.say(reason, at))
    return said.otherwise(P.say("tampered content", at))


def load_events(log: DataFrame, invoice_id: str | None = None,
                event_types: list[str] | None = None, limit: int = P.EVENT_LIMIT) -> DataFrame:
    """Newest events first, optionally of one invoice or of some types."""
    if invoice_id:
        log = log.where(F.col("invoice_id") == invoice_id)
    if event_types:
        log = log.where(F.col("event_type").isin(*event_types))
    return top(log, [F.desc("seq")], limit)


def display(events: DataFrame) -> DataFrame:
    """Transition text, note and short hash for an event list."""
    before, after = F.col("from_status"), F.col("to_status")
    moved = before.isNotNull() & (before != "") & (before != after)
    transition = F.when(after != "", F.when(moved, F.concat(
        P.status_label(before), F.lit(" -> "), P.status_label(after))
    ).otherwise(P.status_label(after)))
    note = F.coalesce(
        F.when(F.get_json_object("detail", "$.note") != "", F.get_json_object("detail", "$.note")),
        F.when(F.get_json_object("detail", "$.reason") != "",
               F.get_json_object("detail", "$.reason")), F.lit("N/A"))
    return events.withColumn("transition", F.coalesce(transition, F.lit("N/A"))).withColumn(
        "note", note).withColumn("short_hash", F.substring("entry_hash", 1, 10))


def event_facets(log: DataFrame) -> DataFrame:
    """Events and distinct invoices per event type."""
    return log.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("invoice_id").alias("invoices"))


#: Buckets of a distinct-count sketch as a power of two, and the relative standard error.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def daily_facets(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Per day and event type: events and a mergeable sketch of their invoices."""
    return log.groupBy(F.to_date(ts).alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.hll_sketch_agg(F.col("invoice_id").cast("string"), F.lit(SKETCH_BITS)).alias("invoices"))


def store_daily_facets(log: DataFrame, path: str, ts: str = "ts") -> None:
    """Writes the days that ``log`` holds whole; a day that is written again is replaced."""
    (daily_facets(log, ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day").parquet(path))


def facets_of_days(days: DataFrame) -> DataFrame:
    """Events and estimated distinct invoices per event type, from stored days only."""
    merged = days.groupBy("event_type").agg(
        F.sum("events").alias("events"), F.hll_union_agg("invoices").alias("_all"))
    return merged.select("event_type", "events", F.hll_sketch_estimate("_all").alias("invoices"))
