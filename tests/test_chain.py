import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyguard.operators import chain
from tallyguard.policy import GENESIS_HASH
from tallyguard.session import materialize


@pytest.fixture(scope="module")
def log(spark):
    rows = [(k, s, f"event {s} of {k}") for s in range(1, 61) for k in (1, 1 + s % 3) if k == 1 or s % 3]
    df = spark.createDataFrame(sorted(set(rows)), "chain_id long, seq long, payload string")
    built = chain.build_chain(df.repartition(5), "chain_id").collect()
    return spark.createDataFrame(built)


def test_hashes_follow_the_definition(log):
    chains = {}
    for r in sorted(log.collect(), key=lambda r: (r.chain_id, r.seq)):
        prev = chains.get(r.chain_id, GENESIS_HASH)
        assert r.prev_hash == prev
        assert r.entry_hash == hashlib.sha256(f"{prev}|{r.payload}".encode()).hexdigest()
        chains[r.chain_id] = r.entry_hash


@pytest.mark.parametrize("chunk", [100_000, 7])
def test_verify(log, chunk):
    ok = chain.verify_chain(log, "chain_id", chunk=chunk).collect()
    assert all(r.ok for r in ok)
    one = F.col("chain_id") == 1
    edited = log.withColumn("payload", F.when(one & (F.col("seq") == 9), "x").otherwise(F.col("payload")))
    bad = chain.verify_chain(edited, "chain_id", chunk=chunk).withColumn("m", chain.verdict())
    bad = {r.chain_id: r for r in bad.collect()}
    assert not bad[1].ok and bad[1].m == "Tampered content at event #9: recomputed hash does not match."
    assert bad[2].ok
    removed = chain.verify_chain(log.where(~(one & (F.col("seq") == 9))), "chain_id", chunk=chunk)
    removed = removed.withColumn("m", chain.verdict()).where(one).first()
    assert removed.m == "Chain break at event #10: predecessor hash does not match."


def test_continued_chain_equals_one_build(spark, log):
    plain = log.select("chain_id", "seq", "payload")
    first = chain.build_chain(plain.where("seq <= 30"), "chain_id")
    heads = first.groupBy("chain_id").agg(F.max_by("entry_hash", "seq").alias("head"))
    second = chain.build_chain(plain.where("seq > 30"), "chain_id", heads=heads)
    both = {(r.chain_id, r.seq): r.entry_hash for r in first.unionByName(second).collect()}
    assert both == {(r.chain_id, r.seq): r.entry_hash for r in log.collect()}


def test_event_list(spark):
    rows = [(1, "I1", "a", None, "pending_review", '{"note":"hi"}', "h" * 64),
            (2, "I1", "b", "pending_review", "approved", '{"note":"","reason":"why"}', "i" * 64),
            (3, "I2", "b", "approved", "approved", "{}", "j" * 64)]
    df = spark.createDataFrame(rows, "seq long, invoice_id string, event_type string, "
                                     "from_status string, to_status string, detail string, entry_hash string")
    out = chain.display(chain.load_events(df, limit=2)).orderBy("position").collect()
    assert [r.seq for r in out] == [3, 2]
    assert [r.transition for r in out] == ["Approved", "Pending review -> Approved"]
    assert [r.note for r in out] == ["N/A", "why"]
    assert [r.seq for r in chain.load_events(df, invoice_id="I1").collect()] == [2, 1]


def test_events_without_a_key_form_one_chain(spark):
    rows = [(None, s, f"p{s}") for s in range(1, 6)] + [(1, s, f"q{s}") for s in range(1, 4)]
    df = spark.createDataFrame(rows, "chain_id long, seq long, payload string")
    built = spark.createDataFrame(chain.build_chain(df, "chain_id").collect())
    got = {r.chain_id: (r.events, r.ok) for r in chain.verify_chain(built, "chain_id", chunk=2).collect()}
    assert got == {None: (5, True), 1: (3, True)}
    heads = built.groupBy("chain_id").agg(F.max_by("entry_hash", "seq").alias("head"))
    more = spark.createDataFrame([(None, 6, "p6")], df.schema)
    after = chain.build_chain(more, "chain_id", heads=heads).first()
    last = built.where("chain_id IS NULL AND seq = 5").first().entry_hash
    assert after.prev_hash == last
    longer = built.unionByName(spark.createDataFrame([after], built.schema))
    assert all(r.ok for r in chain.verify_chain(longer, "chain_id", chunk=3).collect())


def test_resumed_verification_agrees_with_a_full_one(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, 4, None]), i, f"e{i}") for i in range(120)]
    log = materialize(chain.build_chain(spark.createDataFrame(
        rows, "k long, seq long, payload string"), "k"), "log")
    known = materialize(chain.checkpoints(log.where("seq < 60 AND (k IS NULL OR k <> 4)"), "k"), "known")

    def verdicts(df):
        return sorted((str(r.k), r.events, r.ok, r.first_bad_seq, r.reason) for r in df.collect())

    late = F.col("seq").isin(75, 101)
    damaged = [log, log.where("seq <> 90"),
               log.withColumn("payload", F.when(late, "x").otherwise(F.col("payload")))]
    for now in damaged:
        for chunk in (100_000, 5):
            assert verdicts(chain.verify_from(now, known, "k", chunk=chunk)) == verdicts(
                chain.verify_chain(now, "k", chunk=chunk))
    # Only the events behind a checkpoint are looked at, and a cut tail is found.
    early = log.withColumn("payload", F.when(F.col("seq") < 20, "x").otherwise(F.col("payload")))
    assert {r.k: r.ok for r in chain.verify_from(early, known, "k").collect()} == {
        1: True, 2: True, 3: True, 4: False, None: True}
    cut = chain.verify_from(log.where("k = 1 AND seq < 30 OR k = 2 OR k = 4 AND seq < 50"), known, "k")
    said = {r.k: (r.ok, r.reason) for r in cut.collect()}
    assert said == {1: (False, "shortened log"), 2: (True, None), 3: (False, "shortened log"),
                    4: (True, None), None: (False, "shortened log")}


def test_daily_sketches_merge_and_replace(spark, tmp_path):
    day = dt.datetime(2025, 1, 1)
    rows = [("view" if i % 3 else "click", i % 700, day + dt.timedelta(hours=i % 96)) for i in range(6000)]
    log = spark.createDataFrame(rows, "event_type string, invoice_id long, ts timestamp")
    path = str(tmp_path / "facets")
    chain.store_daily_facets(log, path)
    chain.store_daily_facets(log.where("ts < '2025-01-02'"), path)      # a day again
    stored = spark.read.parquet(path)
    assert stored.count() == 8
    exact = {r.event_type: (r.events, r.invoices) for r in chain.event_facets(log).collect()}
    for r in chain.facets_of_days(stored).collect():
        events, invoices = exact[r.event_type]
        assert r.events == events and abs(r.invoices - invoices) <= 3 * chain.SKETCH_ERROR * invoices
