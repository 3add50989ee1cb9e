"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = entry.SMOKE_DIR
QUICK = [
    "extract_fields", "intake_validation", "feat_amount_zscore", "features_incremental",
    "pair_similarity", "closest_match", "duplicate_screen", "ensemble_assess", "route_decisions",
    "notifications", "queue_upsert", "intake_events", "queue_view", "review_replay",
    "review_events", "chain_build", "chain_verify", "event_timeline", "run_history", "fp_trend",
    "vendor_risk_summary", "classification_metrics", "stream_queue_state", "stream_chain",
    "vendor_links", "vendor_links_incremental", "chain_verify_resumed", "event_facets_daily",
    "batch_summary", "stratified_split", "workflow_replay",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def rows(pdf):
    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT") or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, str) or type(v).__name__ in ("bool", "bool_"):
            return str(v)
        return repr(round(float(v), 9))

    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queue_view_is_sorted(spark):
    got = entry.queries()["queue_view"](spark, DATA).collect()
    keys = [(-r.route_rank, r.submitted_at, r.invoice_id) for r in got]
    assert keys == sorted(keys)
