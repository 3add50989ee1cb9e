"""Views over the test tables: rows as before, built once."""

import datetime as dt

from tallyguard.operators.extract import extract_fields
from tallyguard.sources import testdata as td

SCHEMA = ("invoice_id string, vendor string, amount double, posting_date date, due_date date, "
          "order_key long, order_status string")


def invoices(spark):
    day = dt.date(2000, 2, 1)
    return spark.createDataFrame([
        (f"INV-{k:08d}-000001", f"vendor {k}", 1234.5 + k, day, day + dt.timedelta(days=15), k, "F")
        for k in (1, 37, 41, 97, 194)], SCHEMA)


def test_a_text_is_built_once(spark):
    unread = extract_fields(td.invoice_text(spark, "", invoices(spark))).where("NOT extraction_ok")
    assert sorted((r.invoice_id, r.vendor, r.amount) for r in unread.collect()) == [
        ("INV-00000037-000001", None, 1271.5), ("INV-00000041-000001", "vendor 41", None)]
    plan = unread._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_number(") == 1


def test_pairs_come_from_one_pass(spark, monkeypatch):
    monkeypatch.setattr(td, "invoices", lambda *_: invoices(spark))
    pairs = td.labelled_pairs(spark, "")
    got = {r.invoice_id: r for r in pairs.collect()}
    assert len(got) == pairs.count() == 7
    copy = got["INV-00000097-000001-D"]
    assert (copy.vendor, copy.posting_date, copy.is_duplicate_of, copy.amount) == (
        "vendor 97 Ltd.", dt.date(2000, 2, 4), "INV-00000097-000001", 1331.5)
    own = got["INV-00000097-000001"]
    assert (own.vendor, own.posting_date, own.is_duplicate_of) == ("vendor 97", dt.date(2000, 2, 1), None)
    assert pairs.columns == [*SCHEMA.replace(",", "").split()[::2], "is_duplicate_of"]
    assert "Union" not in pairs._jdf.queryExecution().optimizedPlan().toString()
