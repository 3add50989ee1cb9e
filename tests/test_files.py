"""File scans and sinks."""

import datetime as dt
import os

import pytest
from pyspark.sql import types as T

from tallyguard import session
from tallyguard.operators import chain, extract, queue
from tallyguard.schemas import INVOICE
from tallyguard.sources import files
from tallyguard.sources.files import VersionedTable

DAY = dt.date(2025, 1, 2)


def test_csv_round_trip_and_missing_values(spark, tmp_path):
    rows = [("I1", "Acme, Ltd", DAY, DAY, 10.5), ("I2", None, None, DAY, None), ("I3", 'a "b"', DAY, None, 0.0)]
    path = str(tmp_path / "invoices")
    files.write_csv(spark.createDataFrame(rows, INVOICE), path)
    assert sorted(map(tuple, files.read_csv(spark, path).collect())) == sorted(rows)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.write_csv(spark.createDataFrame(rows, INVOICE), path)
    (tmp_path / "nan.csv").write_text("invoice_id,vendor,posting_date,due_date,amount\nI4,V,2025-01-02,,NaN\n")
    (row,) = files.read_csv(spark, str(tmp_path / "nan.csv")).collect()
    assert (row.amount, row.posting_date, row.due_date) == (None, DAY, None)


def test_labels(spark, tmp_path):
    names = [f.name for f in files.LABEL.fields]
    (tmp_path / "labels.csv").write_text(",".join(names) + "\n" + ",".join("" for _ in names) + "\n")
    (row,) = files.read_labels(spark, str(tmp_path / "labels.csv")).collect()
    assert list(row.asDict()) == names and set(row) == {None}


def test_documents(spark, tmp_path):
    text = "Invoice Number: INV-1\nVendor: Acme\nPosting Date: 2025-01-02\nDue Date: 2025-02-01\nAmount Due: $5.00\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.pdf").write_text(text)
    docs = files.read_documents(spark, str(tmp_path))
    assert {r.source_file for r in docs.collect()} >= {"a.txt"}
    got = {r.source_file: r for r in extract.extract_fields(docs).collect()}
    assert got["a.txt"].amount == 5.0 and got["a.txt"].extraction_ok and "c.pdf" not in got


def test_append_log_keeps_chain(spark, tmp_path):
    path = str(tmp_path / "log")
    first = spark.createDataFrame([(1, s, f"p{s}") for s in (1, 2)], "chain_id long, seq long, payload string")
    files.append(chain.build_chain(first, "chain_id"), path)
    log = files.read_log(spark, path)
    heads = log.groupBy("chain_id").agg({"seq": "max"}).join(log, "chain_id").where(
        "seq = `max(seq)`").selectExpr("chain_id", "entry_hash AS head")
    more = spark.createDataFrame([(1, 3, "p3")], first.schema)
    files.append(chain.build_chain(more, "chain_id", heads=heads).selectExpr("*", "'x' AS added"), path)
    log = files.read_log(spark, path)
    assert [r.added for r in log.orderBy("seq").collect()] == [None, None, "x"]
    assert chain.verify_chain(log, "chain_id").first().ok
    assert files.read_log(spark, path, first.schema).columns == ["chain_id", "seq", "payload"]


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "queue")
    rows = lambda *x: spark.createDataFrame(x, "invoice_id string, status string")
    files.upsert(rows(*[(f"I{i}", "pending_review") for i in range(60)], (None, "lost")), path, buckets=16)
    before = {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path) if d.startswith("_bucket")}
    files.upsert(rows(("I1", "approved"), ("new", "pending_review")), path, buckets=16)
    after = {d: os.stat(f"{path}/{d}").st_mtime_ns for d in os.listdir(path) if d.startswith("_bucket")}
    assert sum(before.get(d) != t for d, t in after.items()) <= 2
    got = {r.invoice_id: r.status for r in spark.read.parquet(path).collect()}
    assert len(got) == 62 and got["I1"] == "approved" and got["I2"] == "pending_review"
    files.upsert(rows((None, "found")), path, buckets=16)
    got = [r.status for r in spark.read.parquet(path).where("invoice_id IS NULL").collect()]
    assert got == ["found"]


def test_versioned_table_applies_each_batch_once(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    table = VersionedTable(spark, str(tmp_path / "t"), schema, "k", 4)

    def merge(rows):
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    def state():
        return {r.k: r.n for r in table.rows().collect()}

    def batch(*rows):
        return spark.createDataFrame(rows, schema)

    assert state() == {} and table.finished() == -1
    table.update(batch(("a", 1), ("b", 2), ("a", 3)), 0, merge)
    assert state() == {"a": 4, "b": 2}
    table.update(batch(("a", 5), ("c", 1), (None, 7)), 1, merge)
    want = {"a": 9, "b": 2, "c": 1, None: 7}
    assert state() == want
    table.update(batch(("a", 5), ("c", 1), (None, 7)), 1, merge)    # a finished batch again
    assert state() == want
    # A batch that broke off after its buckets were written but before it was recorded.
    fs, path = table._fs()
    fs.delete(path(f"{table.path}/finished/1"), False)
    assert state() == {"a": 4, "b": 2}
    table.update(batch(("a", 5), ("c", 1), (None, 7)), 1, merge)
    assert state() == want
    before = sum(map(len, table.versions().values()))
    assert table.compact() == before - len(table.versions()) > 0
    assert state() == want and table.compact() == 0
    table.update(batch(), 2, merge)
    assert state() == want and table.finished() == 2


def test_tasks_follow_the_size_of_the_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.parquet")
    spark.range(20_000).write.parquet(path)
    size = sum(n for _, n, _ in session.file_states(spark, path))
    assert session.tasks_for(spark, path) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "TASK_BYTES", size // 50)
    assert 50 <= session.tasks_for(spark, path) <= 51


def test_a_lone_submission_is_kept_once_and_nothing_is_written_aside(spark, tmp_path):
    schema = "invoice_id string, source_file string, route string, seq long, ts timestamp, actor string"
    t = dt.datetime(2025, 1, 1)
    first = [(f"I{i}", "f", "manager_review", 1, t, "a") for i in range(40)]
    again = [(f"I{i}", "g", "dual_control", 2, t, "b") for i in range(0, 40, 4)] + [("N", "f", "auto_approve", 1, t, "a")]
    empty = queue.merge_folds(queue.submission_folds(spark.createDataFrame([], schema)))
    table = VersionedTable(spark, str(tmp_path / "queue"), empty.schema, "_key", 8)
    shared = os.path.join(session.shared_dir(spark), "tallyguard")
    os.makedirs(shared, exist_ok=True)
    aside = set(os.listdir(shared))
    for n, rows in enumerate((first, again)):
        table.update(queue.submission_folds(spark.createDataFrame(rows, schema)), n, queue.merge_folds)
    assert set(os.listdir(shared)) == aside
    folds = table.rows()
    assert folds.count() == 41
    assert {r["_key"] for r in folds.where("_last IS NOT NULL").collect()} == {f"I{i}" for i in range(0, 40, 4)}
    got = {r.invoice_id: (r.route, r.source_file, r.resubmissions) for r in queue.folded_queue(folds).collect()}
    want = queue.fold_submissions(spark.createDataFrame(first + again, schema)).collect()
    assert got == {r.invoice_id: (r.route, r.source_file, r.resubmissions) for r in want}
    assert got["I4"] == ("dual_control", "g", 1) and got["I5"] == ("manager_review", "f", 0)
