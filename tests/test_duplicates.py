import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyguard.functions.text import vendor_key
from tallyguard.operators import duplicates, names
from tallyguard.policy import LEGAL_SUFFIXES

SCHEMA = "invoice_id string, vendor string, amount double, posting_date date"


def key(name):
    words = re.sub("[^a-z0-9]+", " ", (name or "").lower()).split()
    return " ".join(w for w in words if w not in LEGAL_SUFFIXES)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def ratio(a, b):
    return 1.0 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def brute(queries, history, tau, linked=1.0):
    """Every query against every filed row, first id wins ties; names under ``linked`` differ."""
    out, alike = {}, {}
    for i, v, a, d in queries:
        best = (0.0, None)
        if a is not None and key(v):
            for j, w, b, e in history:
                if j == i or b is None or not key(w):
                    continue
                if (v, w) not in alike:
                    alike[v, w] = ratio(key(v), key(w))
                if alike[v, w] < linked:
                    continue
                amt = max(0.0, 1.0 - (abs(a - b) / max(abs(a), abs(b), 1.0)) / 0.10)
                dat = 0.0 if d is None or e is None else max(0.0, 1.0 - abs((d - e).days) / 90.0)
                s = alike[v, w] * (0.75 * amt + 0.25 * dat)
                if s > tau if tau in (0.0, 0.25) else s >= tau:
                    if s > best[0] or (s == best[0] and j < best[1]):
                        best = (s, j)
        out[(i, v, a, d)] = (round(best[0], 9), best[1])
    return out


def found(df):
    return {(r.invoice_id, r.vendor, r.amount, r.posting_date):
            (round(r.match.score, 9), r.match.matched_invoice_id) for r in df.collect()}


def make(rng, n, vendors, base, spread, days, prefix):
    rows = []
    for i in range(n):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(days))
        # Some ids repeat with other contents, some dates and amounts are missing.
        rows.append((f"{prefix}{i if rng.random() > 0.1 else max(0, i - 1):04d}",
                     rng.choice(vendors), None if rng.random() < 0.02
                     else round(base * (1 + rng.random() * spread), 2),
                     None if rng.random() < 0.03 else day))
    return rows


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    filed = (make(rng, 150, ["Acme Ltd", "ACME", "Beta co"], 100, 0.5, 30, "A")
             + make(rng, 60, ["Acme"], 50, 10, 900, "B")
             # a third of the rows are copies of one invoice
             + [(f"C{i:03d}", "Hot Vendor", 10.0, dt.date(2025, 1, 5)) for i in range(100)]
             + [("Z1", None, 5.0, None), ("Z2", "", 5.0, dt.date(2025, 1, 1))])
    new = make(rng, 60, ["Acme", "Beta"], 80, 1.0, 60, "A") + [
        (f"Q{i:03d}", "hot vendor inc", 10.0, dt.date(2025, 1, 6)) for i in range(20)]
    return filed, new


@pytest.mark.parametrize("tau,dense,chunk", [
    (0.0, 4000, 100_000), (0.0, 3, 3), (0.25, 3, 5000), (0.8, 3, 3)])
def test_equals_all_pairs(spark, tables, tau, dense, chunk):
    filed, new = tables
    h = spark.createDataFrame(filed, SCHEMA).repartition(3)
    q = spark.createDataFrame(new, SCHEMA).repartition(2)
    how = {"min_score": tau, "dense_limit": dense, "chunk": chunk}
    assert found(duplicates.closest_matches(h, **how)) == brute(filed, filed, tau)
    assert found(duplicates.closest_matches(q, h, **how)) == brute(new, filed, tau)


SPELLINGS = ["Sunrise Stationery", "Sunrise Stationary", "Kaveri Suppliers Ltd", "Kaveri Supplier",
             "Acme", "Acne", "Acmes", "Bright Logistics", "Brite Logistics Pvt", "Zed", "Zedd", ""]


@pytest.mark.parametrize("tau,dense,chunk", [(0.0, 2, 7), (0.8, 400, 100_000)])
def test_other_spellings(spark, tau, dense, chunk):
    rng = random.Random(9)
    rows = make(rng, 120, SPELLINGS, 100, 0.3, 400, "F")
    df = spark.createDataFrame(rows, SCHEMA)
    links = names.links(names.vendor_names(df), 0.75)
    assert found(duplicates.closest_matches(
        df, min_score=tau, links=links, dense_limit=dense, chunk=chunk)) == brute(rows, rows, tau, 0.75)


def test_acme_and_acne(spark):
    day = dt.date(2025, 3, 1)
    df = spark.createDataFrame([("I1", "Acme", 500.0, day), ("I2", "Acne", 500.0, day)], SCHEMA)
    links = names.links(names.vendor_names(df), 0.75)
    scores = {r.invoice_id: (r.match.score, r.match.matched_invoice_id)
              for r in duplicates.closest_matches(df, links=links).collect()}
    assert scores == {"I1": (0.75, "I2"), "I2": (0.75, "I1")}


@pytest.mark.parametrize("tau,dense", [(0.0, 2), (0.8, 400)])
def test_a_store_answers_like_the_table(spark, tau, dense):
    rng = random.Random(11)
    filed = make(rng, 200, SPELLINGS[:8], 100, 3, 500, "A")
    new = make(rng, 50, SPELLINGS, 100, 3, 500, "A") + [("N1", "Sunrise Stationeri", 120.0, None)] * 2
    h, q = spark.createDataFrame(filed, SCHEMA), spark.createDataFrame(new, SCHEMA)
    store = duplicates.store_invoices(h, 16, min_score=tau, dense_limit=dense, link_ratio=0.75)
    want = brute(new, filed, tau, 0.75)
    assert found(duplicates.closest_matches(q, store, min_score=tau, chunk=9)) == want
    with pytest.raises(ValueError):
        duplicates.closest_matches(q, store, min_score=0.5)


def test_small_groups_of_a_store_are_searched_in_one_pass(spark, monkeypatch):
    rng = random.Random(13)
    filed = make(rng, 300, SPELLINGS[:8], 100, 3, 500, "A")
    new = make(rng, 60, SPELLINGS, 100, 3, 500, "A") + [("N1", None, 120.0, None), ("N2", "", 1.0, None)]
    store = duplicates.store_invoices(spark.createDataFrame(filed, SCHEMA), 4, link_ratio=0.75)
    monkeypatch.setattr(duplicates, "_by_profiles", None)
    for rows in (new, new[:3]):     # few rows meet few parts, of the others days are read
        got = duplicates.closest_matches(spark.createDataFrame(rows, SCHEMA), store)
        assert found(got) == brute(rows, filed, 0.0, 0.75)


def test_a_small_batch_reads_a_small_part(spark):
    rng = random.Random(12)
    vendors = ["".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(60)]
    h = spark.createDataFrame(make(rng, 900, vendors, 100, 3, 500, "A"), SCHEMA)
    store = duplicates.store_invoices(h, 64, link_ratio=0.8)
    few = h.where(F.col("vendor") == vendors[0]).select(vendor_key(F.col("vendor")).alias("vkey"))
    assert store.by_day.near(few).count() < 0.1 * store.by_day.rows().count()
    met = few.select("vkey", F.lit(25).alias("_k"))
    assert store.profiles.near(met).count() < 0.1 * store.profiles.rows().count()


@pytest.mark.parametrize("tau", [0.75, 0.8, 0.9])
def test_links_lose_nothing(spark, tau):
    rng = random.Random(3)
    base = ["northwind freight", "orion it consulting", "abc", "ab", "a", "supplier 001", "aaaaaaaa",
            "sunrise stationery", "aaaa bbbb aaaa"]
    typed = set(base)
    for b in base:
        for _ in range(10):
            s = list(b)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(s) + 1)
                s[at:at + rng.randrange(2)] = rng.choice(["", "x", "a", "0 "])
            typed.add("".join(s))
    keys = sorted({key(n) for n in typed} - {""})
    df = spark.createDataFrame([(k,) for k in keys], "a string")
    want = {(a, b): ratio(a, b) for a in keys for b in keys if ratio(a, b) >= tau}
    assert {(r.a, r.b): r.v for r in names.links(df, tau).collect()} == pytest.approx(want)
    # Half of the names are on file; all of them ask, the others over the index.
    on_file = keys[::2]
    store = names.NameStore.file(spark.createDataFrame([(k,) for k in on_file], "a string"), tau, 4)
    got = {(r.a, r.b): r.v for r in store.of(df).collect()}
    assert got == pytest.approx({p: v for p, v in want.items() if p[1] in on_file or p[0] == p[1]})
    with pytest.raises(ValueError):
        names.links(df, 0.6)


def test_unlike_names_rarely_meet(spark):
    rng = random.Random(4)
    drawn = {"".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(3000)}
    df = spark.createDataFrame([(k,) for k in sorted(drawn)], "a string")
    on_file = names._segments(df, 0.8).withColumnRenamed("a", "b")
    met = names._probes(df, 0.8).join(on_file, "g").where("a <> b")
    # Two-letter pieces brought each name together with a fixed share of all others.
    assert met.count() < 3 * len(drawn)


def test_vendor_key(spark):
    rows = [("Kaveri Suppliers", "Kaveri Suppliers Ltd."), ("bright logistics", "Bright  Logistics!"),
            ("Bright Logistics Pvt Ltd", "Bright Logistics"), (None, "Inc."), ("", "  ")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select(vendor_key(F.col("a")).alias("a"), vendor_key(F.col("b")).alias("b")).collect():
        assert r.a == r.b


def test_pair_scores_and_description(spark):
    d = dt.date
    rows = [("Acme Ltd", 500.0, d(2025, 3, 1), "Acme Ltd", 500.0, d(2025, 3, 1)),
            ("Acme Ltd", 500.0, d(2025, 3, 1), "Zenith Traders", 500.0, d(2025, 3, 1)),
            ("Acme Ltd", 500.0, d(2025, 3, 1), "Acme Ltd", 500.0, d(2025, 4, 15)),
            (None, 500.0, d(2025, 3, 1), "Acme", 500.0, d(2025, 3, 1)),
            ("Acme", None, d(2025, 3, 1), "Acme", 500.0, None)]
    df = spark.createDataFrame(rows, "vendor_a string, amount_a double, date_a date, "
                                     "vendor_b string, amount_b double, date_b date")
    got = {(r.vendor_a, r.vendor_b, r.date_b): r.score for r in duplicates.pair_scores(df).collect()}
    assert got[("Acme Ltd", "Acme Ltd", d(2025, 3, 1))] == 1.0
    assert got[("Acme Ltd", "Zenith Traders", d(2025, 3, 1))] < 0.40
    assert got[("Acme Ltd", "Acme Ltd", d(2025, 4, 15))] == pytest.approx(0.875)
    assert got[(None, "Acme", d(2025, 3, 1))] == 0.0
    assert got[("Acme", "Acme", None)] == 0.0

    filed = spark.createDataFrame([("I1", "Acme", 500.0, d(2025, 3, 1)),
                                   ("I2", "Acme", 502.0, d(2025, 3, 4)),
                                   ("I3", "Other", 9.0, d(2025, 3, 4))], SCHEMA)
    m = duplicates.closest_matches(filed)
    lines = {r.invoice_id: r.t for r in m.select(
        "invoice_id", duplicates.describe(F.col("match")).alias("t")).collect()}
    assert lines["I1"] == "I2 at 96% similarity (vendor 100%, amount 96%, 3d apart)"
    assert lines["I3"] == "No comparable invoice on file."


@pytest.mark.parametrize("tau", [0.0, 0.25, 0.8])
def test_names_that_meet_few_are_searched_whole(spark, tau):
    rng = random.Random(21)
    letters = "abcdefghij"
    bases = ["".join(rng.choice(letters) for _ in range(12)) for _ in range(6)]
    vendors = bases + [b[:11] + "z" for b in bases] + [b[:4] + b[5:] for b in bases]
    rows = make(rng, 260, vendors, 100, 2, 700, "A") + make(rng, 60, vendors, -90, 1, 90, "B") + [
        # alone by amount: only a date is shared; one of them has its only near day under its own id
        ("D1", bases[0], 1e6, dt.date(2025, 1, 9)), ("D1", bases[0], 1e7, dt.date(2025, 1, 9)),
        ("D2", bases[0], 0.0, dt.date(2027, 9, 9)), ("D3", bases[0], 0.04, dt.date(2031, 9, 9))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    links = names.links(names.vendor_names(df), 0.8)
    result = duplicates.closest_matches(df, min_score=tau, links=links)
    # No row is copied to the blocks around it: each goes once to the names it may meet.
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "_h#" not in plan
    assert found(result) == brute(rows, rows, tau, 0.8)
    new = make(rng, 50, vendors, 100, 2, 700, "A")
    q = spark.createDataFrame(new, SCHEMA)
    assert found(duplicates.closest_matches(q, df, min_score=tau, links=links)) == brute(
        new, rows, tau, 0.8)


def test_batches_may_end_inside_a_name(spark):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from tallyguard.operators import whole

    asked, out = (to_arrow_schema(StructType.fromDDL(s)) for s in (whole.ASKED, whole.FOUND))
    day = dt.date(2025, 1, 1)
    rows = [r for name in ("a", "b", "c") for r in (
        [(name, 0, 0, f"{name}{i:05d}", name, 10.0 + i, day, 1.0) for i in range(900)]
        + [(name, 0, 1, f"{name}{i % 900:05d}", None, 10.0 + i % 900, day, None) for i in range(60_000)])]
    table = pa.table([list(c) for c in zip(*rows)], schema=asked)
    got = pa.Table.from_batches(list(whole.best_of_points(0.0, out)(
        iter(table.to_batches(max_chunksize=7_000)))), schema=out).to_pylist()
    assert len(got) == 180_000
    for r in got:       # the neighbour above is nearer by share, but for the last one
        i = int(r["_excl"][1:])
        assert r["id"] == f"{r['_vkey']}{i + 1 if i < 899 else 898:05d}"


@pytest.mark.parametrize("tau", [0.0, 0.8])
def test_rows_of_a_group_travel_once(spark, tau):
    rng = random.Random(31)
    # A chain whose ends are not linked, a pair, copies, rows without a usable name or amount.
    chain = ["aaaaaaaaaa", "aaaaaaaabb", "aaaaaabbbb", "aaaabbbbbb", "aabbbbbbbb", "bbbbbbbbbb"]
    pair = ["Mainline Paper", "Mainline Papers Ltd", "mainline paper"]
    rows = make(rng, 200, chain + pair, 100, 1, 300, "A") + [
        (f"C{i:02d}", "Mainline Paper", 70.0, dt.date(2025, 2, 2)) for i in range(30)] + [
        ("N1", None, 70.0, dt.date(2025, 2, 2)), ("N2", "Inc.", 70.0, dt.date(2025, 2, 2)),
        ("N3", "Mainline Paper", float("nan"), dt.date(2025, 2, 2)),
        ("C01", "Mainline Paper", 70.0, dt.date(2025, 2, 3))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("more", F.array(F.col("invoice_id"))).repartition(3)
    links = names.links(names.vendor_names(df), 0.8)
    every = duplicates.closest_matches(df, min_score=tau, links=links)
    want = brute([r for r in rows if r[0] != "N3"], [r for r in rows if r[0] != "N3"], tau, 0.8)
    got = {k: v for k, v in found(every).items() if k[0] != "N3"}
    assert got == want and every.count() == len(rows)
    assert every.where("match.matched_invoice_id IS NULL AND invoice_id IN ('N1', 'N2', 'N3')").count() == 3
    assert every.where("more[0] <> invoice_id").isEmpty()
    # Only names of closed groups: one exchange of the rows, no join with profiles.
    some = df.where(~F.col("vendor").rlike("^[ab]+$"))
    plan = duplicates.closest_matches(some, min_score=tau, links=links)._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert text.count("MapInArrow") == 1 and text.count("Exchange hashpartitioning(_group") == 1
    assert "SortMergeJoin" not in text
