import pytest
from pyspark.sql import functions as F

from tallyguard import policy as P
from tallyguard.operators import confidence, notify, rules

CLEAN = dict(zscore=0.10, dup=0.0, match=None, weekend=0.0, terms=0.5, ok=True,
             p={"LogReg": 0.05, "RBF-SVM": 0.10, "Quantum": 0.08})
SCHEMA = ("id int, amount double, amount_zscore_norm double, duplicate_score double, "
          "duplicate_match_id string, weekend_flag double, days_to_due_norm double, "
          "extraction_ok boolean, p map<string,double>")


def route(spark, cases):
    rows = []
    for i, (amount, change) in enumerate(cases):
        c = {**CLEAN, **change}
        rows.append((i, amount, c["zscore"], c["dup"], c["match"], c["weekend"], c["terms"],
                     c["ok"], c["p"]))
    df = confidence.with_assessment(spark.createDataFrame(rows, SCHEMA), F.col("p"))
    return rules.evaluate(df)


def scores(a, b, c):
    return {"p": {"LogReg": a, "RBF-SVM": b, "Quantum": c}}


AUTO, MGR, CTRL, DUAL = P.LADDER
CASES = [
    (800.0, {}, AUTO, ""), (999.99, {"weekend": 1.0}, AUTO, ""),
    (1000.0, {"weekend": 1.0}, MGR, "R-06"), (None, {"weekend": 1.0}, MGR, "R-06"),
    (2499.99, {}, AUTO, ""), (2500.0, {}, MGR, "R-01"), (9499.99, {}, MGR, "R-01"),
    (9500.0, {}, CTRL, "R-02,R-01"), (9999.99, {}, CTRL, "R-02,R-01"), (10000.0, {}, CTRL, "R-01"),
    (49999.99, {}, CTRL, "R-01"), (50000.0, {}, DUAL, "R-01"),
    (500.0, {"dup": 0.7999}, AUTO, ""), (500.0, {"dup": 0.80, "match": "X"}, MGR, "R-03"),
    (500.0, {"dup": 0.9499}, MGR, "R-03"), (500.0, {"dup": 0.95}, CTRL, "R-03"),
    (15000.0, {"dup": 1.0}, DUAL, "R-03,R-01"), (15000.0, {"dup": 0.88}, CTRL, "R-01,R-03"),
    (500.0, {"zscore": 0.70}, MGR, "R-05"), (500.0, {"zscore": 0.6999}, AUTO, ""),
    (500.0, {"terms": 0.05}, MGR, "R-07"), (500.0, {"terms": 0.0501}, AUTO, ""),
    (500.0, scores(0.55, 0.60, 0.58), MGR, "R-04"), (500.0, scores(0.90, 0.85, 0.88), CTRL, "R-04"),
    (500.0, scores(0.30, 0.35, 0.32), AUTO, ""), (500.0, scores(0.85, 0.10, 0.15), MGR, "R-09"),
    (500.0, scores(0.40, 0.02, 0.05), AUTO, ""),
    (None, {"ok": False, "p": {}, "zscore": None, "dup": None, "weekend": None, "terms": None},
     MGR, "R-08"),
    (75000.0, {"weekend": 1.0}, DUAL, "R-01,R-06"),
]


def test_routes_at_every_boundary(spark):
    out = route(spark, [(a, c) for a, c, _, _ in CASES])
    got = {r.id: (r.route, ",".join(h.code for h in r.rules)) for r in out.collect()}
    for i, (amount, change, want, codes) in enumerate(CASES):
        assert got[i] == (want, codes), (amount, change)


def test_details_and_alerts(spark):
    out = route(spark, [
        (9800.0, {}), (500.0, {"dup": 1.0, "match": "INV-0019"}), (500.0, scores(0.85, 0.10, 0.15)),
        (500.0, scores(0.55, 0.60, 0.58)), (75000.0, {}), (800.0, {})])
    rows = {r.id: r for r in out.collect()}
    assert rows[0].rules[0].detail == (
        "$9,800.00 stays $200.00 under $10,000, where reporting starts; "
        "the amount may have been chosen for that.")
    assert "100% alike to INV-0019" in rows[1].rules[0].detail
    assert rows[2].rules[0].detail.startswith(
        "Model scores lie 75% apart (LogReg 85%, Quantum 15%, RBF-SVM 10%)")
    assert rows[3].rules[0].detail == (
        "Mean model risk 58%, band Elevated "
        "(Elevated (58% mean): LogReg 55%, Quantum 58%, RBF-SVM 60%).")
    queue = out.withColumn("invoice_id", F.when(F.col("id") > 0, F.lit("INV-1"))).withColumn(
        "vendor", F.lit(None).cast("string")).withColumn(
        "submitted_at", F.when(F.col("id") == 4, F.lit("2026-03-01 09:00:00").cast("timestamp")))
    alerts = notify.build_notifications(queue).collect()
    assert alerts[0].invoice_id == "unassigned invoice"
    assert "an unidentified vendor" in alerts[0].summary_line
    assert alerts[0].sla_line == "Respond within 24 hours of assignment."
    dual = alerts[4]
    assert dual.priority == "Urgent" and len(dual.recipients) == 2
    assert dual.sla_line.startswith("Respond by 2026-03-01 17:00 UTC (8h SLA).")
    assert "two different approvers" in dual.sla_line
    assert not alerts[5].is_actionable and alerts[5].recipients == [] and alerts[5].reasons == []
    assert alerts[5].subject == "No notification: INV-1 cleared automatically"


def test_assessment(spark):
    rows = [(0, {"a": 0.80, "b": 0.90, "c": 0.85}), (1, {"a": 0.95, "b": 0.10, "c": 0.20}),
            (2, {"a": 0.20, "b": 0.30, "c": 0.24}), (3, {"m": 1.7}), (4, {"m": -0.3}),
            (5, {"m": 0.4999}), (6, {"m": 0.50}), (7, {}), (8, None)]
    df = spark.createDataFrame(rows, "id int, p map<string,double>")
    got = {r.id: r for r in confidence.with_assessment(df, F.col("p")).collect()}
    assert got[0].confidence_mean == pytest.approx(0.85) and got[0].agreement == "unanimous"
    assert got[1].is_split and got[1].confidence_band == "low" and got[1].agreement == "split"
    assert got[1].confidence_bands["a"] == "high" and got[1].confidence_bands["b"] == "cleared"
    assert got[2].agreement == "aligned"
    assert [got[i].confidence_band for i in (3, 4, 5, 6)] == ["high", "cleared", "low", "elevated"]
    assert got[7].confidence_band is None and got[8].probabilities is None


def test_escalation(spark):
    df = spark.createDataFrame([(r,) for r in P.LADDER], "route string")
    got = {r.route: r.up for r in df.select("route", P.escalate(F.col("route")).alias("up")).collect()}
    assert got == {AUTO: MGR, MGR: CTRL, CTRL: DUAL, DUAL: DUAL}
