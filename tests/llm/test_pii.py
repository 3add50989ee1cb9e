"""Base spans against plain expressions; disclosed terms on a small corpus."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyguard.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "phone":
        return 8 <= len(d) <= 15
    if kind == "card":
        n = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in n) % 10 == 0
    return True


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok(k, m.group())]
            for k, p in PLAIN.items()}


PIECES = ["a.b@c.de", "x@y", "a@b.com_x@c.org", "_", "%", "@", ".", "-", "+", " ", "(", ")", "\n",
          "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "12", "255.0.0.1",
          "1.2.3.4.5.6.7.8", "300.1.1.1", "0000000255.1.1.1", "+1 (555) 010-9999", "+49", "é😀",
          "word", "７", "10.0.0.", "5"]


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(500)]
    return [None, "", *out, out[0], "9" * 60_000, "a" * 60_000 + "@", "1 " * 30_000,
            "ü me@x.org and " * 3_000]


def test_base_spans(spark):
    rows = [(i if i % 7 else None, t, "e") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, email string").repartition(8)
    got = pii.base_spans(docs).select("row.text", *PLAIN).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: [(m.s, m.e) for m in r[k]] for k in PLAIN} == brute(r.text), r.text


def corpus():
    rows = [(i, f"plain filler text number {i} about nothing much") for i in range(60)]
    for i in range(4):    # four different contexts name the same person
        rows.append((100 + i, f"{'abcd'[i] * 5} zanzibar wrote from boss@x.org {'efgh'[i] * 6} {i}"))
    rows += [(200 + i, "quartz speaks to copy@x.org here") for i in range(5)]   # copies: one context
    return rows


def test_terms(spark):
    docs = spark.createDataFrame(
        [(i, t, 1) for i, t in corpus()], "doc_id long, text string, terms int")
    rows = {r.row.doc_id: r for r in pii.scan(docs).collect()}
    assert len(rows) == len(corpus())
    for i in range(4):
        r = rows[100 + i]
        assert {m.v for m in r.terms} == {"zanzibar", "wrote", "from"}
        assert all(r.row.text[m.s:m.e] == m.v for m in r.terms)
    assert all(not r.terms for i, r in rows.items() if not 100 <= i < 104)
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert clean[0].text == corpus()[0][1]
    assert "zanzibar" not in clean[101].text and "[email]" in clean[101].text
    assert list(clean[0].asDict()) == docs.columns
    assert pii.report(docs.limit(0)).collect() == []


def fillers(n):
    return [(i, f"plain filler text number{i} about nothing") for i in range(n)]


def test_terms_anywhere_in_few_texts(spark):
    """A short name in the heading of three texts, far from the value that it gives away."""
    rest = "about nothing plain text " * 12
    rows = fillers(400) + [(500 + i, f"Ann Li\n{'xyz'[i] * 4} {rest} text a@b.org about") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.row.doc_id: {m.v for m in r.terms} for r in pii.scan(docs).collect() if r.terms}
    assert got == {i: {"Ann", "Li"} for i in (500, 501, 502)}


def test_the_size_of_the_corpus_decides_nothing(spark):
    some = [(5000 + i, f"Ann Li and ÉMILE's {'xyz'[i] * 4} text a@b.org nothing") for i in range(3)]
    some += [(6000, "write to ann@x.org about zebra quagga okapi"), (6001, "zebra quagga b@x.org"),
             (6002, "okapi zebra b@x.org")]
    for n in (300, 3000):
        docs = spark.createDataFrame(fillers(n) + some, "doc_id long, text string")
        got = {r.row.doc_id: {m.v for m in r.terms} for r in pii.scan(docs).collect() if r.terms}
        assert got == {i: {"Ann", "Li", "and", "ÉMILE", "s"} for i in (5000, 5001, 5002)}


def test_disclosure_equals_plain_counting(spark):
    rng = random.Random(6)
    words = ["Ada", "ÉVA", "Bo", "cy", "Dee", "ada", "the", "of", "mail"]
    held = ["a@x.org", "B@x.org", "+1 555 010 9999", "10.0.0.1"]
    rows = []
    for i in range(150):
        who = rng.randrange(4)
        said = [words[who]] * (rng.random() < 0.8) + rng.sample(words[4:], 2)
        rows.append((i, " ".join([*said, str(i % 120), *([held[who]] if rng.random() < 0.95 else [])])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = {t for _, t in rows}
    terms = {t: set(re.findall(r"[^\W\d_]+", re.sub(PLAIN["email"], " ", t).lower())) for t in distinct}
    values = {t: {f"{k}:{t[s:e].lower()}" for k, spans in brute(t).items() for s, e in spans}
              for t in distinct}
    want = {}
    for v in set().union(*values.values()):
        for w in set().union(*terms.values()):
            both = sum(v in values[t] and w in terms[t] for t in distinct)
            df, n = (sum(x in of[t] for t in distinct) for x, of in ((w, terms), (v, values)))
            if both / (df + 1) >= pii.GENERALISE:
                want[v, w] = (both / (df + 1), math.log2(both * len(distinct) / (n * df)))
    base = pii.base_spans(docs).where("size(held) > 0").select(
        "held", pii.terms_of(F.col("t")).alias("words"), "t").dropDuplicates(["t"])
    texts = docs.select(F.md5("text").alias("digest"), F.col("text").alias("t"))
    got = {(r.value, r.term): (r.disclosure, r.pmi) for r in pii.disclosing(base, texts).collect()}
    assert len(want) >= 3 and got.keys() == want.keys()
    for k, x in want.items():
        assert got[k] == pytest.approx(x)


def test_copies_hide_nothing(spark):
    rows = fillers(400) + [(500 + i, f"Ann {'xyz'[i] * 4} text a@b.org about") for i in range(3)]
    copies = [(1000 + i, rows[-1][1]) for i in range(300)]
    docs = spark.createDataFrame(rows + copies, "doc_id long, text string")
    got = {r.row.doc_id: {m.v for m in r.terms} for r in pii.scan(docs).collect() if r.terms}
    assert set(got) == {500, 501, 502, *range(1000, 1300)}
    assert all(words == {"Ann"} for words in got.values())
