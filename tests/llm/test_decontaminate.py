"""Containment search against comparing every document with every item."""

import random

from pyspark.sql import functions as F

from tallyguard.llm import decontaminate


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)}


def tables():
    rng = random.Random(11)
    vocab = [f"W{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([5, 6, 9, 14, 30, 57])))) for i in range(40)]
    items += [(100, None), (101, "too short"), (None, " ".join(say(20))), (7, items[7][1])]
    docs = []
    for i in range(300):
        body = say(rng.choice([0, 3, 40, 400]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = rng.choice(vocab)
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i if i % 10 else None, " ".join(body), "x"))
    return docs + [docs[5], (999, None, None), (998, items[3][1] + " word" * 50_000, "x")], items


def test_equals_all_pairs(spark):
    rows, items = tables()
    docs = spark.createDataFrame(rows, "doc_id long, text string, shingle string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets = {}
    for i, t in items:
        sets.setdefault(i, set()).update(shingles(t))
    want = []
    for d, t, _ in rows:
        have = shingles(t)
        want += [(d, i, len(s & have), len(s)) for i, s in sets.items()
                 if s and 100 * len(s & have) >= decontaminate.PERCENT * len(s)]
    got = list(map(tuple, decontaminate.report(docs, bench).collect()))
    assert len(want) > 50 and sorted(got, key=str) == sorted(want, key=str)
    kept = decontaminate.remove_leaks(docs, bench)
    assert kept.columns == docs.columns
    bad = {t for _, t, _ in rows if any(
        s and 100 * len(s & shingles(t)) >= decontaminate.PERCENT * len(s) for s in sets.values())}
    assert sorted(map(str, kept.collect())) == sorted(
        str(r) for r in docs.collect() if r.text not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.report(docs, none).collect() == []
    assert decontaminate.remove_leaks(docs, none).collect() == docs.collect()
    assert decontaminate.report(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
