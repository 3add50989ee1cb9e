"""Quality ledger against a plain reading of the rules."""

import random
import re

from tallyguard.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [s for s in text.split("\n") if WORD.search(s)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t ", "one", "ü😀 # $", "a\n\na\n \na b\x0bc\x0c", "x " * 8, "x " * 9]
    for _ in range(60):
        vocab = [f"w{i}" for i in range(rng.choice([2, 5, 40]))]
        out.append("".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  ", "\r\n"])
                           for _ in range(rng.randint(1, 120))))
    return out + ["long words here " * 5_000, out[-1]]


def test_measures(spark):
    rows = [(i if i % 9 else None, t, "q") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.ledger(docs).select("row.text", "n_stutters", *[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == brute(r.text), r.text
        w = WORD.findall(r.text or "")
        assert r.n_stutters == sum(a == b for a, b in zip(w, w[1:]))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()} <= {t for _, t, _ in rows}


def test_policies_and_ablation(spark):
    good = " ".join(f"word{i} and" for i in range(30))
    rows = [(1, good), (2, "few words"), (3, "same words again now " * 20), (4, "| a " * 40)]
    led = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    kept = {p.name: {r.row.doc_id for r in quality.apply_policy(led, p).where("kept").collect()}
            for p in (quality.BASE, quality.STRICT)}
    assert kept["base"] == {1} and kept["web"] == {1}
    table = {r.rule: (r.rejected, r.failed, r.only_this_rule)
             for r in quality.ablation(led, quality.STRICT).collect()}
    assert table["few_words"] == (3, 1, 1)
    assert table["repeated_windows"] == (3, 2, 1)
    assert table["symbols"][1:] == (1, 0)
    assert {r.failed for r in quality.ablation(led.limit(0), quality.BASE).collect()} == {0}
    led.unpersist()
