"""Phrase collocations against plain counting, and what the summaries promise."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest):
    """(lang, phrase) to occurrences, and words per language."""
    counts, words = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return counts, words


def brute(rows, longest=3, threshold=10, share=50, limit=2000):
    counts, words = counted(rows, longest)
    found = {}
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < threshold:
            continue
        cuts = [(10**6 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k)
                for k in range(1, len(w))]
        score, k = min(cuts)
        inside = [f for (g, v), f in counts.items() if g == lang and len(v) > len(w) and f >= threshold
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if all(100 * f < share * a for f in inside):
            found.setdefault(lang, []).append(
                (-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, words[lang], -score)
                  for lang, some in found.items()
                  for rank, (score, a, p, left, right) in enumerate(sorted(some)[:limit], 1))


def corpus(seed=1, n=60):
    pick = random.Random(seed)
    vocabulary = ["new", "york", "City", "the", "of", "é", "Éa", "été", "x.", "a,b", "in\tto", "\x0bz"]
    rows = [(pick.choice(["en", "fr", None, "und", ""]),
             " ".join(pick.choices(vocabulary, weights=range(1, 13), k=pick.randrange(0, 40))))
            for _ in range(n)]
    return rows + rows[:9] * 3 + [("en", None), (None, None), ("de", ""), ("fr", "\n.,;  ")]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, g, 1, "s", 0) for i, (g, t) in enumerate(rows)],
        "doc_id long, text string, lang string, n long, phrase string, hash long")


def got(spark, rows, **how):
    return sorted(map(tuple, phrases.collocations(frame(spark, rows), **how).collect()))


def test_equals_plain_counting(spark):
    rows = corpus(n=400)
    want = brute(rows)
    assert len(want) > 50 and {r[0] for r in want} >= {"en", "und"}
    assert got(spark, rows) == want


def test_other_lengths_limits_and_tiny_runs(spark, monkeypatch):
    rows = corpus(2, 40)
    assert got(spark, rows, longest=4, threshold=4, share=80, limit=7) == brute(rows, 4, 4, 80, 7)
    assert got(spark, rows, longest=2) == brute(rows, 2)


def test_one_language_and_text_with_nearly_all_words(spark):
    rows = [("en", "to be or not to be " * 20_000)] + corpus(3, 10) + [("en", "to be " * 9)] * 50
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_phrases_of_great_numbers(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", None)]) == []
    score = spark.sql(
        "SELECT (cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0)))"
        " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) AS s"
        " FROM VALUES (9999999999999999L, 9999999999999999L, 10000000000000000L) AS t(a, l, r)")
    assert score.first().s == 10**6 * 9999999999999999 // 10**16


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=200), st.integers(2, 12))
def test_no_frequent_key_is_lost(items, threshold):
    """Over any split of the rows into summaries, merged in order."""
    mass, true = sum(n for _, n in items), Counter()
    for key, n in items:
        true[key] += n
    parts = [phrases.Summary(mass // threshold + 1) for _ in range(3)]
    for i, (key, n) in enumerate(items):
        parts[i % 3].add(np.array([key]), np.array([n]))
    for other in parts[1:]:
        parts[0].merge(other)
    assert parts[0].error < threshold and len(parts[0].keys) <= mass // threshold + 1
    assert {k for k, n in true.items() if n >= threshold} <= set(parts[0].at_least(threshold).tolist())
    assert all(true[k] - parts[0].error <= c <= true[k] for k, c in zip(
        parts[0].keys.tolist(), parts[0].counts.tolist()))


def test_a_partition_keeps_far_fewer_counters_than_keys():
    part = phrases._Partition(10)
    rare, often = np.arange(100_000), np.arange(100_000, 100_300)
    keys = np.concatenate([rare, np.repeat(often, 5)])
    counts = np.concatenate([np.ones(100_000, dtype=np.int64), np.full(1500, 3)])
    order = np.random.default_rng(0).permutation(len(keys))
    part.add(np.zeros(1, dtype=bool), np.zeros(1, dtype=np.int64), np.array([counts.sum()]))
    for chunk in np.array_split(order, 50):
        part.add(np.ones(len(chunk), dtype=bool), keys[chunk], counts[chunk])
    assert part.summary.capacity == counts.sum() // 10 + 1 < 11_000
    left = part.survivors()
    assert set(often.tolist()) <= set(left.tolist()) and len(left) <= part.summary.capacity


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", " ", "  ", "\t", ".", "\n", "ccc"]), max_size=60).map("".join),
       st.integers(1, 12))
def test_cut_texts_lose_nothing(text, limit):
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text])], ["lang", "text"])
    total = Counter()
    for run in phrases.runs(iter([batch]), 3, limit=limit):
        for g in phrases.grams(run, 3, []):
            for at, n in zip(g.first, g.counts):
                total["x", tuple(run.words[t].decode() for t in run.tokens[at:at + g.order])] += int(n)
    assert total == counted([("x", text)], 3)[0]


def test_bit_filter_holds_its_hashes(spark):
    values = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    table = spark.createDataFrame([(int(v),) for v in values], "hash long")
    found = phrases.bit_filter(table)
    assert found.has(values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 5000).view(np.uint64)
    assert found.has(others).mean() < 0.05
