"""Ranked search against scoring every document, and the bounds it skips by."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))


def brute(docs, items, limit=10):
    held = [(d, c) for d, t in docs if (c := terms(t))]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item_id, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=str)


def corpus(seed, n_docs=120, n_items=25):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Émile", "the", "The", "of", "日本", "x-y", "a1,b2"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda most: " ".join(pick.choices(words, weights, k=pick.randrange(0, most)))
    docs = [(i, text(80)) for i in range(n_docs)]
    docs += docs[:15] + [(n_docs, None), (None, "w0 w1 w59 the"), (n_docs + 1, ""), (n_docs + 2, "?!")]
    items = [(i, text(12)) for i in range(n_items)]
    return docs, items + items[:2] + [(900, None), (901, " . "), (902, "nowhere"), (None, "w1 w2")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in docs],
                              "doc_id long, text string, score long, item_id string")
    return d.repartition(3), spark.createDataFrame([(*i, 1) for i in items],
                                                   "item_id long, text string, doc_id long")


def got(spark, docs, items, **how):
    return sorted(map(tuple, search.search(*frames(spark, docs, items), **how).collect()), key=str)


@pytest.mark.parametrize("seed,limit", [(1, 10), (2, 3), (3, 1000)])
def test_equals_scoring_everything(spark, seed, limit):
    docs, items = corpus(seed)
    want = brute(docs, items, limit)
    assert len(want) > 60
    assert got(spark, docs, items, limit=limit) == want


def test_rounds_of_items(spark, monkeypatch):
    docs, items = corpus(4, 40, 12)
    monkeypatch.setattr(search, "ITEM_BYTES", 200)
    assert got(spark, docs, items) == brute(docs, items)


def test_empty_and_long(spark):
    docs, items = corpus(5, 10, 4)
    assert got(spark, [], items) == [] and got(spark, docs, []) == []
    assert got(spark, [(1, None)], items) == []
    docs.append((77, "w3 the " * 300_000 + "w40"))
    assert got(spark, docs, items) == brute(docs, items)


def blocks(docs, items, per_block):
    """Blocks and items prepared in this process."""
    import pyarrow as pa

    asked = [terms(t) for _, t in items]
    vocabulary = {t.encode(): i for i, t in enumerate(sorted(set().union(*asked), key=str.encode))}
    parts = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs[i:i + per_block]], pa.int64()),
                                         pa.array([t for _, t in docs[i:i + per_block]])], ["doc_id", "text"])
             for i in range(0, len(docs), per_block)]
    raw = list(search._index(iter(parts), vocabulary))
    held = [c for _, t in docs if (c := terms(t))]
    df = Counter(t.encode() for c in held for t in c)
    weight = np.array([math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                       for t in sorted(vocabulary)], dtype=np.int64)
    corp = search.Corpus(len(held), sum(c.total() for c in held))
    ready = search.Items.of(weight, [np.array(sorted(vocabulary[t.encode()] for t in c), dtype=np.int64)
                                     for c in asked])
    return [search.Block(b, 0, ready) for b in search._prepare(iter(raw), ready, corp)], ready


def test_bounds_hold_and_pairs_tighten_them():
    docs, items = corpus(6)
    some, ready = blocks(docs, items, 40)
    tighter = 0
    for block in some:
        for item, names in enumerate(ready.terms):
            bounds = block.bounds(item)
            score, alone = np.zeros(len(block.ids), dtype=np.int64), 0
            for j, term in enumerate(names, 1):
                at, impact = block.postings(term)
                score[at] += impact
                alone += int(block.most[term])
                assert score.max(initial=0) <= bounds[j] <= alone
            tighter += len(names) > 1 and bounds[-1] < 0.9 * alone
    assert tighter > 20


def test_skipping_leaves_documents_untouched():
    docs, items = corpus(7, 400, 10)
    some, ready = blocks(docs, items, 100)
    held = touched = skipped = 0
    for block in some:
        for item in range(len(ready.terms)):
            full = block.search(item, 0, 1000)
            if not full:
                continue
            beat = full[min(9, len(full) - 1)][0]
            held += len(full)
            assert block.search(item, beat, 1000) == [x for x in full if x[0] >= beat]
            touched += np.count_nonzero(block.score)
            skipped += block.search(item, block.bounds(item)[-1] + 1, 10) == []
    assert touched < 0.7 * held and skipped > 40


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 200))
def test_any_score_to_beat_keeps_what_reaches_it(seed, part):
    docs, items = corpus(seed, 30, 3)
    some, ready = blocks(docs, items, 20)
    for block in some:
        for item in range(3):
            full = block.search(item, 0, 1000)
            beat = full[0][0] * part // 100 if full else 1
            assert block.search(item, beat, 1000) == [x for x in full if x[0] >= beat]
