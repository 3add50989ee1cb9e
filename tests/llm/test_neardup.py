"""Near-dedup against comparing all pairs of documents."""

import random

import numpy as np

from tallyguard.llm import neardup


def shingles(text, width=3):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = low.encode().split()
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} - {()}


def corpus():
    rng = random.Random(4)
    vocab = [f"W{i}é" for i in range(2000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]

    def edit(words, times):
        words = list(words)
        for _ in range(times):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        return words

    base = say(150)     # a large group of near copies, few of them similar enough to be linked
    texts = [edit(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 9])) for _ in range(150)]
    for _ in range(60):
        seed = say(rng.choice([1, 2, 3, 30, 120, 500]))
        texts += [seed, seed] + [edit(seed, rng.choice([1, 1, 2, 6])) for _ in range(rng.choice([0, 2]))]
    shared = say(40)    # a passage that many otherwise different texts hold
    texts += [say(120) + shared for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i * 3 + 1 if i % 11 else None, "  ".join(w)) for i, w in enumerate(texts)]
    rows += [(9001, None), (9002, ""), (None, " \n"), (9003, rows[1][1].lower()), rows[5], rows[5],
             (9004, rows[2][1] + " tail" * 30_000)]
    return rows


def brute(rows, like=neardup.Likeness()):
    sets = [frozenset(shingles(t, like.words)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= like.percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= like.percent * (len(a) + len(b) - both) and find(i) != find(j):
                    root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in groups[find(i)] if rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out, groups, sets


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    want, groups, sets = brute(rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.report(docs.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(map(len, groups.values())) > 40
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    worded = sum(bool(sets[g[0]]) for g in groups.values())
    assert kept.count() == worded + sum(not s for s in sets)


def test_five_words_and_four_fifths(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(1000)]
    rows = corpus()[:150] + [(7000, " ".join(words)), (7001, " ".join(words + words[:150][::-1] + ["x"] * 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    like = neardup.FIVE_WORDS
    _, groups, sets = brute(rows, like)
    assert any({150, 151} <= set(g) for g in groups.values())
    want = {frozenset(rows[i][0] for i in g) for g in groups.values() if sets[g[0]]}
    got = {}
    for r in neardup.classes(docs, like=like).where("label IS NOT NULL").collect():
        got.setdefault(r.label, set()).add(r.doc_id)
    assert set(map(frozenset, got.values())) == want


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert neardup.report(docs.limit(0)).collect() == []
    assert [tuple(r) for r in neardup.report(docs).collect()] == [(1, 1, 1, True)]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, (2, 50), dtype=np.uint64)
        x, y = (neardup.signature(np.unique(np.r_[both, o])) for o in own)
        same.append((x == y).mean())
    assert abs(np.mean(same) - (.9 ** neardup.ROWS)) < .05


def test_runs_are_whole_across_batches():
    import pyarrow as pa
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 300))
    node, n = np.arange(300), np.full(300, 10)
    batches = [pa.record_batch([pa.array(keys[i:i + 7]), pa.array(node[i:i + 7]), pa.array(n[i:i + 7])],
                               ["key", "node", "n"]) for i in range(0, 300, 7)]
    got = set()
    for b in neardup._few(iter(batches)):
        got |= set(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    want = {(a, b) for a in range(300) for b in range(a + 1, 300)
            if keys[a] == keys[b] and (keys == keys[a]).sum() <= neardup.FEW}
    assert {p for p in got if p[1] >= 0} == want
