"""Targets against repeated resharing; what is taken comes near them."""

import random

from tallyguard.llm import mixing


def reshared(sizes):
    """Source to target, by the contract's own words."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    goal, free, left = {}, list(order), mixing.SHARE * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > mixing.MOST * sizes[s]]
        if not over:
            return goal | {s: left * weight[s] / total for s in free}
        for s in over:
            goal[s] = mixing.MOST * sizes[s]
            left -= goal[s]
            free.remove(s)
    return goal


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * (1 + i % 3) for _ in range(rng.choice([1, 5, 40, 300]))),
             rng.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None]), 0) for i in range(1500)]
    rows += [(None, None, "b", 0), (None, "", "d", 0), (7, "x y z", "c", 0), (7, "x y z", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s)
             for s in {r[2] for r in rows}}
    goal = reshared(sizes)
    by_target = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(by_target) == {(sizes[s], round(goal[s], 6)) for s in sizes}
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 300
    again = mixing.report(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in mixed.collect())
    assert words == sum(r.taken for r in got)


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")],
                                 "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.report(docs).collect()} == {(0, 0.0, 0)}
    assert mixing.report(docs.limit(0)).collect() == []
