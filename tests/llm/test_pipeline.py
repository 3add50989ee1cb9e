"""The pipeline on a small corpus: every stage against a plain reading of its own input."""

import random

import pytest

import corpus_pipeline
from tallyguard.llm import lines, mixing, neardup
from tests.llm import test_decontaminate, test_lines, test_mixing, test_neardup, test_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(13)
    vocab = [f"word{i}" for i in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [say(20) for _ in range(6)]
    texts = []
    for i in range(160):
        body = [say(rng.choice([30, 60])) for _ in range(rng.choice([1, 2, 4]))]
        if i % 9 == 0:
            body.append(rng.choice(items))
        if i % 7 == 0:
            body.append("one line that many documents share between them")
        texts.append("\n".join(body))
    texts += [texts[3], texts[4], texts[5].replace("word", "WORD", 1)]
    texts += [" ".join(x if rng.random() > .02 else "changed" for x in t.split(" ")) for t in texts[10:30]]
    texts += [None, "", "too few words", "$$$ ### " * 30, "again and again " * 40]
    rng.shuffle(texts)
    docs = [(i if i % 23 else None, t, "en", rng.choice(["a", "a", "a", "b", "c", None]), 0)
            for i, t in enumerate(texts)]
    return docs, [(i, t) for i, t in enumerate(items)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, items = corpus()
    spark.createDataFrame(docs, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    df, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, df, folder)
        assert new.columns[:5] == df.columns
        path = f"{folder}/{name}"
        new.write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, [tuple(r) for r in df.collect()], [tuple(r) for r in new.collect()]))
        df = new
    return folder, out, items


def test_order(stages):
    assert [n for n, _, _ in stages[1]] == [
        "quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mix"]
    assert all(0 < len(after) for _, _, after in stages[1])


def test_quality_rules(stages):
    _, before, after = stages[1][0]
    want = []
    for r in before:
        n, chars, symbols, _, repeats = test_quality.brute(r[1])
        if n >= 20 and 100 * repeats <= 30 * n and 10 * symbols <= n and 3 * n <= chars <= 12 * n:
            want.append(r)
    assert sorted(after, key=str) == sorted(want, key=str)


def test_line_dedup(stages):
    _, before, after = stages[1][1]
    normal, find, members = test_lines.brute([(r[0], r[1]) for r in before])
    kept = [find(normal(x)) for r in after for x in r[1].split("\n") if normal(x)]
    assert len(kept) == len(set(kept)) and set(kept) == set(members)
    assert lines.PERCENT == 80 and {(r[0], *r[2:]) for r in after} <= {(r[0], *r[2:]) for r in before}


def test_near_dedup(stages):
    _, before, after = stages[1][2]
    _, groups, sets = test_neardup.brute([(r[0], r[1]) for r in before], neardup.Likeness(5, 80))
    group_of = {before[i][1]: g for g, rows in groups.items() for i in rows}
    assert sorted(group_of[r[1]] for r in after) == sorted(g for g in groups if sets[g])
    assert set(after) <= set(before)


def test_decontamination(stages):
    _, before, after = stages[1][3]
    sets = [test_decontaminate.shingles(t) for _, t in stages[2]]
    clean = [r for r in before if not any(
        100 * len(s & test_decontaminate.shingles(r[1])) >= 80 * len(s) for s in sets)]
    assert len(clean) < len(before) and sorted(after, key=str) == sorted(clean, key=str)


def test_source_mix(stages):
    _, before, after = stages[1][4]
    size = lambda rows, s: sum(len(r[1].split()) for r in rows if r[3] == s)
    sources = {r[3] for r in before}
    goal = test_mixing.reshared({s: size(before, s) for s in sources})
    for s in sources:
        assert abs(size(after, s) - goal[s]) <= max(len(r[1].split()) for r in before)
    assert max(after.count(r) for r in set(after)) <= mixing.MOST


def test_run_repeats(spark, stages):
    got = [tuple(r) for r in corpus_pipeline.run(spark, stages[0]).collect()]
    assert sorted(got, key=str) == sorted(stages[1][4][2], key=str)
