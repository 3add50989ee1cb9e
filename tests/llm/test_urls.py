"""URL rules against a plain reading; the models on URLs that differ in style."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tallyguard.llm import urls


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, _ in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or "", rule, key=len)
    return host, path, best


URLS = [None, "", "x", "http://", "HTTP://A.Example.NET/en/x?y://z", "https://net/", "http://net",
        "ftp://internet/x", "http://q.example.com/de/1#a", "http://b.org/fr/", "http://b.org/frx",
        "http://É.net/é?x", "a://b://c.net/d", "http://x.net?y/z", "http://a.net/\nb",
        "http://example.net/en/", "http://example.net/enx/", "http://" + "a" * 30_000 + ".net/x"]


def test_rules(spark):
    rows = [(i if i else None, u, "h") for i, u in enumerate([*URLS, *URLS[:4]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(pages).collect()
    assert len(got) == len(rows)
    verdicts = dict(urls.RULES)
    for r in got:
        assert (r.host, r.path, r.rule) == brute(r.row.url)
        assert r.verdict in ("allow", "block") and r.score is not None
        assert r.rule is None or r.verdict == verdicts[r.rule]
    assert urls.judge(pages.limit(0)).collect() == []
    assert urls.keep_allowed(pages).columns == pages.columns


def test_ratios_equal_plain_models(spark):
    grams = {"^^^a": (3, 1), "^^ab": (2, 1), "xxab": (0, 4), "xxac": (5, 0), "zzzz": (0, 0)}
    df = spark.createDataFrame([(g, *n) for g, n in grams.items()], "gram string, a long, b long")
    got = {r.gram: r.delta for r in urls.log_ratios(df).collect()}

    def p(model, gram, k):
        if k < 0:
            return 1 / urls.SYMBOLS
        seen = Counter()
        for g, n in grams.items():
            if g[3 - k:3] == gram[3 - k:3]:
                seen[g[3]] += n[model]
        c, t = sum(seen.values()), sum(v > 0 for v in seen.values())
        lower = p(model, gram, k - 1)
        return (seen[gram[3]] + t * lower) / (c + t) if c + t else lower

    for g in grams:
        want = math.log(p(0, g, 3)) - math.log(p(1, g, 3))
        assert abs(got[g] - want) < 1e-9


def test_style_is_learned(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(12))
    good, bad = "aeioulmn", "qxzkjwvy"
    rows = [(i, f"http://{word(good)}.org/fr/{word(good)}") for i in range(200)]
    rows += [(i + 1000, f"http://{word(bad)}.net/{word(bad)}") for i in range(200)]
    rows += [(i + 2000, f"http://{word(good)}.com/{word(good)}") for i in range(100)]
    rows += [(i + 3000, f"http://{word(bad)}.com/{word(bad)}") for i in range(100)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    got = got.where(F.col("row.page_id") >= 2000).select("row.page_id", "verdict").collect()
    assert sum((r.verdict == "allow") == (r.page_id < 3000) for r in got) >= 0.9 * len(got)
