"""URL filter: prefix rules first, a character language-model ratio for the rest.

Two interpolated variable-order Markov models (Witten-Bell: an unseen context falls
back to its suffix) are counted from the URLs that rules accept and reject. A URL's
score is the mean over its characters of the difference of their log-probabilities.
One in five ruled URLs is left out of the counts; the threshold is where balanced
accuracy over those is best.

Characters are folded to 37 symbols (letters, one digit class, eight signs, one other,
one pad), so the table of four-symbol grams has at most 37**4 rows of about 40 bytes,
whatever the input: that proven bound is why it is broadcast.

Null URLs have an empty host and path and are scored as an empty string. Without ruled
URLs of both kinds the threshold is 0 and ties are allowed. Repeated rows get equal
verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyguard.llm.text import or_empty, packed
from tallyguard.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule (host, then path prefix) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))
ORDER = 3
SYMBOLS = 37
HELD_OUT = 5
BIN = 0.005
RANGE = 8.0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = name.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _symbols(url: Column) -> Column:
    """Folded, padded symbols as bytes; bytes are cut in constant time, characters are not."""
    body = F.lower(F.regexp_replace(url, r"^[\s\S]*?://", ""))
    body = F.regexp_replace(F.regexp_replace(body, "[0-9]", "0"), r"[^a-z0./?=&#_-]", "*")
    return F.encode(F.concat(F.lit("^" * ORDER), body, F.lit("^")), "UTF-8")


def _grams(rows: DataFrame) -> DataFrame:
    at = F.sequence(F.lit(1), F.length("symbols") - ORDER)
    return rows.withColumn("at", F.explode(at)).withColumn(
        "gram", F.substring(F.col("symbols"), F.col("at"), F.lit(ORDER + 1)).cast("string"))


def log_ratios(counted: DataFrame) -> DataFrame:
    """``gram``, ``delta``: log of its last symbol's probability, accepting over rejecting model.

    ``counted`` has every gram once with its counts ``a`` and ``b``; zero where only
    unruled URLs hold it.
    """
    probability = None
    for k in range(ORDER + 1):
        tail = F.substring(F.col("gram"), ORDER + 1 - k, k + 1)
        seen = counted.groupBy(tail.alias("tail")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        seen = seen.withColumn("context", F.substring("tail", 1, k))
        total = seen.groupBy("context").agg(
            F.sum("a").alias("ca"), F.sum("b").alias("cb"),
            F.count(F.when(F.col("a") > 0, 1)).alias("ta"),
            F.count(F.when(F.col("b") > 0, 1)).alias("tb"))
        rows = seen.join(total, "context")
        if k:
            rows = rows.withColumn("tail_", F.substring("tail", 2, k)).join(
                probability.withColumnRenamed("tail", "tail_"), "tail_")
        lower = {m: F.col(f"p{m}") if k else F.lit(1.0 / SYMBOLS) for m in "ab"}

        def mixed(m: str) -> Column:
            n = F.col(f"c{m}") + F.col(f"t{m}")
            return F.when(n == 0, lower[m]).otherwise(
                (F.col(m) + F.col(f"t{m}") * lower[m]) / n)  # noqa: B023

        probability = rows.select("tail", mixed("a").alias("pa"), mixed("b").alias("pb"))
    return probability.select(F.col("tail").alias("gram"),
                              (F.log("pa") - F.log("pb")).alias("delta"))


def threshold(scores: DataFrame) -> DataFrame:
    """One row ``threshold`` from ``score`` and ``verdict`` of held-out ruled URLs.

    Counts per score bin (3,200 bins at most) are summed from below; cuts lie midway
    between neighbouring filled bins. The best cut has the highest mean of accepted
    above and rejected below, the nearest to 0 of equals.
    """
    at = F.floor(F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.col("score"))) / BIN)
    bins = scores.groupBy(at.alias("bin")).agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    cut = bins.select(
        ((F.coalesce(F.lag("bin").over(W.orderBy("bin")) + 1, "bin") + F.col("bin")) * (BIN / 2))
        .alias("cut"), F.sum("a").over(whole).alias("all_a"),
        F.sum("b").over(whole).alias("all_b"),
        F.coalesce(F.sum("a").over(below), F.lit(0)).alias("a_below"),
        F.coalesce(F.sum("b").over(below), F.lit(0)).alias("b_below"))
    gain = F.col("b_below") / F.col("all_b") - F.col("a_below") / F.col("all_a")
    best = cut.where((F.col("all_a") > 0) & (F.col("all_b") > 0)).agg(
        F.max_by("cut", F.struct(gain, -F.abs("cut"))).alias("cut"))
    return best.select(F.coalesce("cut", F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """``row`` (the input row), host, path, rule, verdict, score and threshold per page."""
    df = packed(pages).withColumn("u", or_empty(F.col("row")[url]))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    df = (df.withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
          .withColumns({"rule": rule, "ruled": verdict, "symbols": _symbols(F.col("u"))}))
    held_out = F.pmod(F.xxhash64("u"), F.lit(HELD_OUT)) == 0
    learns = lambda v: F.count(F.when((F.col("ruled") == v) & ~F.col("held_out"), 1))
    counted = _grams(df.select("ruled", held_out.alias("held_out"), "symbols")).groupBy("gram").agg(
        learns("allow").alias("a"), learns("block").alias("b"))
    ratios = materialize(log_ratios(materialize(counted, "url-grams")), "url-ratios")
    # One row a page leaves each task: a page's grams never leave the task that read it.
    keyed = df.withColumn("key", F.monotonically_increasing_id())
    scored = (_grams(keyed.select("key", "row", "u", "host", "path", "rule", "ruled", "symbols"))
              .join(F.broadcast(ratios), "gram")
              .groupBy("key", "row", "u", "host", "path", "rule", "ruled")
              .agg(F.avg("delta").alias("score")))
    scored = materialize(scored.drop("key"), "url-scores")
    cut = threshold(scored.where(held_out & F.col("ruled").isNotNull()).select(
        "score", F.col("ruled").alias("verdict")))
    learned = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return scored.crossJoin(F.broadcast(cut)).select(
        "row", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"),
        "score", "threshold")


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select(
        "row.page_id", "host", "path", "rule", "verdict", "score", "threshold")


def keep_allowed(pages: DataFrame, rules=RULES) -> DataFrame:
    """The pages whose verdict is allow, with their own columns."""
    return judge(pages, rules).where(F.col("verdict") == "allow").select("row.*")
