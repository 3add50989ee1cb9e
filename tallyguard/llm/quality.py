"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule; a policy is a named, versioned set of rules, so trying
another policy or leaving a rule out is bit arithmetic on the ledger and reads no
text.

Nulls and empty texts have no words and fail ``few_words``. Repeated rows get equal
verdicts. Measurements are 64-bit-hash exact: windows are told apart by the hash of
eight word hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.staging import once
from tallyguard.llm.text import or_empty, packed, unpacked, words

WINDOW = 8

def _rules() -> dict[str, Column]:
    """Rule name to failing condition over the measurements; products, no divisions by zero."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "short_words": c("word_chars") < 3 * c("n_words"),
        "long_words": c("word_chars") > 12 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 35 * c("n_lines"),
        "shouting": 100 * c("n_upper") > 30 * c("n_chars_all"),
        "stuttering": 100 * c("n_stutters") > 20 * c("n_words"),
    }


#: In bit order; bits are never reused, so old ledgers stay readable.
RULE_NAMES = ("few_words", "repeated_windows", "short_words", "long_words", "symbols",
              "duplicate_lines", "shouting", "stuttering")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("web", 3, RULE_NAMES)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input row) and the measurements of its text, one pass, no shuffle."""
    df = packed(docs).select("row", or_empty(F.col("row")[text]).alias("t"))
    df = once(df, words=words(F.col("t")))
    df = once(df, h=F.transform("words", lambda w: F.xxhash64(w)),
              lines=F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("h")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW),
                         lambda i: F.xxhash64(*[F.col("h")[i + k] for k in range(WINDOW)]))
    df = once(df, win=F.when(n >= WINDOW, window))
    # Windows that occur again are rare: only such texts are sorted.
    again = F.size(F.array_distinct("win")) < F.size("win")
    df = once(df, runs=F.when(again, F.sort_array(F.transform(
        "win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    runs = F.col("runs")
    twice = F.filter(runs, lambda p, j: (F.get(runs, j - 1)["x"].eqNullSafe(p["x"]))
                     | (F.get(runs, j + 1)["x"].eqNullSafe(p["x"])))
    df = once(df, starts=F.sort_array(F.transform(twice, lambda p: p["i"])))
    starts = F.col("starts")
    covered = F.aggregate(
        F.transform(starts, lambda s, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    return df.select(
        "row", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length("t").cast("long").alias("n_chars_all"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("h", lambda x, i: x == F.get(F.col("h"), i - 1))).cast("long")
        .alias("n_stutters"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the measurements and ``failed_bits``: bit i is set if rule i failed."""
    return once(measured(docs, text), failed_bits=_bits())


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    rules = _rules()
    for i, name in enumerate(RULE_NAMES):
        bits = bits.bitwiseOR(F.when(rules[name], F.lit(1 << i).cast("long")).otherwise(
            F.lit(0).cast("long")))
    return bits


def passes(policy: Policy) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds the verdict of one policy version to a ledger."""
    return rows.withColumn("kept", passes(policy)).withColumn(
        "policy", F.lit(f"{policy.name}.v{policy.version}"))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that only it rejects.

    One aggregate over the ledger's bits; an empty ledger gives zeros.
    """
    hit = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count(F.when(hit != 0, 1)).alias("rejected")]
    for name in policy.rules:
        bit = F.lit(1 << RULE_NAMES.index(name)).cast("long")
        sums += [F.count(F.when(hit.bitwiseAND(bit) != 0, 1)).alias(f"f_{name}"),
                 F.count(F.when(hit == bit, 1)).alias(f"o_{name}")]
    one = rows.agg(*sums)
    return one.select("rejected", F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"),
                 F.col(f"o_{r}").alias("only_this_rule")) for r in policy.rules])))


def keep_good(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    return unpacked(ledger(docs, text).where(passes(policy)), docs)


def report(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """Measurements and verdict per document."""
    rows = apply_policy(ledger(docs.select("doc_id", "text")), policy)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", (~passes(BASE)).alias("base_failed"), "kept", "failed_bits")
