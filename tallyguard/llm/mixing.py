"""Mixing sources to target weights with hash-threshold histograms.

A document's hash decides its place in its source; a source's share is what lies under
a hash threshold. Words are summed by (source, hash bucket), the bucket where the sum
crosses the budget is found, and only that bucket is split further, twice. Nothing is
sorted, and a larger budget always takes a superset. A budget over the source's size
takes whole copies first and the rest by threshold.

Null sources are one source, last in order; null texts have size 0. Rows equal in id,
source and text have one hash and are taken or left together. Without words all
targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyguard.llm.text import WORD, or_empty, packed, unpacked
from tallyguard.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS = 12
LEVELS = 3
SEED = 20260


def _placed(rows: DataFrame, text: str) -> DataFrame:
    """Adds the document's size in words, its source and its hash."""
    r = F.col("row")
    return rows.select(
        "*", F.regexp_count(or_empty(r[text]), F.lit(WORD)).cast("long").alias("size"),
        r["source"].alias("source_"),
        F.xxhash64(F.lit(SEED), r["doc_id"], r["source"], r[text]).alias("h"))


def _bucket(level: int) -> Column:
    """The first ``level`` groups of hash bits."""
    return F.shiftrightunsigned("h", 64 - BITS * level)


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source_, source_size) to (source_, source_size, target).

    Capped sources are those with the least cap per weight, so the common rate is found
    from running sums over that order instead of repeated resharing. One row a source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source_").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (rank % len(weights) + 1).cast("int"))
    df = sizes.withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source_").asc_nulls_last())
    df = (df.withColumn("i", F.row_number().over(by_cap))
          .withColumn("full", F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, 0))
                      - F.col("cap"))
          .withColumn("left_w", F.sum("w").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
          .withColumn("budget", share * F.sum("source_size").over(W.partitionBy())))
    rate = (F.col("budget") - F.col("full")) / F.col("left_w")
    fits = df.withColumn("rate", rate).where(F.col("rate") <= F.col("cap") / F.col("w"))
    common = fits.agg(F.min_by("rate", "i").alias("rate"))
    return df.crossJoin(F.broadcast(common)).select(
        "source_", "source_size",
        F.coalesce(F.least(F.col("w") * F.col("rate"), "cap"), F.lit(0.0)).alias("target"))


def thresholds(placed: DataFrame, **mix) -> DataFrame:
    """Per source: source_size, target, whole copies, and the threshold of the rest.

    ``placed`` (source_, h, size) is read once per level; each pass shuffles at most
    2**BITS sums per source and task.
    """
    sums = materialize(placed.groupBy("source_", _bucket(1).alias("b")).agg(
        F.sum("size").alias("words")), "mix-level1")
    goal = targets(sums.groupBy("source_").agg(F.sum("words").alias("source_size")), **mix)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
                    ).otherwise(F.lit(0)).cast("int")
    state = goal.withColumn("copies", copies).withColumn(
        "need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = materialize(state, "mix-targets")
    for level in range(1, LEVELS + 1):
        if level > 1:
            inside = placed.withColumn("up", _bucket(level - 1)).alias("p").join(
                state.select("source_", "prefix").alias("s"),
                F.col("p.source_").eqNullSafe(F.col("s.source_"))
                & (F.col("p.up") == F.col("s.prefix")))
            sums = inside.groupBy(F.col("p.source_").alias("source_"), _bucket(level).alias("b")).agg(
                F.sum("size").alias("words"))
        running = W.partitionBy("source_").orderBy("b")
        sums = sums.withColumn("upto", F.sum("words").over(running))
        old = state.drop("prefix", "last")
        crossed = sums.alias("x").join(
            old.select("source_", "need").alias("s"),
            F.col("x.source_").eqNullSafe(F.col("s.source_"))
            & (F.col("x.upto") >= F.col("s.need"))).groupBy(
                F.col("x.source_").alias("source_")).agg(
                    F.min_by(F.struct("b", "words", "upto"), "b").alias("at"))
        state = old.alias("o").join(
            crossed.alias("c"), F.col("o.source_").eqNullSafe(F.col("c.source_")), "left").select(
                *[F.col(f"o.{c}") for c in old.columns if c != "need"],
                (F.col("need") - (F.col("at.upto") - F.col("at.words"))).alias("need"),
                F.col("at.b").alias("prefix"), F.col("at.words").alias("last"))
        state = materialize(state, f"mix-state{level}")
    # The last bucket (ties, or one document) goes in if that comes nearer to the target.
    return state.withColumn("with_last", F.col("last") < 2 * F.col("need"))


def _taken_copies() -> Column:
    b = _bucket(LEVELS)
    under = (b < F.col("prefix")) | ((b == F.col("prefix")) & F.col("with_last"))
    return F.coalesce(F.col("copies"), F.lit(0)) + F.coalesce(under, F.lit(False)).cast("int")


def _mixed(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Filters nothing yet: adds the source's figures and the copies taken of each row."""
    return rows.alias("r").join(
        cuts.alias("c"), F.col("r.source_").eqNullSafe(F.col("c.source_")), "left").select(
            "r.*", "source_size", "target", _taken_copies().alias("times"))


def mix(docs: DataFrame, text: str = "text", **mixing) -> DataFrame:
    """The mixed rows with their own columns; a document taken twice is there twice.

    Needs columns doc_id and source. The texts are read twice and never shuffled; the
    per-source cuts are a written table, broadcast only as Spark finds it small.
    """
    rows = packed(docs)
    lean = materialize(_placed(rows, text).select("source_", "h", "size"), "mix-placed")
    out = _mixed(_placed(rows, text), thresholds(lean, **mixing)).where(F.col("times") > 0)
    again = F.explode(F.sequence(F.lit(1), F.col("times")))
    return unpacked(out.select("row", again.alias("copy")), docs)


def report(docs: DataFrame, **mixing) -> DataFrame:
    """Size, source size, target and words taken per document."""
    rows = packed(docs.select("doc_id", "source", "text"))
    lean = materialize(_placed(rows, "text").select(
        F.col("row.doc_id").alias("doc_id"), "source_", "h", "size"), "mix-placed")
    return _mixed(lean, thresholds(lean, **mixing)).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"))
