"""Benchmark decontamination: size-partitioned MinHash containment search.

An item of q distinct five-word shingles is contained in a document at 80 % if at
least ``need`` of them occur in it. Then of any q - need + 1 of its shingles one must
occur, so the item's sketch is its q - need + 1 smallest shingle hashes (a bottom-k
MinHash whose k follows from the item's size) and the search loses nothing. Items are
partitioned by size; a document keeps only hashes up to the largest sketch value among
partitions that it is long enough to contain, whatever its own length. Documents that
meet a sketch are verified by counting equal shingle texts.

Null and empty texts hold nothing. Items with fewer than five words have no shingle
and are never found. Rows of one item id are one item. Equal texts are searched once;
every row of such a text is reported or dropped, also with a null or repeated id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyguard.functions.staging import once
from tallyguard.llm.text import or_empty, packed, unpacked, words
from tallyguard.session import materialize

SHINGLE = 5
PERCENT = 80
#: Rows of about 60 bytes up to which an item table is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast if a count proves it small. Pass what a written table gives."""
    return F.broadcast(df) if df.count() <= rows else df


def _words(text: Column) -> Column:
    return words(F.lower(text))


def hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds ``sh``: hashes of the shingles in order, empty where there are none."""
    df = once(df, wh=F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("wh")
    windows = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(
        *[F.col("wh")[i + k] for k in range(SHINGLE)]))
    return once(df, sh=F.when(n >= SHINGLE, windows).otherwise(F.array().cast("array<bigint>")))


def spelled(df: DataFrame, text: str) -> DataFrame:
    """One row per distinct shingle text of each row, as ``shingle``."""
    df = once(df, w=_words(F.col(text)))
    n = F.size("w")
    texts = F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(1), n - SHINGLE + 1),
        lambda i: F.array_join(F.slice("w", i, F.lit(SHINGLE)), " ")))
    return df.withColumn("shingle", F.explode(F.array_distinct(texts))).drop("w")


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, shingle, hash, q, need): every distinct shingle of every item."""
    rows = spelled(items.select("item_id", or_empty("text").alias("t")), "t").select(
        "item_id", "shingle").distinct()
    rows = rows.withColumn("hash", F.xxhash64(*[
        F.xxhash64(F.split_part("shingle", F.lit(" "), F.lit(k + 1))) for k in range(SHINGLE)]))
    per = rows.groupBy("item_id").agg(F.count("*").alias("q")).withColumn(
        "need", F.floor((PERCENT * F.col("q") + 99) / 100).cast("long"))
    return rows.alias("r").join(
        per.alias("p"), F.col("r.item_id").eqNullSafe(F.col("p.item_id"))).select(
            "r.*", "p.q", "p.need")


def sketches(shingles: DataFrame) -> DataFrame:
    """The smallest q - need + 1 hashes of every item, with its size partition."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("hash", "shingle"))
    return (shingles.withColumn("rank", rank)
            .where(F.col("rank") <= F.col("q") - F.col("need") + 1)
            .select("item_id", "hash", "need",
                    F.floor(F.log2("q")).cast("int").alias("partition")))


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(digest, item_id) of texts that hold a hash of an item's sketch. ``docs``: (t)."""
    levels = sketch.groupBy("partition").agg(
        F.min("need").alias("need"), F.max("hash").alias("limit"))
    levels = levels.agg(F.collect_list(F.struct("need", "limit")).alias("levels"))
    df = once(hashed(docs, "t"), n=F.size("sh")).crossJoin(F.broadcast(levels))
    limit = F.array_max(F.transform(
        F.filter("levels", lambda p: p["need"] <= F.col("n")), lambda p: p["limit"]))
    df = once(df, limit=limit, digest=F.md5("t"))
    rows = df.select("digest", "n", F.explode(F.filter(
        "sh", lambda h: h <= F.col("limit"))).alias("hash"))
    return (rows.join(if_small(sketch.select("hash", "item_id", "need")), "hash")
            .where(F.col("need") <= F.col("n")).select("digest", "item_id").distinct())


def leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(digest, item_id, shared, item_shingles) of every text that contains an item.

    Shuffled are the hits of sketches and, for texts with a hit, their shingles' matches.
    """
    shingles = materialize(item_shingles(items), "leak-shingles")
    sketch = materialize(sketches(shingles), "leak-sketches")
    texts = docs.select(or_empty(text).alias("t"))
    found = materialize(candidates(texts, sketch), "leak-candidates")
    held = texts.withColumn("digest", F.md5("t")).join(
        if_small(found.select("digest").distinct()), "digest", "left_semi").dropDuplicates(["digest"])
    counted = (spelled(held, "t").select("digest", "shingle")
               .join(if_small(shingles.select("item_id", "shingle", "q", "need")), "shingle")
               .groupBy("digest", "item_id", "q", "need").agg(F.count("*").alias("shared"))
               .where(F.col("shared") >= F.col("need")))
    sure = counted.alias("c").join(
        found.alias("f"), (F.col("c.digest") == F.col("f.digest"))
        & F.col("c.item_id").eqNullSafe(F.col("f.item_id")), "left_semi")
    return materialize(sure.select("digest", "item_id", "shared", F.col("q").alias("item_shingles")),
                       "leaks")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and benchmark item that it contains."""
    rows = docs.select("doc_id", F.md5(or_empty("text")).alias("digest"))
    return rows.join(if_small(leaks(docs, items)), "digest").select(
        "doc_id", "item_id", "shared", "item_shingles")


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no item, with their own columns."""
    rows = packed(docs).withColumn("digest", F.md5(or_empty(F.col("row")[text])))
    bad = leaks(docs, items, text).select("digest").distinct()
    return unpacked(rows.join(if_small(bad), "digest", "left_anti"), docs)
