"""Connected components of verified links, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.tables import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it is joined to.

    Distributed union-find: each round hooks a node's root under the smallest root
    among its neighbours and then halves paths by looking up each root's root. Every
    table that a round reads is written to the shared folder, so lineage stays short,
    and both sides of every join are plain exchanges that adaptive execution can
    split where one root holds many nodes. Ends when a round changes nothing.
    """
    edges = tables.put(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(), "links")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = tables.put(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("label")), "roots")
    total = None
    while True:
        # Halve paths: a root's own root is at least as small.
        up = roots.select(F.col("node").alias("label"), F.col("label").alias("up"))
        roots = tables.put(roots.join(up, "label").select("node", F.col("up").alias("label")),
                            "roots")
        now = roots.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if now == total:
            return roots
        # Hook: the smallest root next to any node of a tree becomes its root's root.
        near = both.join(roots.select(F.col("node").alias("a"), F.col("label").alias("ra")), "a").join(
            roots.select(F.col("node").alias("b"), F.col("label").alias("rb")), "b")
        hooks = (near.where("rb < ra").groupBy(F.col("ra").alias("node"))
                 .agg(F.min("rb").alias("hook")))
        hooks = tables.put(hooks, "hooks")
        total = now
        roots = tables.put(roots.join(hooks, "node", "left").select(
            "node", F.least("label", F.coalesce("hook", "label")).alias("label")), "roots")
