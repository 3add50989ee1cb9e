"""MinHash near-dedup with tensored banding, verified on full shingle sets.

A document's set is its distinct three-word shingles. ``COLLECTIONS`` small collections
of ``ROWS`` minhashes each are computed once; every pair of collections forms one table
key, so 91 keys come from 42 minhashes where plain banding needs 546. At the lowest
linked similarity (0.85) two documents miss each other with probability 4e-5.

Exact copies are one class before anything else. Keys shared by up to ``FEW`` classes
give all their pairs. Classes under larger keys are left to an exact search that needs
no list of a group's pairs: in the order of rarest shingle first, two sets that reach
the similarity share a shingle within a short prefix; each prefix group is first linked
to its least edited member, and only pairs of different components remain to compare.

Null texts and texts without words have an empty set and are linked with nothing. Fewer
than three words are one shingle. Null ids take part; a component's id is its smallest
id, null if none has one. Repeated rows are copies.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyguard.llm.components import components
from tallyguard.llm.decontaminate import if_small
from tallyguard.llm.tables import Tables
from tallyguard.llm.text import in_pieces, or_empty, packed



@dataclass(frozen=True)
class Likeness:
    """When two texts are near copies: shingles of ``words`` words, sets ``percent`` alike."""
    words: int = 3
    percent: int = 85


#: Five words and 0.8, as a stage on word shingles takes them. A pair at 0.8 is missed by
#: the fourteen collections in 7 of 10,000 cases, one at 0.85 in 4 of 100,000.
FIVE_WORDS = Likeness(5, 80)
COLLECTIONS = 14
ROWS = 3
FEW = 24
#: Ids of classes whose rows all lack an id lie above this.
NO_ID = 1 << 62
CACHED_WORDS = 1 << 19
CACHED_SETS = 64

_rng = np.random.default_rng(8)
_A = _rng.integers(0, 1 << 63, size=COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, size=COLLECTIONS * ROWS, dtype=np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, known: dict[bytes, int], width: int = Likeness.words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. ``known`` caches word hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(known) > CACHED_WORDS:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    h = np.array(out, dtype=np.uint64)
    size = min(len(h), width)
    if not size:
        return h
    mixed = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = _stir(mixed * _MIX[0] + h[k:len(h) - size + 1 + k])
    return np.unique(mixed)


def signature(sh: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """One hash per collection of minhashes."""
    mins = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(sh), at_once):
        part = sh[i:i + at_once, None] * _A + _B
        mins = np.minimum(mins, part.min(axis=0))
    out = np.zeros(COLLECTIONS, dtype=np.uint64)
    for row in mins.reshape(COLLECTIONS, ROWS).T:
        out = _stir(out * _MIX[0] + row)
    return out


def _sign(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """Appends n and sig; the text (column t) is dropped."""
    known: dict[bytes, int] = {}
    for batch in in_pieces(batches, text=0):
        n, sig = [], []
        for text in batch.column(0):
            sh = shingles(text.as_py(), known, like.words)
            n.append(len(sh))
            sig.append(signature(sh).view(np.int64) if len(sh) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
            [*batch.schema.names[1:], "n", "sig"])


def _close(n: np.ndarray, m: np.ndarray, like: Likeness) -> np.ndarray:
    """Whether set sizes allow a link."""
    return 100 * np.minimum(n, m) >= like.percent * np.maximum(n, m)


def _runs(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple]:
    """Column arrays cut at changes of the first column, with the sizes of the runs per row.

    Rows come sorted by it. A run longer than ``most`` is passed on in parts whose size
    reads as more than ``most``, so no run is held whole.
    """
    held, over = None, None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        size = np.repeat(np.diff(np.r_[starts, len(cols[0])]), np.diff(np.r_[starts, len(cols[0])]))
        if over is not None and cols[0][0] == over:
            size[:(starts[1] if len(starts) > 1 else len(size))] = most + 1
        cut = starts[-1]
        if most is not None and size[-1] > most:
            over, cut = cols[0][-1], len(size)
        if cut:
            yield [c[:cut] for c in cols], size[:cut]
        held = [c[cut:] for c in cols]
    if held is not None and len(held[0]):
        size = np.full(len(held[0]), len(held[0]))
        yield held, size


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(a) if a else [], pa.int64()),
         pa.array(np.concatenate(b) if b else [], pa.int64())], ["a", "b"])


def _few(batches: Iterator[pa.RecordBatch], like: Likeness = Likeness()) -> Iterator[pa.RecordBatch]:
    """(key, node, n) sorted by key to pairs of keys with few nodes; (node, -1) of others."""
    for (key, node, n), size in _runs(batches, FEW):
        a, b, few = [], [], size <= FEW
        for d in range(1, FEW):
            same = few[d:] & (key[d:] == key[:-d])
            if not same.any():
                break
            same &= _close(n[d:], n[:-d], like)
            x, y = node[:-d][same], node[d:][same]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
        many = np.unique(node[~few])
        yield _pairs([*a, many], [*b, np.full(len(many), -1)])


def _apart(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """(token, node, n, pos, label) sorted by token to pairs of different components.

    The overlap of two sets is at most the shared token and the shorter rest after it.
    """
    for (token, node, n, pos, label), size in _runs(batches, None):
        a, b, held = [], [], 0
        for i in range(len(token) - 1):
            end = i + 1 + np.searchsorted(token[i + 1:i + size[i]], token[i], side="right") \
                if size[i] > 1 else i + 1
            j = slice(i + 1, end)
            if end <= i + 1:
                continue
            most = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
            ok = ((label[j] != label[i]) & _close(n[j], n[i], like)
                  & (100 * most >= like.percent * (n[i] + n[j] - most)))
            other = node[j][ok]
            a.append(np.minimum(other, node[i]))
            b.append(np.maximum(other, node[i]))
            held += len(other)
            if held > 100_000:
                yield _pairs(a, b)
                a, b, held = [], [], 0
        yield _pairs(a, b)


def _linked(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """(a, b, ta, tb) to the pairs whose full sets are similar enough."""
    known: dict[bytes, int] = {}
    sets: OrderedDict[int, np.ndarray] = OrderedDict()

    def full(node: int, text: str) -> np.ndarray:
        if node in sets:
            sets.move_to_end(node)
        else:
            sets[node] = shingles(text, known, like.words)
            if len(sets) > CACHED_SETS:
                sets.popitem(last=False)
        return sets[node]

    for batch in in_pieces(batches, text=3):
        good = []
        for row in zip(*(c for c in batch.columns)):
            a, b = row[0].as_py(), row[1].as_py()
            x, y = full(a, row[2].as_py()), full(b, row[3].as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= like.percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _tokens(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """(node, t) to (node, token)."""
    known: dict[bytes, int] = {}
    for batch in in_pieces(batches, text=1):
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            sh = shingles(text.as_py(), known, like.words).view(np.int64)
            for i in range(0, len(sh), 1 << 16):
                part = sh[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), node)), pa.array(part)], ["node", "token"])


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full sets; ``texts``: (node, t)."""
    left = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(
        partial(_linked, like=like), "a long, b long")


def prefixes(texts: DataFrame, tables: Tables, like: Likeness) -> DataFrame:
    """(token, node, n, pos, rare): the rarest shingles of each set, as many as can matter.

    Of two linked sets each shares at least ``percent`` of itself with the other, say 85 %,
    so the first n - ceil(0.85 n) + 1 in any common order hold a shared one. ``rare`` counts those
    that nothing else has.
    """
    tokens = tables.put(texts.mapInArrow(
        partial(_tokens, like=like), "node long, token long"), "near-tokens")
    df = tables.put(tokens.groupBy("token").agg(F.count("*").alias("df")), "near-df")
    own = W.partitionBy("node")
    rows = tokens.join(df, "token").select(
        "token", "node", "df", F.count("*").over(own).alias("n"),
        (F.row_number().over(own.orderBy("df", "token")) - 1).cast("long").alias("pos"),
        F.count(F.when(F.col("df") == 1, 1)).over(own).alias("rare"))
    short = F.col("pos") <= F.col("n") - F.floor((like.percent * F.col("n") + 99) / 100)
    return rows.where(short & (F.col("df") > 1)).drop("df")


def _dense_links(texts: DataFrame, links: DataFrame, tables: Tables, like: Likeness) -> DataFrame:
    """All links among the classes of ``texts`` that components need."""
    pref = tables.put(prefixes(texts, tables, like), "near-prefixes")
    centre = tables.put(pref.groupBy("token").agg(
        F.min_by("node", F.struct("rare", "node")).alias("c")), "near-centres")
    star = (pref.join(centre, "token").where("node <> c")
            .select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct())
    first = tables.put(verified(star, texts, like), "near-stars")
    labels = components(links.union(first), tables)
    rest = (pref.join(labels, "node", "left")
            .select("token", "node", "n", "pos", F.coalesce("label", "node").alias("label")))
    rest = (rest.repartition(F.col("token")).sortWithinPartitions("token")
            .mapInArrow(partial(_apart, like=like), "a long, b long").distinct())
    return first.union(tables.put(verified(rest, texts, like), "near-rest"))


def classes(docs: DataFrame, text: str = "text", carry: list[str] | None = None,
            like: Likeness = Likeness()) -> DataFrame:
    """``row`` (input row, or its columns ``carry``), rid, doc_id, n, label per document.

    ``label`` is the smallest node of the component; a node is the smallest id among
    exact copies. Texts are shuffled only for classes with a candidate.
    """
    tables = Tables(docs.sparkSession)
    source = packed(docs).select(
        or_empty(F.col("row")[text]).alias("t"),
        F.struct(*[F.col("row")[c].alias(c) for c in carry or docs.columns]).alias("row"),
        F.col("row")["doc_id"].cast("long").alias("doc_id"))
    source = source.select("t", "row", "doc_id", F.md5("t").alias("digest"))
    kinds = T.StructType(source.schema.fields[1:]).add("n", T.LongType()).add(
        "sig", T.ArrayType(T.LongType()))
    signed = source.mapInArrow(partial(_sign, like=like), kinds)
    signed = tables.put(signed.withColumn("rid", F.monotonically_increasing_id()), "near-signed")
    lost = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("digest"), 2)
    nodes = tables.put(
        signed.where("n > 0").groupBy("digest").agg(
            F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .select("digest", F.coalesce("node", lost).alias("node"), "n", "sig"), "near-nodes")
    tensor = F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(COLLECTIONS - 2)), lambda i: F.transform(
            F.sequence(i + 1, F.lit(COLLECTIONS - 1)),
            lambda j: F.xxhash64(i, j, F.col("sig")[i], F.col("sig")[j]))))
    keyed = nodes.select(F.explode(tensor).alias("key"), "node", "n")
    found = tables.put(
        keyed.repartition(F.col("key")).sortWithinPartitions("key")
        .mapInArrow(partial(_few, like=like), "a long, b long").distinct(), "near-candidates")
    pairs, many = found.where("b >= 0"), found.where("b < 0").select(F.col("a").alias("node"))
    wanted = tables.put(
        pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(many).distinct()
        .join(nodes.select("node", "digest"), "node"), "near-wanted")
    texts = tables.put(
        source.select("t", "digest").join(if_small(wanted), "digest")
        .dropDuplicates(["digest"]).select("node", "t"), "near-texts")
    links = tables.put(verified(pairs, texts, like), "near-links")
    dense = texts.join(many, "node", "left_semi")
    if not many.isEmpty():
        links = links.union(_dense_links(dense, links, tables, like))
    labels = components(links, tables)
    named = tables.put(nodes.select("digest", "node").join(labels, "node", "left").select(
        "digest", F.coalesce("label", "node").alias("label")), "near-labels")
    tables.drop_all_but(signed, named)
    return signed.select("row", "rid", "doc_id", "n", "digest").join(named, "digest", "left")


def report(docs: DataFrame) -> DataFrame:
    """Set size, component and verdict per document."""
    rows = classes(docs.select("doc_id", "text"), carry=["doc_id"])
    component = F.when(F.col("label") < NO_ID, F.col("label")).when(
        F.col("label").isNull(), F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """One document of each component, the smallest id (of equal ids any), with its columns.

    Documents without words are all kept.
    """
    rows = classes(docs, text, like=like)
    first = rows.where("label is not null").groupBy("label").agg(
        F.min_by("rid", F.struct(F.coalesce("doc_id", F.lit(NO_ID)), "rid")).alias("rid"))
    kept = rows.join(first.select("rid"), "rid", "left_semi").unionByName(
        rows.where("label is null"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
