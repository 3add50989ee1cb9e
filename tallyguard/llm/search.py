"""Ranked lexical search: MaxScore whose bounds come from pairs of terms.

Documents are indexed in blocks. A block holds, for every term that is asked for, the
documents with their impact (what the term adds to a score) and the largest impact; and
for pairs of terms the intersection list with the largest joint impact of any document that
holds both. An item's terms are ordered by weight and its pairs are neighbours in that
order, so an item of n terms has n - 1 pairs.

At query time the bound of the first j terms is the least over all ways to cover them with
single terms and neighbouring pairs, where a pair counts

    max(joint maximum, maximum of either term alone),

which is at most the sum of the two maxima and mostly far below it, because hardly any
document has the best of both. Terms whose bound stays below the tenth best score are not
essential: documents that hold only those are never touched, and a block whose whole bound
stays below it is skipped. The other documents are completed term by term and leave as soon
as what is still open cannot lift them. Bounds only skip what cannot be in the result, so
the ranking is exact.

The score to beat starts at the tenth best among the documents of the short pair lists,
which are scored in a pass of their own; it rises further within a task. Items are searched
in rounds of bounded size, so that their terms fit in memory; documents are never collected.
A task holds one block at a time, whose size is bounded by rows and bytes of text.

Null texts have no terms, items without terms get no rows, and equal scores rank by
ascending doc_id, null last. Every row of documents or items counts for itself, repeated or
not; an empty table gives an empty result; other columns are not read; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyguard.llm.tables import Tables
from tallyguard.llm.text import in_pieces

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 16 << 20            # bytes of text in a block
ITEM_BYTES = 16 << 20       # bytes of item texts searched in one round
LONG_TEXT = 1 << 24         # from here on the terms of a text are not held as a list
#: A pair list keeps its documents if they are at most this part of the block: only such
#: lists are read for candidates. Of longer ones the joint maximum is kept.
SHORT = 16
_BLOCK = "ids array<long>, lengths array<long>, terms array<int>, ends array<int>, at array<int>"
_RAW = _BLOCK + ", tf array<long>"
_READY = _BLOCK + (", impact array<long>, pairs array<int>, joint array<long>, "
                   "pair_ends array<int>, pair_at array<int>")


def term_counts(text: str | None) -> Counter:
    """The terms of a text, only A-Z lowered, with their occurrences."""
    raw = (text or "").encode().lower()
    if len(raw) < LONG_TEXT:
        return Counter(TERM.findall(raw))
    return Counter(m.group() for m in TERM.finditer(raw))


def _rows(columns: dict[str, object], schema: str) -> pa.RecordBatch:
    """One row whose fields are whole arrays."""
    kinds = {"array<long>": pa.int64(), "array<int>": pa.int32()}
    names, fields = [], []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        values = columns[name]
        values = values.cast(kinds[kind]) if isinstance(values, pa.Array) else pa.array(values, kinds[kind])
        names.append(name)
        fields.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(fields, names)


def _index(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings of the vocabulary's terms, by term and document."""
    for batch in in_pieces(batches, limit=BLOCK):
        kept, lengths, terms, at, tf = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            counts = term_counts(text.as_py())
            if not counts:
                continue
            found = counts.keys() & vocabulary.keys()
            terms.extend(map(vocabulary.__getitem__, found))
            tf.extend(map(counts.__getitem__, found))
            at.extend([len(kept)] * len(found))
            kept.append(i)
            lengths.append(counts.total())
        if not kept:
            continue
        terms, at, tf = (np.array(x, dtype=np.int64) for x in (terms, at, tf))
        order = np.lexsort((at, terms))
        names, counts = np.unique(terms, return_counts=True)
        yield _rows({"ids": batch.column(0).take(pa.array(kept, pa.int64())), "lengths": lengths, "terms": names,
                     "ends": np.cumsum(counts), "at": at[order], "tf": tf[order]}, _RAW)


@dataclass
class Items:
    """Items of one round: their terms by number, lightest first, and their pairs."""
    weight: np.ndarray          # by term
    terms: list[np.ndarray]     # by item
    pairs: np.ndarray           # two terms each, sorted
    pair_of: list[np.ndarray]   # by item: its n - 1 pairs

    @classmethod
    def of(cls, weight: np.ndarray, asked: list[np.ndarray]) -> Items:
        terms = [t[np.lexsort((t, weight[t]))] for t in asked]
        size = np.int64(len(weight))
        codes = [np.minimum(t[1:], t[:-1]) * size + np.maximum(t[1:], t[:-1]) for t in terms]
        every = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        pairs = np.stack([every // size, every % size], axis=1) if size else np.zeros((0, 2), np.int64)
        return cls(weight, terms, pairs, [np.searchsorted(every, c) for c in codes])


@dataclass
class Corpus:
    """What scores need to know of all documents."""
    documents: int
    length: int


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    m = 10 + 90 * length * corpus.documents // max(corpus.length, 1)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def _column(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))[row].values


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return _column(batch, name, row).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _prepare(batches: Iterator[pa.RecordBatch], items: Items, corpus: Corpus) -> Iterator[pa.RecordBatch]:
    """Blocks with impacts, and with the pairs' intersection lists and joint maxima."""
    for batch in batches:
        for row in range(batch.num_rows):
            terms, ends, at, tf, lengths = (
                _array(batch, c, row) for c in ("terms", "ends", "at", "tf", "lengths"))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            impact = impacts(np.repeat(items.weight[terms], ends - starts), tf, lengths[at], corpus)
            place = np.full(len(items.weight), -1, dtype=np.int64)
            place[terms] = np.arange(len(terms))
            size = len(lengths)
            dense = np.zeros(size, dtype=np.int64)
            held, joint, pair_ends, pair_at, last = [], [], [], [], None
            for number in np.flatnonzero((place[items.pairs] >= 0).all(axis=1)):
                one, two = place[items.pairs[number]]
                if one != last:         # pairs come sorted by their first term
                    dense[:] = 0
                    dense[at[starts[one]:ends[one]]] = impact[starts[one]:ends[one]]
                    present = np.zeros(size, dtype=bool)
                    present[at[starts[one]:ends[one]]] = True
                    last = one
                other = at[starts[two]:ends[two]]
                both = present[other]
                if not both.any():
                    continue
                docs = other[both]
                held.append(number)
                joint.append(int((dense[docs] + impact[starts[two]:ends[two]][both]).max()))
                short = docs if len(docs) * SHORT <= size else docs[:0]
                pair_at.append(short)
                pair_ends.append(len(short))
            yield _rows({
                "ids": _column(batch, "ids", row), "lengths": lengths, "terms": terms, "ends": ends,
                "at": at, "impact": impact, "pairs": held, "joint": joint,
                "pair_ends": np.cumsum(np.array(pair_ends, dtype=np.int64)),
                "pair_at": np.concatenate([np.zeros(0, np.int64), *pair_at])}, _READY)


class Block:
    """One block in memory, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, row: int, items: Items):
        self.items, self.ids = items, _column(batch, "ids", row)
        self.key = self.ids.fill_null(2**63 - 1).to_numpy()
        terms, self.ends, self.at, self.impact, pairs, joint, self.pair_ends, self.pair_at = (
            _array(batch, c, row) for c in (
                "terms", "ends", "at", "impact", "pairs", "joint", "pair_ends", "pair_at"))
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.place = np.full(len(items.weight), -1, dtype=np.int64)
        self.place[terms] = np.arange(len(terms))
        self.most = np.zeros(len(items.weight), dtype=np.int64)
        if len(terms):
            self.most[terms] = np.maximum.reduceat(self.impact, self.starts)
        self.joint = np.zeros(len(items.pairs), dtype=np.int64)
        self.joint[pairs] = joint
        self.pair_place = np.full(len(items.pairs), -1, dtype=np.int64)
        self.pair_place[pairs] = np.arange(len(pairs))
        self.score = np.zeros(len(self.ids), dtype=np.int64)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        p = self.place[term]
        if p < 0:
            return self.at[:0], self.impact[:0]
        part = slice(self.starts[p], self.ends[p])
        return self.at[part], self.impact[part]

    def bounds(self, item: int) -> list[int]:
        """Largest possible score from the first j terms of an item, for every j."""
        most = self.most[self.items.terms[item]].tolist()
        joint = self.joint[self.items.pair_of[item]].tolist()
        least = [0]
        for j, alone in enumerate(most):
            bound = least[j] + alone
            if j:
                bound = min(bound, least[j - 1] + max(joint[j - 1], most[j - 1], alone))
            least.append(bound)
        return least

    def complete(self, item: int, docs: np.ndarray, upto: int, bounds: list[int],
                 beat: int) -> np.ndarray:
        """Adds the first ``upto`` terms, heaviest first; who cannot reach ``beat`` leaves."""
        for j in range(upto, 0, -1):
            docs = docs[self.score[docs] + bounds[j] >= beat]
            if not len(docs):
                break
            at, impact = self.postings(self.items.terms[item][j - 1])
            if len(at):
                where = np.searchsorted(at, docs)
                where[where == len(at)] = 0
                self.score[docs] += np.where(at[where] == docs, impact[where], 0)
        return docs

    def best(self, item: int, docs: np.ndarray, beat: int, limit: int) -> list[tuple]:
        """The ``limit`` best of ``docs`` with at least ``beat``: (score, key, document)."""
        docs = docs[self.score[docs] >= max(beat, 1)]
        order = np.lexsort((self.key[docs], -self.score[docs]))[:limit]
        return [(int(self.score[d]), int(self.key[d]), self.ids[int(d)].as_py()) for d in docs[order]]

    def seed(self, item: int, limit: int) -> list[tuple]:
        """The best among documents of the item's short pair lists, fully scored."""
        lists = []
        for p in self.pair_place[self.items.pair_of[item]]:
            if p >= 0:
                lists.append(self.pair_at[self.pair_ends[p - 1] if p else 0:self.pair_ends[p]])
        docs = np.unique(np.concatenate([self.pair_at[:0], *lists]))
        self.score[docs] = 0
        docs = self.complete(item, docs, len(self.items.terms[item]), self.bounds(item), 0)
        return self.best(item, docs, 0, limit)

    def search(self, item: int, beat: int, limit: int) -> list[tuple]:
        """The documents that may be among the item's best, given that ``beat`` is reached."""
        terms, bounds = self.items.terms[item], self.bounds(item)
        if bounds[-1] < max(beat, 1):
            return []
        idle = 0                # the first terms, which alone reach too little
        while bounds[idle + 1] < max(beat, 1):
            idle += 1
        self.score[:] = 0
        for term in terms[idle:]:
            at, impact = self.postings(term)
            self.score[at] += impact
        docs = np.flatnonzero(self.score) if idle else np.arange(len(self.score))
        docs = self.complete(item, docs, idle, bounds, beat)
        return self.best(item, docs, beat, limit)


def _search(batches: Iterator[pa.RecordBatch], items: Items, beat: np.ndarray | None,
            limit: int) -> Iterator[pa.RecordBatch]:
    """The best of each item among the blocks of a task; without ``beat``, of the pair lists."""
    found: list[list[tuple]] = [[] for _ in items.terms]
    for batch in batches:
        for row in range(batch.num_rows):
            block = Block(batch, row, items)
            for item, had in enumerate(found):
                if beat is None:
                    more = block.seed(item, limit)
                else:
                    own = had[limit - 1][0] if len(had) == limit else 0
                    more = block.search(item, max(own, int(beat[item])), limit)
                if more:
                    found[item] = sorted(had + more, key=lambda x: (-x[0], x[1]))[:limit]
    rows = [(i, d, s) for i, some in enumerate(found) for s, _, d in some]
    if rows:
        item, doc, score = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
            ["item", "doc_id", "score"])


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _round(docs: DataFrame, asked: list, limit: int) -> DataFrame:
    """Ranked (item, doc_id, score, rank) for the items ``asked``; item is their position."""
    spark = docs.sparkSession
    tables = Tables(spark)
    counts = [term_counts(row.text) for row in asked]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    raw = tables.put(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        partial(_index, vocabulary=vocabulary), _RAW), "search-index")
    size = raw.select(F.size("ids").alias("n"), F.aggregate(
        "lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    corpus = Corpus(size[0] or 0, size[1] or 0)
    # Documents per term; at most as many rows as the round's items have terms.
    held = raw.select(F.posexplode("terms").alias("i", "term"), "ends").select("term", (
        F.get("ends", F.col("i")) - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))).alias("n"))
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in held.groupBy("term").agg(F.sum("n").alias("n")).toArrow().to_pandas().itertuples(index=False):
        df[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * corpus.documents + 2) / (2 * int(n) + 1)))
                       for n in df], dtype=np.int64)
    items = Items.of(weight, [np.array(sorted(vocabulary[t] for t in c), dtype=np.int64) for c in counts])
    ready = tables.put(raw.mapInArrow(partial(_prepare, items=items, corpus=corpus), _READY),
                       "search-blocks")
    tables.drop_all_but(ready)
    schema = "item int, doc_id long, score long"
    seeds = ready.mapInArrow(partial(_search, items=items, beat=None, limit=limit), schema)
    beat = np.zeros(len(asked), dtype=np.int64)
    for row in _ranked(seeds, limit).where(F.col("rank") == limit).collect():
        beat[row["item"]] = row["score"]
    hits = ready.mapInArrow(partial(_search, items=items, beat=beat, limit=limit), schema)
    best = tables.put(_ranked(hits, limit), "search-hits")
    tables.drop_all_but(best)
    names = spark.createDataFrame([(i, row["item_id"], row["copies"]) for i, row in enumerate(asked)],
                                  "item int, item_id long, copies long")
    # An item that is there n times has its results n times.
    return best.join(names, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def search(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` best documents (doc_id, text) of each
    item (item_id, text), best first; documents that score 0 are no result."""
    # Equal rows are one item with a number, so that no round holds a hot one many times.
    asked = items.selectExpr("cast(item_id as long) item_id", "text").groupBy("item_id", "text").agg(
        F.count("*").alias("copies"))
    rounds = (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES + 1
    found = None
    for number in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == number).collect()
        part = _round(docs, some, limit)
        found = part if found is None else found.unionByName(part)
    return found
