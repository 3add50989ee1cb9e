"""Phrase collocations: Misra-Gries summaries find the frequent n-grams, a second pass counts.

The n-grams of one order are dealt by a hash into partitions. Each partition is summarised
with more counters than its mass divided by the threshold, so the summary's error stays
below the threshold and no frequent n-gram can be missing; infrequent ones may remain. A
second pass over the texts counts exactly what survived, by text and not by hash, and drops
what is rarer than the threshold. Memory follows the capacity, not the number of distinct
n-grams, and the number of partitions follows the input.

Three things keep the shuffles small. Each run of texts (about eight megabytes) counts its
own n-grams first. What a run holds as often as the threshold is frequent already: it
survives outright and adds nothing to the mass, so a hot phrase weighs at most the threshold
times the number of runs. And orders go one after the other: an n-gram is only looked at
if both n-grams of one word less that it consists of survived. Survivors travel to the
tasks as a bit filter of bounded size; where it lets others pass, more is counted, and the
answer is the same.

A null text is read as empty, a null language as ``und``; repeated rows count again, an
empty table gives no phrases, and further columns are not read. A text longer than a run is
cut at blanks and the words before a cut are carried over it, so no n-gram is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyguard.llm.tables import Tables
from tallyguard.llm.text import in_pieces

RUN = 8 << 20               # bytes of text counted together in a task
CAPACITY = 1 << 18          # counters of a summary that its partition is laid out for
FILTER_BITS = 29            # the largest filter has 2**29 bits, 64 megabytes
_PARTIAL = "part int, item boolean, hash long, n int"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Lower case, blanks for tabs, and a full stop for every break: no word holds one.
_PLAIN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(_BREAKS))


class _Numbers(dict):
    """Numbers words in the order they come; 0 is the break between pieces."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


@dataclass
class Run:
    """Numbered words of one language with breaks between pieces.

    The first ``skip`` words were counted in the run before; an n-gram that ends among
    them is not counted again.
    """
    lang: str
    tokens: np.ndarray
    words: list[bytes]
    skip: int = 0


def read_run(lang: str, raw: bytes, carried: list[bytes]) -> Run:
    numbers = _Numbers({b".": 0})
    words = raw.translate(_PLAIN).replace(b".", b" . ").split()
    words[:0] = carried
    tokens = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return Run(lang, tokens, list(numbers), len(carried))


def runs(batches: Iterator[pa.RecordBatch], longest: int, limit: int = RUN) -> Iterator[Run]:
    """Runs of (lang, text) batches for n-grams of up to ``longest`` words."""
    for batch in in_pieces(batches, limit=limit):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append((text or "").encode())
        for lang, texts in by_lang.items():
            raw, start, carried = b"\n".join(texts), 0, []
            while start < len(raw):
                stop = len(raw)
                if stop - start > 2 * limit:    # only a single text can be so long
                    # Cutting behind a blank or break leaves every word whole.
                    stop = start + limit
                    while stop < len(raw) and raw[stop - 1:stop].translate(_PLAIN) not in (b" ", b"."):
                        stop += 1
                run = read_run(lang, raw[start:stop], carried)
                yield run
                tail = run.tokens[-(longest - 1):] if longest > 1 else run.tokens[:0]
                ends = np.flatnonzero(tail == 0)
                carried = [run.words[t] for t in (tail[ends[-1] + 1:] if len(ends) else tail)]
                start = stop


@dataclass
class BitFilter:
    """Two bits for each hash it holds; says yes to all of them and to a few others."""
    bits: np.ndarray
    log2: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.log2) - 1)
        yes = np.ones(len(hashes), dtype=bool)
        for at in (hashes & mask, (hashes >> np.uint64(32)) & mask):
            yes &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return yes


def bit_filter(hashes: DataFrame) -> BitFilter:
    """The filter of the long column ``hash``: aggregated by Spark, bounded in size."""
    log2 = min(FILTER_BITS, max(16, (16 * hashes.count()).bit_length()))
    mask = F.lit((1 << log2) - 1)
    places = F.array(F.col("hash").bitwiseAND(mask),
                     F.shiftrightunsigned("hash", 32).bitwiseAND(mask))
    placed = hashes.select(F.explode(places).alias("at"))
    words = placed.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return BitFilter(bits, log2)


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its beginning and its last word."""
    h = left * np.uint64(0x9E3779B97F4A7C15) + right
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def live(run: Run, orders: int, filters: list[BitFilter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order by order: the positions where an n-gram starts that may be frequent, and its hash.

    It passes the filter of its order, where there is one, and so do all n-grams in it.
    """
    tokens = run.tokens
    seed = xxhash.xxh3_64_intdigest(run.lang.encode())
    word = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in run.words), np.uint64, len(run.words))
    real = np.arange(len(word)) > 0
    if filters:
        real &= filters[0].has(word)
    starts, hashes = real[tokens], word[tokens]
    yield 1, np.flatnonzero(starts), hashes
    for order in range(2, orders + 1):
        starts = starts[:-1] & starts[1:]
        at = np.flatnonzero(starts)
        longer = np.zeros(len(starts), dtype=np.uint64)
        longer[at] = _mixed(hashes[at], word[tokens[at + order - 1]])
        if order <= len(filters):
            passed = filters[order - 1].has(longer[at])
            starts[at[~passed]] = False
            at = at[passed]
        hashes = longer
        yield order, at, hashes


@dataclass
class Grams:
    """Distinct n-grams of one order in a run: count, and where each comes first."""
    order: int
    counts: np.ndarray
    first: np.ndarray


def grams(run: Run, orders: int, filters: list[BitFilter]) -> Iterator[Grams]:
    """The n-grams of order 1 to ``orders`` that may be frequent, told apart by their words.

    An n-gram is numbered from the number of its beginning and its last word, so equal
    numbers mean equal words and hashes decide nothing.
    """
    number = run.tokens
    for order, at, _ in live(run, orders, filters):
        codes = number[at] * len(run.words) + run.tokens[at + order - 1] if order > 1 else number[at]
        _, first, which = np.unique(codes, return_index=True, return_inverse=True)
        counts = np.bincount(which[at + order > run.skip], minlength=len(first))
        number = np.zeros(len(run.tokens), dtype=np.int64)
        number[at] = which
        yield Grams(order, counts[counts > 0], at[first][counts > 0])


def _partials(batches: Iterator[pa.RecordBatch], order: int, filters: list[BitFilter],
              parts: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Counts of one order per run, and before them the mass they add to each partition."""
    names = [f.split()[0] for f in _PARTIAL.split(", ")]
    for run in runs(batches, order):
        *_, (_, at, hashes) = live(run, order, filters)
        found, counts = np.unique(hashes[at[at + order > run.skip]], return_counts=True)
        part = (found % np.uint64(parts)).astype(np.int32)
        light = counts < threshold
        mass = np.bincount(part[light], weights=counts[light], minlength=1)
        heavy = np.flatnonzero(mass)
        columns = (np.concatenate([heavy.astype(np.int32), part]),
                   np.arange(len(heavy) + len(part)) >= len(heavy),
                   np.concatenate([np.zeros(len(heavy), np.int64), found.view(np.int64)]),
                   np.concatenate([mass[heavy], counts]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


class Summary:
    """Mergeable Misra-Gries counters: a count is too low by at most ``error``.

    ``error`` times (capacity + 1) never exceeds the mass that was added.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.error = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        keys, counts = keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts
        self.error += error
        over = len(keys) - self.capacity
        if over > 0:        # subtract the largest count that has no counter of its own
            least = np.partition(counts, over - 1)[over - 1]
            keys, counts = keys[counts > least], counts[counts > least] - least
            self.error += int(least)
        self.keys, self.counts = keys, counts

    def merge(self, other: Summary) -> None:
        self.add(other.keys, other.counts, other.error)

    def at_least(self, threshold: int) -> np.ndarray:
        """Every key whose true count may reach ``threshold``."""
        return self.keys[self.counts + self.error >= threshold]


class _Partition:
    """Survivors of one partition: mass first, then its counts in any order."""

    def __init__(self, threshold: int):
        self.threshold, self.mass, self.held = threshold, 0, 0
        self.sure = np.zeros(0, dtype=np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.summary: Summary | None = None

    def add(self, item: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.mass += int(counts[~item].sum())
        sure = item & (counts >= self.threshold)
        self.sure = np.union1d(self.sure, keys[sure])
        light = item & ~sure
        if light.any():
            if self.summary is None:
                self.summary = Summary(self.mass // self.threshold + 1)
            self.waiting.append((keys[light], counts[light].astype(np.int64)))
            self.held += int(light.sum())
            if self.held >= self.summary.capacity:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            keys, counts = zip(*self.waiting)
            self.summary.add(np.concatenate(keys), np.concatenate(counts))
            self.waiting, self.held = [], 0

    def survivors(self) -> np.ndarray:
        self.flush()
        maybe = self.summary.at_least(self.threshold) if self.summary else self.sure[:0]
        return np.union1d(self.sure, maybe)


def _survivors(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Hashes that may be frequent, from rows sorted by partition, masses first."""
    current, part = None, _Partition(threshold)

    def out(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(hashes):
            yield pa.RecordBatch.from_arrays([pa.array(hashes)], ["hash"])

    for batch in batches:
        parts, item, keys, counts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1), len(parts)]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            if parts[start] != current:
                yield from out(part.survivors())
                current, part = parts[start], _Partition(threshold)
            part.add(item[start:stop], keys[start:stop], counts[start:stop])
    yield from out(part.survivors())


def _exact(batches: Iterator[pa.RecordBatch], filters: list[BitFilter]) -> Iterator[pa.RecordBatch]:
    """Texts and counts of the n-grams that pass the filters, and the number of words."""
    for run in runs(batches, len(filters)):
        spent = np.count_nonzero(run.tokens[run.skip:])
        yield _counted(run.lang, 0, [b""], np.array([spent]))
        for found in grams(run, len(filters), filters):
            order, words = found.order, run.words
            texts = [b" ".join([words[t] for t in some]) for some in
                     np.stack([run.tokens[found.first + i] for i in range(order)], axis=1).tolist()]
            yield _counted(run.lang, order, texts, found.counts)


def _counted(lang: str, order: int, texts: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang), len(texts)), pa.repeat(pa.scalar(order, pa.int32()), len(texts)),
         pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))],
        ["lang", "words", "phrase", "n"])


def count_frequent(docs: DataFrame, tables: Tables, longest: int, threshold: int) -> DataFrame:
    """Written table (lang, words, phrase, n): every n-gram of up to ``longest`` words that
    occurs ``threshold`` times in its language, and the words of each language as order 0."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A text of b bytes has at most b / 2 + 1 words.
    parts = size // (2 * threshold * CAPACITY) + 1
    filters: list[BitFilter] = []
    for order in range(1, longest + 1):
        partials = rows.mapInArrow(partial(
            _partials, order=order, filters=filters, parts=parts, threshold=threshold), _PARTIAL)
        dealt = partials.repartition("part").sortWithinPartitions("part", "item")
        left = tables.put(dealt.mapInArrow(partial(_survivors, threshold=threshold), "hash long"),
                          f"phrases-{order}")
        filters = [*filters, bit_filter(left)]
    counted = rows.mapInArrow(partial(_exact, filters=filters),
                              "lang string, words int, phrase string, n long")
    total = counted.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    kept = tables.put(total.where(f"n >= {threshold} OR words = 0"), "phrases-counted")
    tables.drop_all_but(kept)
    return kept


def collocations(docs: DataFrame, *, longest: int = 3, threshold: int = 10, share: int = 50,
                 limit: int = 2000) -> DataFrame:
    """Each language's best phrases of two to ``longest`` words from (lang, text).

    A candidate's score is that of its worst cut; it goes if a longer candidate around it
    is at least ``share`` percent as frequent. Every language's first ``limit`` are ranked.
    """
    spark = docs.sparkSession
    counts = count_frequent(docs, Tables(spark), longest, threshold)
    phrases = counts.where("words >= 2").select(
        "lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    parts = counts.where("words >= 1").select("lang", "phrase", "n")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(
        F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)),
                         ["lang", side])
    # Whole numbers of up to 38 digits: 1,000,000 a a fits for counts up to 10**16.
    score = F.expr("(cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * cast(1000000 as decimal(7,0)))"
                   " div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    around = phrases.where("words > 2").select("lang", "w", "words", F.col("a").alias("longer"))
    inner = around.select("lang", "w", "words", "longer", F.explode(
        F.sequence(F.lit(2), F.col("words") - 1)).alias("size")).select(
        "lang", "w", "size", "longer",
        F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    covered = inner.select("lang", F.array_join(F.slice("w", F.col("start"), F.col("size")), " ").alias("phrase"),
                           "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(covered, ["lang", "phrase"], "left").where(
        f"longer IS NULL OR 100 * longer < {share} * a")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    first = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    words = counts.where("words = 0").select("lang", "n")
    return first.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
