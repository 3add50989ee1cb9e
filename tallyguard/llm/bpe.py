"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap of merges.

A text is cut by a pattern; each match (pre-token) is encoded by itself. First tier: a
minimal perfect hash puts the n vocabulary entries on n slots, so one probe and one
comparison tell whether a pre-token is an entry. Second tier, for misses: the bytes form a
linked list and a heap holds the ranks of neighbouring pairs, so a pre-token of n bytes
takes O(n log n) whatever its length; stale heap entries are recognised and skipped. The
lowest rank merges first, the leftmost of equal ranks before the others.

Which code points count as letters or digits depends on the Unicode version of the engine
that applies the pattern. The ids shall be those of tiktoken, so code points that its engine
classes otherwise than the engine here are matched through a stand-in of the right class.

The hash is built once where the query is planned (its size is that of the vocabulary
file) and travels with the tasks. A null text is read as empty; an empty text has no
tokens. Every row gives one row, repeated or not, and an empty table an empty one; columns
other than doc_id and text are not read. Texts are never cut, long ones are matched piece
by piece so that their pre-tokens are not held at once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.text import in_pieces

#: Pre-tokens a worker remembers (about 150 bytes each), and the longest that is worth it.
MEMO, MEMO_CHARS = 800_000, 64
#: Texts from this many characters on are matched one pre-token at a time.
LONG_TEXT = 1 << 20

#: The classes that patterns name, each with a code point that all versions class so; the
#: last stands for none of them.
CLASSES = {r"\p{L}": "\u00e9", r"\p{N}": "\u00bd", r"\s": "\u00a0", "": "\u00bf"}


@cache
def stand_ins() -> dict[int, str]:
    """Code points whose class tiktoken's engine knows otherwise, with a stand-in of its class."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    theirs: dict[str, str] = {}
    ours: dict[str, str] = {}
    for name in filter(None, CLASSES):
        engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(engine.encode_ordinary(every)).decode(), name)
        ours |= dict.fromkeys(regex.findall(name, every), name)
    return {ord(c): CLASSES[theirs.get(c, "")] for c in theirs.keys() | ours.keys()
            if theirs.get(c) != ours.get(c)}


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys on the slots 0 to n - 1.

    Keys fall into n / 2 buckets; the fullest buckets first, each gets the least seed that
    sends all its keys to free slots. A bucket of one key names its slot instead, as a
    negative number, which fills the last slots without a search.
    """

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        groups: list[list[bytes]] = [[] for _ in range(max(1, self.size // 2))]
        for key in keys:
            groups[xxhash.xxh3_64_intdigest(key) % len(groups)].append(key)
        self.seeds = [0] * len(groups)
        free = bytearray(b"\1" * self.size)
        by_size = sorted(range(len(groups)), key=lambda g: -len(groups[g]))
        singles = [g for g in by_size if len(groups[g]) == 1]
        for g in by_size:
            if len(groups[g]) < 2:
                break
            seed = 1
            while True:
                slots = {xxhash.xxh3_64_intdigest(k, seed) % self.size for k in groups[g]}
                if len(slots) == len(groups[g]) and all(free[s] for s in slots):
                    break
                seed += 1
            self.seeds[g] = seed
            for s in slots:
                free[s] = 0
        open_slots = (s for s in range(self.size) if free[s])
        for g in singles:
            self.seeds[g] = -1 - next(open_slots)

    def slot(self, key: bytes) -> int:
        """The slot of ``key``; some slot for a string that is no key."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % len(self.seeds)]
        return -1 - seed if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.size


@dataclass
class Vocabulary:
    """Ranks of byte strings with the pattern that cuts texts."""
    ranks: dict[bytes, int]
    pattern: str
    _slots: PerfectHash = field(init=False)
    _keys: list[bytes] = field(init=False)
    _ids: list[int] = field(init=False)
    longest: int = field(init=False)
    fingerprint: str = field(init=False)

    def __post_init__(self):
        if len(set(self.ranks.values())) != len(self.ranks):
            raise ValueError("two entries share a rank")
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"no entry for the single bytes {missing}")
        if not all(self.ranks):
            raise ValueError("an entry is empty")
        self._slots = PerfectHash(list(self.ranks))
        self._keys, self._ids = [b""] * len(self.ranks), [0] * len(self.ranks)
        for key, rank in self.ranks.items():
            slot = self._slots.slot(key)
            self._keys[slot], self._ids[slot] = key, rank
        self.longest = max(map(len, self.ranks))
        said = repr((sorted(self.ranks.items()), self.pattern)).encode()
        self.fingerprint = hashlib.sha256(said).hexdigest()
        self._stand_ins = stand_ins()
        least = chr(min(self._stand_ins, default=0x10FFFF))
        self._strange = re.compile(f"[{least}-\U0010ffff]")

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Vocabulary:
        """Reads lines of a base-64 byte string, a blank and its rank."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def rank(self, piece: bytes) -> int | None:
        slot = self._slots.slot(piece)
        return self._ids[slot] if self._keys[slot] == piece else None

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.rank(piece) if len(piece) <= self.longest else None
        return [whole] if whole is not None else merged(piece, self.ranks)

    def pieces(self, text: str) -> Iterable[str]:
        """The pre-tokens in order."""
        cut = regex.compile(self.pattern)
        if not text.isascii() and self._strange.search(text):
            return (text[m.start():m.end()] for m in cut.finditer(text.translate(self._stand_ins)))
        return cut.findall(text) if len(text) < LONG_TEXT else (m.group() for m in cut.finditer(text))

    def bytes_by_id(self) -> dict[int, bytes]:
        return dict(zip(self._ids, self._keys))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges neighbours of lowest rank, leftmost first, until no pair is an entry.

    A heap entry is one number made of rank, start and end of the merged part, so that its
    order is the order of merging.
    """
    size = len(piece)
    bits = size.bit_length()
    low, high = (1 << bits) - 1, 2 * bits
    stop = [*range(1, size + 1), 0]         # where the part that starts here ends; 0: no start
    before = [-1, *range(size)]             # start of the part before
    rank, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [r << high | i << bits | i + 2 for i in range(size - 1)
            if (r := rank(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = pop(heap)
        start, end = entry >> bits & low, entry & low
        middle = stop[start]
        if not middle or stop[middle] != end:
            continue                        # one of the two was merged since
        stop[start], stop[middle] = end, 0
        if end < size:
            before[end] = start
            after = stop[end]
            if (r := rank(piece[start:after])) is not None:
                push(heap, r << high | start << bits | after)
        if start:
            left = before[start]
            if (r := rank(piece[left:end])) is not None:
                push(heap, r << high | left << bits | end)
    ids, start = [], 0
    while start < size:
        ids.append(ranks[piece[start:stop[start]]])
        start = stop[start]
    return ids


class _Memo(dict):
    """Packed ids of the pre-tokens met lately, in two generations.

    When the younger one is full it becomes the older one; what is met again comes back.
    """

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.vocabulary.encode_piece(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: What this worker remembers of the vocabulary it used last; its next task goes on with it.
_LAST: list[_Memo] = []


def _memo(vocabulary: Vocabulary) -> _Memo:
    if not _LAST or _LAST[0].vocabulary.fingerprint != vocabulary.fingerprint:
        _LAST[:] = [_Memo(vocabulary)]
    return _LAST[0]


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    memo = _memo(vocabulary)
    for batch in in_pieces(batches):
        texts = [b"".join(map(memo.__getitem__, vocabulary.pieces(text.as_py() or "")))
                 for text in batch.column(1)]
        ends = np.cumsum([0, *map(len, texts)]) // array("i").itemsize
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(texts), dtype=np.int32)))],
            ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    token = vocabulary.bytes_by_id()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [b"".join(map(token.__getitem__, ids.values.to_numpy().tolist()))
                     if ids.is_valid else None for ids in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text). Narrow: no shuffle."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        partial(_encode, vocabulary=vocabulary), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): the bytes that the ids stand for.

    Null ids decode to null; an id outside the vocabulary is an error.
    """
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decode, vocabulary=vocabulary), "doc_id long, ids array<int>, decoded binary")


def report(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Counts and digests of the ids of every document and of the text they decode to."""
    return decode(encode(docs, vocabulary), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
