"""Byte-level BPE against the library that publishes the format."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = {bytes([b]): b for b in range(256)} | {
    b"aa": 256, b"ab": 257, b"ba": 258, b"aab": 259, b"aaaa": 260, b"abab": 261, b"bab": 262}
PIECES = st.sampled_from([
    "the", " the", "'s", "'re", "  ", "\n\n", "\t", " \n ", "straße", "ción", "é", "é", "日本語",
    " 123456", "½", "Ⅻ", "…", "!!", "a" * 70, "\x00", "\x1c", "\x85", " ", " ", "﻿", "😀",
    "<|endoftext|>", "ſ", "ǅ", "\U00016d40", "\U0001f1e6", "_", "x"])


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids(vocabulary, text):
    return [i for piece in vocabulary.pieces(text) for i in vocabulary.encode_piece(piece.encode())]


@settings(max_examples=500, deadline=None)
@given(text=st.one_of(st.lists(PIECES, max_size=25).map("".join), st.text(max_size=60)))
def test_equals_the_library(vocabulary, library, text):
    assert ids(vocabulary, text) == library.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(piece=st.text(alphabet="ab", min_size=1, max_size=40))
def test_merge_order_on_a_crowded_vocabulary(piece):
    plain = bpe.Vocabulary(SMALL, public_tokenizers.PATTERN)
    assert plain.encode_piece(piece.encode()) == naive(piece.encode(), SMALL)


def naive(piece, ranks):
    """Scans all pairs for the lowest rank again and again."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_every_code_point_is_cut_alike(vocabulary, library):
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 1000):
        text = "".join(f"a{c}1{c} {c}" for c in points[i:i + 1000])
        assert ids(vocabulary, text) == library.encode_ordinary(text), hex(ord(points[i]))


def test_hash_is_perfect_and_minimal(vocabulary):
    keys = list(vocabulary.ranks)
    for some in (keys, keys[:1], keys[:7], []):
        found = bpe.PerfectHash(some)
        assert sorted(found.slot(k) for k in some) == list(range(len(some)))
    assert vocabulary.rank(b"no such entry at all") is None


def test_long_pieces_take_no_square(vocabulary, library):
    for text in ("z" * 300_000, "ab" * 100_000, "é" * 100_000):
        assert ids(vocabulary, text) == library.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 8)
    memo = bpe._memo(vocabulary)
    memo.clear()
    for text in ("the cat", " sat on", "the mat", "x" * 70) * 5 + tuple(map(str, range(100, 130))):
        got = b"".join(memo[p] for p in vocabulary.pieces(text))
        assert list(memoryview(got).cast("i")) == library.encode_ordinary(text)
        assert len(memo) <= 4 and len(memo.older) <= 4
    other = bpe.Vocabulary(SMALL, public_tokenizers.PATTERN)
    assert bpe._memo(vocabulary) is memo and bpe._memo(other) is not memo


def test_vocabulary_is_checked():
    for ranks in ({b"a": 1}, SMALL | {b"x y": 0}, SMALL | {b"": 999}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(ranks, ".")


def test_rows(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    rows = [(1, None, 5), (2, "", 5), (3, "Hello wörld, it's 2024\n\n  ok", 6), (3, "Hello", None),
            (3, "Hello", None), (None, "x", 1), (4, "lang genug " * 40_000 + "\x00", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = sorted(map(tuple, bpe.report(docs, vocabulary).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        found = library.encode_ordinary(text or "")
        want.append((doc_id, len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.report(docs.limit(0), vocabulary).collect() == []


def test_decoding_refuses_unknown_ids(spark, vocabulary):
    some = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode(some, vocabulary).collect())) == [
        (1, None, None), (2, [], b"")]
    with pytest.raises(Exception, match="KeyError"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], some.schema), vocabulary).collect()
