"""Secret scan: keywords by Aho-Corasick, anchored expressions near hits, checksums last.

Each text is read once as UTF-8 bytes. One Aho-Corasick pass over the lower-cased
bytes finds every keyword; an expression runs only anchored at a keyword. Hex runs
have no keyword, so a byte-class copy of the text is searched for 32 hex bytes in a
row. GitHub and npm tokens end in a base-62 CRC-32 of their body, and JSON web tokens
start with an encoded JSON header: these are decoded and checked before they count.

A null text is read as empty. Spans are in code points, end exclusive; per kind they
are leftmost and do not overlap. A match of the base kinds that fails is dropped with all
it covers; one of the checked kinds hides nothing, the search goes on behind its keyword.
The header of a web token is a test of its form, not a checksum. Repeated rows give repeated
results, an empty table an empty one; other columns are not read and long texts are read whole.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyguard.llm.text import in_pieces

KINDS = ("assign", "access", "hex", "github", "npm", "jwt")
BASE_KINDS = 3
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
}
HEX_RUN = 32
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_NOT_HEX = re.compile(rb"[^0-9a-f]")
SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_checked long")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_ok(token: bytes) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of what follows the prefix."""
    body = token[token.index(b"_") + 1:]
    value = 0
    for digit in body[-6:]:
        value = value * 62 + BASE62.index(digit)
    return value == binascii.crc32(body[:-6])


def header_ok(part: bytes) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _accepts(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match.group(1)) >= 8
    if kind == "access":
        return len(match.group()) >= 16
    if kind == "jwt":
        return header_ok(match.group(1))
    return checksum_ok(match.group())


_ANCHORED = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT}


def find(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret, sorted."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    starts: dict[str, list[int]] = {}
    for end, (kind, size) in keywords.iter(raw.lower().decode("latin-1")):
        starts.setdefault(kind, []).append(end - size + 1)
    found = []
    for kind, at in starts.items():
        done, pattern, index = 0, _ANCHORED[kind], KINDS.index(kind)
        for start in sorted(at):
            if start >= done and (match := pattern.match(raw, start)):
                accepted = _accepts(kind, match)
                if accepted or index < BASE_KINDS:
                    done = match.end()
                if accepted:
                    found.append((start, index, done))
    classes = raw.translate(_HEX_CLASS)
    start = classes.find(b"h" * HEX_RUN)
    while start >= 0:
        stop = _NOT_HEX.search(raw, start)
        end = stop.start() if stop else len(raw)
        found.append((start, 2, end))
        start = classes.find(b"h" * HEX_RUN, end)
    found.sort()
    if found and not raw.isascii():
        points = np.zeros(len(raw) + 1, dtype=np.int64)    # code points before each byte
        np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=points[1:])
        found = [(int(points[s]), k, int(points[e])) for s, k, e in found]
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for batch in in_pieces(batches):
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column(1):
            spans = find(text.as_py(), keywords)
            base = [x for x in spans if x[1] < BASE_KINDS]
            for i in range(3):
                cols[i].append(sum(k == i for _, k, _ in base))
            cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols[4].append(_joined(spans))
            cols[5].append(len(spans) - len(base))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]],
             pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string()),
             pa.array(cols[5], pa.int64())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): counts, digest and spans.

    Narrow: no shuffle, memory bounded by one text and eight megabytes.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan, SCHEMA)
