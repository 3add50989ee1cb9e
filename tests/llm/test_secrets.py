"""Secret scan against plain regular expressions over whole texts."""

import binascii
import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import secrets

PATTERNS = {
    "assign": r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"access": 16, "hex": 32}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(1)) >= 8 if kind == "assign" else len(m.group()) >= LEAST[kind]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def token(prefix, body="A" * 30):
    crc, digits = binascii.crc32(body.encode()), ""
    while crc or len(digits) < 6:
        crc, d = divmod(crc, 62)
        digits = chr(secrets.BASE62[d]) + digits
    return prefix + body + digits[-6:]


PIECES = st.sampled_from([
    "password", "Token", "api_key", "APIKEY", "secret", "passwd", " = ", ":", '"', "'", "=", " ",
    "AKIA", "AKIAABCDEFGHIJKL", "abcdefgh12", "0123456789abcdef", "deadbeefcafe0123", "é", "😀",
    "short", "ſecret", "K", "\n", "x", "gh", "_"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_equals_plain_expressions(text):
    got = [x for x in secrets.find(text, secrets.automaton()) if x[1] < secrets.BASE_KINDS]
    assert got == brute(text)


def test_checksums_decide():
    good = token("ghp_")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t, secrets.automaton())]
    assert kinds(f"x {good} y") == ["github"] and kinds(f"x {bad} y") == []
    assert kinds(token("npm_")) == ["npm"]
    assert kinds("eyJhbGciOiJIUzI1NiJ9.e30.c2ln") == ["jwt"]
    assert kinds("eyJub3RoaW5nIjoxfQ.e30.c2ln") == []
    assert kinds("eyJx.eyJhbGciOiJIUzI1NiJ9.e30.c2ln") == ["jwt"]     # a failed one hides nothing
    assert kinds("ghp_" + good) == ["github"]


def test_rows(spark):
    long = "word " * 60_000 + "ü token = abcdefghij " + "ab" * 20
    rows = [(1, None, "s"), (2, "", None), (3, long, "s"), (3, long, "s"), (None, "AKIA" * 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, secrets.scan(docs).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        spans = brute(text)
        said = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
        want.append((doc_id, *counts, hashlib.sha256(said.encode()).hexdigest(), said, 0))
    assert got == sorted(want, key=str)
    assert secrets.scan(docs.limit(0)).collect() == []
