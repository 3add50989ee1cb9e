"""Round trip of archives, damaged archives, and the choice of the response."""

import base64
import gzip
import hashlib
import io

import pytest

from tallyguard.llm import warc
from tallyguard.session import scratch


def test_round_trip(spark):
    long = "<p>é</p>" * 50_000
    rows = [(5, "http://a/é%", "same", 0), (2, "u", "same", 0), (9, None, "same", 0),
            (None, "n", "same", 0), (3, "x\r\ny", None, 0), (4, "y", "", 0), (8, "z", long, 0),
            (1, "w", "other", 0), (1, "w", "other", 0), (None, "q", "lone", 0), (None, "q", "lone", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = scratch(spark, "warc-test")
    manifest = warc.write_archives(pages.repartition(3), folder, rotate=400)
    assert manifest.count() > 3
    got = warc.read_archives(manifest).collect()
    first = {"same": 2, "": 3, long: 8, "other": 1, "lone": None}
    want = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        to = first[html or ""]
        revisit = to is not None and page != to
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                     "revisit" if revisit else "response", to if revisit else None, url or "", True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    data = b"".join(open(r.path, "rb").read() for r in manifest.collect())
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(rows)
    assert warc.report(pages.limit(0)).collect() == []
    assert {r.record_type for r in warc.read_archives(warc.write_archives(
        pages.limit(3), scratch(spark, "warc-least"), least=100)).collect()} == {"response"}


def test_payloads_and_damage():
    member = warc.record(1, "u", b"abc" * 40_000, None, False)
    both = list(warc.records(io.BytesIO(member + warc.record(2, "u", b"abc", 1, True)), True))
    assert [r.payload for r in both] == [b"abc" * 40_000, b""] and all(r.verified for r in both)
    text = gzip.decompress(member)
    bad = gzip.compress(text.replace(b"abcabc", b"abcabd", 1))
    assert [r.verified for r in warc.records(io.BytesIO(bad))] == [False]
    for broken in (member[:-20], gzip.compress(text[:-9]), gzip.compress(text + b"x")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(broken)))
