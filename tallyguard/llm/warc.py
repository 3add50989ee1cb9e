"""WARC archives: a writer of one gzip member per record and a sequential reader.

Equal payloads are found by digest in Spark; the page with the smallest id keeps the
payload (response), the others point to it (revisit). Each task writes its own archive
files in the shared folder, first under a name of its own attempt and then renamed,
so that a lost executor leaves no half file under a final name. Reading goes member by
member through a streaming inflater; a record is framed by its Content-Length, and
block and payload digests are computed as the bytes pass.

Null html is an empty payload; null ids sort last, and a group without any id is all
responses; rows that repeat the smallest id are all responses. Null urls are written
as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.text import in_pieces, or_empty
from tallyguard.session import materialize, scratch

DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROTATE = 64 << 20
CHUNK = 64 << 10
MANIFEST = "path string, records long"
READ = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, url string, verified boolean")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    target = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
            f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    verified: bool
    payload: bytes | None


class Members:
    """Reads gzip members from a stream one after another, inflating as bytes are asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.rest, self.ready, self.inflater = stream, b"", bytearray(), None

    def next_member(self) -> bool:
        """Starts the next member; false at the end of the stream."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        self.inflater = zlib.decompressobj(31) if self.rest else None
        return self.inflater is not None

    def fill(self) -> bool:
        """Inflates some more of this member; false at its end."""
        while not self.inflater.eof:
            data = self.rest or self.stream.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            got = self.inflater.decompress(data, CHUNK)
            self.rest = self.inflater.unused_data if self.inflater.eof else (
                self.inflater.unconsumed_tail)
            if got:
                self.ready += got
                return True
        return False

    def head(self) -> bytes:
        """Bytes up to and without the next empty line."""
        while (end := self.ready.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                raise ValueError("a record has no end of its headers")
        head = bytes(self.ready[:end])
        del self.ready[:end + 4]
        return head

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready and not self.fill():
                raise ValueError("a record is shorter than its Content-Length")
            part = bytes(self.ready[:size])
            del self.ready[:size]
            size -= len(part)
            yield part

    def finish(self) -> None:
        while self.fill():
            pass
        if self.ready != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        self.ready.clear()


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (s.partition(":") for s in lines)}


def records(stream: BinaryIO, payloads: bool = False) -> Iterator[Record]:
    """The records of one archive in order; payloads are kept only if asked for."""
    members = Members(stream)
    while members.next_member():
        headers = _headers(members.head())
        left, block, body, kept = int(headers["content-length"]), hashlib.sha1(), hashlib.sha1(), []
        held, http, size = b"", None, 0
        for part in members.take(left):
            block.update(part)
            if http is None:
                held += part
                cut = held.find(b"\r\n\r\n")
                if cut < 0:
                    continue
                http, part = _headers(held[:cut]), held[cut + 4:]
            size += len(part)
            body.update(part)
            if payloads:
                kept.append(part)
        members.finish()
        http = http or {}
        said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = headers.get("warc-block-digest") == f"sha1:{base32(block.digest())}"
        if headers["warc-type"] == "revisit":
            size = int(http.get("content-length", 0))
        else:
            ok = ok and said == base32(body.digest()) and size == int(http.get("content-length", -1))
        yield Record(headers, http, size, said, ok, b"".join(kept) if payloads else None)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """The shared file system that a path names: local, hdfs, s3 or another that Arrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        pafs.LocalFileSystem(), uri)


def _writer(folder: str, rotate: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        out, written, count, number, names = None, 0, 0, 0, ("", "")

        def close() -> pa.RecordBatch:
            out.close()
            files.move(*names)
            return pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{names[1].rpartition('/')[2]}", "records": count}],
                schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in in_pieces(batches, text=2):
            for row in batch.to_pylist():
                if out is None:
                    # Two attempts at a task may deal rows otherwise; the manifest names the
                    # files of the one that counts.
                    name = (f"{root}/pages-{task.partitionId():06d}-{number:04d}"
                            f"-{task.taskAttemptId()}.warc.gz")
                    names = (f"{name}.writing", name)
                    out, written, count = files.open_output_stream(names[0], compression=None), 0, 0
                    number += 1
                data = record(row["page_id"], row["url"], (row["html"] or "").encode(),
                              row["first"], row["revisit"])
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= rotate:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string()), ("verified", pa.bool_())])
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, name = _open(path)
            with files.open_input_stream(name, compression=None, buffer_size=CHUNK) as stream:
                rows = []
                for r in records(stream):
                    url = r.headers.get("warc-target-uri", "")
                    rows.append({
                        "page_id": _page(r.headers["warc-record-id"]),
                        "payload_bytes": r.payload_bytes, "payload_digest": r.payload_digest,
                        "record_type": r.headers["warc-type"],
                        "refers_to": _page(r.headers.get("warc-refers-to")),
                        "url": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
                        "verified": r.verified})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def write_archives(pages: DataFrame, folder: str, least: int = 0, rotate: int = ROTATE) -> DataFrame:
    """Writes the pages (page_id, url, html) and returns the manifest (path, records).

    Payloads below ``least`` bytes are always responses. The table of repeated digests
    is written first, so the join sides are plain exchanges and adaptive execution can
    split a digest that many pages share.
    """
    html = F.encode(or_empty("html"), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        "html", F.sha1(html).alias("digest"), F.length(html).alias("size"))
    first = (rows.where(F.col("size") >= least).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    first = materialize(first, "warc-first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.join(first, "digest", "left").select("page_id", "url", "html", "first",
                                                    revisit.alias("revisit"))
    return materialize(out.mapInArrow(_writer(folder, rotate), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives at ``path``; each file is read by one task."""
    spread = manifest.select("path").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return spread.mapInArrow(_read, READ)


def report(pages: DataFrame) -> DataFrame:
    """Round trip: what the archives say about each page."""
    folder = scratch(pages.sparkSession, "warc-files")
    return read_archives(write_archives(pages, folder))
