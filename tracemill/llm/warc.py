"""WARC archives: writing, the monolithic-gzip normaliser, and reading by offset index.

Crawlers often deliver one gzip stream over a whole archive; nothing in it can be read without
inflating everything before it. ``normalise`` inflates such a stream once, rewrites every record as
a gzip member of its own and writes a sidecar index of the members' offsets, by which any record
is read alone. Files live in the shared folder and are reached through their URI, are written under
another name first and renamed when complete; a task that runs again writes them again.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import materialise, shared_dir

#: Payloads shorter than this are always stored whole.
MIN_REVISIT = 1000
#: A task begins another archive beyond so many payload bytes.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
BLOCK = 1 << 20
END = b"\r\n\r\n"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, or of a plain path of this machine."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Target:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.own, compression=None)

    def __enter__(self) -> BinaryIO:
        return self.out

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None, length: int) -> bytes:
    """One WARC record. A revisit has no payload, but keeps its length and digest."""
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", length),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>")] if refers_to is not None else []),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + END


class Reader:
    """Records of an inflated stream, one at a time; holds no more than a record and a block."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.buffer = stream, bytearray()

    def _more(self) -> bool:
        block = self.stream.read(BLOCK)
        self.buffer += block
        return bool(block)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """Headers, payload and the whole record."""
        while True:
            while (end := self.buffer.find(END)) < 0:
                if not self._more():
                    if self.buffer:
                        raise ValueError("a record's headers don't end")
                    return
            lines = bytes(self.buffer[:end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record begins with {lines[0][:40]!r}")
            head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
            start, size = end + len(END), int(head["content-length"])
            whole = start + size + len(END)
            while len(self.buffer) < whole:
                if not self._more():
                    raise ValueError("a record is cut off")
            yield head, bytes(self.buffer[start : start + size]), bytes(self.buffer[:whole])
            del self.buffer[:whole]


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``(page_id, d, refers_to)`` of the pages whose payload a page with a larger id has too; d is the payload's digest.

    Only digests, lengths and ids are shuffled. An id may have several payloads, each counts by itself.
    """
    ids = pages.select("page_id", _payload().alias("p")).where(F.octet_length("p") >= min_bytes).select("page_id", F.unhex(F.sha1("p")).alias("d"))
    last = ids.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ids.join(last, "d").where("page_id < refers_to").select("page_id", "d", "refers_to").distinct()


def write_monolithic(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html, refers_to)``; returns ``(archive)``.

    Each task writes archives of about ARCHIVE_BYTES as one gzip stream each, record by record.
    A null html is an empty payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True))
        row = next(rows, None)
        while row is not None:
            uri, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
            with Target(uri) as out, gzip.GzipFile("", "wb", LEVEL, out, mtime=0) as stream:
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, source, refers_to = row
                    payload = (source or "").encode("utf-8", "replace")
                    kind = "response" if refers_to is None else "revisit"
                    stream.write(record(page_id, url, kind, payload if refers_to is None else b"", hashlib.sha1(payload).hexdigest(), refers_to, len(payload)))
                    size += len(payload)
                    row = next(rows, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["archive"])

    return pages.select(F.col("page_id").cast("long"), "url", "html", F.col("refers_to").cast("long")).mapInArrow(run, "archive string")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """One gzip member for each record, and a sidecar index; returns ``(archive, index, records)``.

    Reads each archive in blocks and writes record after record, so neither is held whole.
    """

    def one(uri: str) -> tuple[str, str, int]:
        name = uri.rpartition("/")[2]
        target, index = f"{folder}/{name}", f"{folder}/{name}.idx"
        store, path = open_fs(uri)
        places, at = io.StringIO(), 0
        n = 0
        with store.open_input_stream(path, compression=None) as raw, Target(target) as out:
            for head, _, whole in Reader(gzip.GzipFile(fileobj=raw)):
                member = gzip.compress(whole, LEVEL, mtime=0)
                out.write(member)
                places.write(f"{head['warc-record-id']}\t{at}\t{len(member)}\n")
                at += len(member)
                n += 1
        with Target(index) as out:
            out.write(places.getvalue().encode())
        return target, index, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                target, index, n = one(uri)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([index]), pa.array([n], pa.int64())], ["archive", "index", "records"])

    return archives.mapInArrow(run, "archive string, index string, records long")


def read_member(archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record, by its place in the index."""
    store, path = open_fs(archive)
    with store.open_input_file(path) as raw:
        raw.seek(offset)
        head, payload, _ = next(iter(Reader(io.BytesIO(zlib.decompress(raw.read(length), 31)))))
    return head, payload


def read_back(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, through their indexes.

    ``(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest)``; a revisit's
    payload is null, its length and digest are those of the payload it stands for. A payload that
    does not have the digest that its record names fails the job.
    """

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = open_fs(index)
                with store.open_input_stream(path) as lines:
                    places = [line.split("\t") for line in lines.read().decode().splitlines()]
                store, path = open_fs(archive)
                rows, held = [], 0
                with store.open_input_file(path) as raw:
                    for urn, offset, length in places:
                        raw.seek(int(offset))
                        head, payload, _ = next(iter(Reader(io.BytesIO(zlib.decompress(raw.read(int(length)), 31)))))
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        size = int(head["x-payload-length"])
                        if head["warc-record-id"] != urn or kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{archive} at {offset}: the record isn't what its header or the index says")
                        rows.append((number(urn), head["warc-target-uri"], kind, number(head.get("warc-refers-to")), payload if kind == "response" else None, size, digest))
                        held += len(payload)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    return archives.select("archive", "index").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Pages to monolithic archives to normalised ones; returns ``(archive, index, records)``.

    Of equal payloads of at least ``min_bytes`` that with the largest page_id is stored and the others
    refer to it; shorter ones are all stored. Null html is an empty payload, repeated rows give
    repeated records, an empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(_payload())).alias("d")).join(revisits(pages, min_bytes), ["page_id", "d"], "left").select("page_id", "url", "html", "refers_to")
    raw = materialise(write_monolithic(rows, shared_dir(spark, "warc-raw")), "warc-list")
    n = max(1, raw.count())
    return materialise(normalise(raw.repartition(min(n, 10_000)), shared_dir(spark, "warc")), "warc-index")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    n = max(1, archives.count())
    return read_back(archives.repartition(min(n, 10_000))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM g
"""
