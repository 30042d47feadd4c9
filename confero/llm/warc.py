"""WARC archives as a chunked record table.

A record is rows (record_id, chunk): chunk 0 is its header and the first slice of its block, the next ones are further
slices, so a payload of any size is written and read piece by piece.  Each row carries the SHA-256 of the payload so
far, which writer and reader carry from row to row; rows of an archive in order are a valid WARC file.  A record of
one row is read where it stands; only the rows of oversized payloads are brought together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches, table

CHUNK = 1 << 18
#: Payloads shorter than this are always written whole.
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_END = b"\r\n\r\n"

_CHUNKS = pa.schema([("record_id", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("digest", pa.binary()), ("data", pa.binary())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def types(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, digest, rows, first: how many rows have the key; the smallest page_id with the same payload, null for
    the response itself.

    Keys go through the shuffle alone; digests of several pages are gathered first, so that the join's two sides
    are plain scans and a digest that very many pages share can be split.
    """
    keys = scratch.save(pages.groupBy("page_id", "digest", F.octet_length("payload").alias("n")).agg(F.count("*").alias("rows")), "keys")
    shared = scratch.save(keys.where(F.col("n") >= REVISIT_FROM).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first"), "shared")
    return keys.join(shared, "digest", "left").select("page_id", "digest", "rows", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("first"))


def repeated(pages: DataFrame, kinds: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose page_id and payload occur more than once, numbered (copy); one of each key has no number, so that
    revisits can refer to it.  The numbers are written down once, and no key has to stand in a single task."""
    again = scratch.save(pages.join(kinds.where("rows > 1"), ["page_id", "digest"]).withColumn("copy", F.monotonically_increasing_id()), "again")
    plain = again.groupBy("page_id", "digest").agg(F.min("copy").alias("plain"))
    return again.join(plain, ["page_id", "digest"]).withColumn("copy", F.when(F.col("copy") > F.col("plain"), F.col("copy"))).drop("plain")


def _chunks(chunk: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in source:
            for i in range(batch.num_rows):
                page_id, digest, url, first, copy = (batch.column(c)[i].as_py() for c in ("page_id", "digest", "url", "first", "copy"))
                payload = batch.column("payload")[i].as_buffer()
                n = payload.size if payload is not None else 0
                record = f"urn:page:{page_id}:{digest}" + (f":{copy}" if copy is not None else "")
                http = _HTTP if first is None else _HTTP[:-2] + b"\r\n"
                head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{record}>", f"WARC-Date: {DATE}", f"WARC-Page-ID: {page_id}"]
                if url:
                    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
                head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n}"]
                if first is not None:
                    head += [f"WARC-Refers-To: <urn:page:{first}:{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                body = n if first is None else 0
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + body}"]
                front, sha = ("\r\n".join(head) + "\r\n\r\n").encode() + http, hashlib.sha256()
                for k, at in enumerate(range(0, max(body, 1), chunk)):
                    part, last = memoryview(payload)[at : at + chunk] if body else b"", at + chunk >= body
                    sha.update(part)
                    yield record, k, last, sha.digest(), b"".join((front if k == 0 else b"", part, _END if last else b""))

    return rows


def write_records(pages: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """Writes an archive of pages (page_id, url, html) and returns its table."""
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    kinds = scratch.save(types(pages, scratch), "types")
    names = ("page_id", "digest", "url", "payload", "first", "copy")
    rows = pages.join(kinds.where("rows = 1"), ["page_id", "digest"]).withColumn("copy", F.lit(None).cast("long")).select(*names)
    if kinds.where("rows > 1").limit(1).count():
        rows = rows.union(repeated(pages, kinds, scratch).select(*names))
    archive = rows.mapInArrow(lambda source: batches(_chunks(chunk)(source), _CHUNKS, 64), "record_id string, chunk int, last boolean, digest binary, data binary")
    return scratch.save(archive, "archive")


class _Reading:
    """A record that is being read, row after row."""

    def __init__(self, record: str, first: memoryview):
        front, block = bytes(first).split(b"\r\n\r\n", 1)
        lines = front.decode().split("\r\n")
        self.record, self.head = record, dict(line.split(": ", 1) for line in lines[1:] if line)
        self.http = block.find(b"\r\n\r\n") + 4 if self.head["WARC-Type"] == "response" else len(block)
        self.skip = len(front) + 4 + self.http
        self.sha, self.size, self.chunk, self.ended = hashlib.sha256(), 0, 0, False
        self.good = lines[0] == "WARC/1.1" and self.head["WARC-Record-ID"] == f"<{record}>"

    def add(self, chunk: int, part: memoryview, digest: bytes, last: bool) -> None:
        self.sha.update(part)
        self.size += len(part)
        self.good &= chunk == self.chunk and not self.ended and self.sha.digest() == digest
        self.chunk, self.ended = self.chunk + 1, last

    def row(self) -> tuple:
        head, refers = self.head, self.head.get("WARC-Refers-To")
        stated, n = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
        good = self.good and self.ended and self.http + self.size == int(head["Content-Length"])
        if head["WARC-Type"] == "response":
            good = good and n == self.size and self.sha.hexdigest() == stated
        return int(head["WARC-Page-ID"]), n, stated, head["WARC-Type"], int(refers.split(":")[2]) if refers else None, good


def _records(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now: _Reading | None = None
    for batch in source:
        for i in range(batch.num_rows):
            data = batch.column("data")[i].as_buffer()
            record, chunk, last, digest = (batch.column(c)[i].as_py() for c in ("record_id", "chunk", "last", "digest"))
            part = memoryview(data)[: len(data) - len(_END) * last]
            if now is None or record != now.record:
                if now is not None:
                    yield now.row()
                if chunk:
                    raise ValueError(f"no first chunk of {record}")
                now = _Reading(record, part)
                part = part[now.skip :]
            now.add(chunk, part, digest, last)
    if now is not None:
        yield now.row()


def read_records(archive: DataFrame, scratch: Scratch) -> DataFrame:
    """Reads an archive's rows back: page_id, payload_bytes, payload_digest, record_type, refers_to and intact: whether
    chunks, lengths and digests agree with what was read, and, of a revisit, with the response that it refers to."""
    read = lambda df: df.mapInArrow(lambda s: batches(_records(s), _RECORDS), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")
    long = archive.where("not (chunk = 0 and last)").repartition("record_id").sortWithinPartitions("record_id", "chunk")
    found = scratch.save(read(archive.where("chunk = 0 and last")).union(read(long)), "read")
    whole = found.where("record_type = 'response' and intact").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct().withColumn("there", F.lit(True))
    revisits = found.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest", "payload_bytes"], "left")
    revisits = revisits.withColumn("intact", F.col("intact") & F.coalesce("there", F.lit(False)))
    return found.where("record_type <> 'revisit'").unionByName(revisits.select(*found.columns))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC records and read the archive back; a record that is not intact stops the reading.

    A null html is an empty payload, a null url leaves out its header; rows without a page_id are left out.  Every
    other row is a record of its own, also where page_id, url and payload are those of another row.  Payloads of any
    length pass in chunks; an empty table gives no rows; other columns are not looked at.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    found = read_records(write_records(pages, scratch), scratch)
    damaged = F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))).cast("string")
    return found.withColumn("payload_digest", F.when(F.col("intact"), F.col("payload_digest")).otherwise(damaged))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""
