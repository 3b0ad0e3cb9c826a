"""Operator 7, WARC archives: a writer and a sequential reader.

Writing: pages get their payload's SHA-1 in the JVM; of records with equal payloads of at least MIN_REVISIT bytes the one
with the largest id becomes a response, the others revisit it. The decision needs ids and digests only; pages of a
popular payload are counted before the shuffle. Each task then writes archives of about ARCHIVE_BYTES, one gzip member
a record, kept as rows (archive, content) of a table in the shared folder, which any store can hold.

Reading: one archive at a time, sequentially: incremental zlib decompression member by member, headers, content-length
framing, and verification of block and payload digests; a broken record raises ValueError.

Defined results: a null payload is the empty one; equal rows are each written; a row with a null id is a response
(unless an equal payload has an id, which it then revisits); extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.common import slices, table, written

MIN_REVISIT = 0
ARCHIVE_BYTES = 1 << 20
CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), b"\r\n"])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.insert(3, ("WARC-Target-URI", "".join(url.split())))
    if revisit:
        headers[1:1] = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return member(headers, block)


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes
    http_headers: dict[str, str]
    payload: bytes


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}


def _members(stream: io.BufferedIOBase) -> Iterator[bytes]:
    """The decompressed members of a stream, read in chunks; a member that ends early raises."""
    z, parts, rest = zlib.decompressobj(31), [], b""
    while chunk := rest or stream.read(CHUNK):
        try:
            parts.append(z.decompress(chunk))
        except zlib.error as broken:
            raise ValueError("a member is not whole gzip") from broken
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
        else:
            rest = b""
    if any(parts):
        raise ValueError("the archive ends within a member")


def read_records(stream: io.BufferedIOBase) -> Iterator[Record]:
    for data in _members(stream):
        head, gap, body = data.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not gap or not first.startswith(b"WARC/"):
            raise ValueError("no record header")
        headers = _headers(lines)
        if missing := {"content-length", "warc-type", "warc-record-id"} - headers.keys():
            raise ValueError(f"no {', '.join(sorted(missing))} in a record header")
        n = int(headers["content-length"])
        block = body[:n]
        if len(block) != n or body[n:] != b"\r\n\r\n":
            raise ValueError("the record's length is not its content-length")
        if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest32(block)}":
            raise ValueError("block digest differs")
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            http_head, _, payload = block.partition(b"\r\n\r\n")
            http = _headers(http_head.split(b"\r\n")[1:])
        kind = headers["warc-type"]
        if kind == "response" and (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest32(payload)}":
            raise ValueError("payload digest differs")
        yield Record(kind, headers, block, http, payload)


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(id, url, digest, size, refers_to, revisit, payload); the payload is null where the record is a revisit."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    src = src.select("id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), "payload")
    first = src.groupBy("sha1").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL")
    small = src.select("id", "sha1", "size").where(F.col("size") >= min_bytes).distinct()
    seconds = small.join(first, "sha1").where(~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("rid"), F.col("sha1").alias("rsha1"), "first")
    key = lambda i, s: F.concat_ws("/", F.coalesce(i.cast("string"), F.lit("null")), s)
    seconds = seconds.select(key(F.col("rid"), F.col("rsha1")).alias("k"), "first")
    out = src.withColumn("k", key(F.col("id"), F.col("sha1"))).join(seconds, "k", "left")
    revisit = F.col("first").isNotNull()
    return out.select("id", "url", F.unhex("sha1").alias("digest"), "size", F.col("first").alias("refers_to"), revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(records: DataFrame) -> DataFrame:
    """The planned records as a written table (archive, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([f"pages-{part:06d}-{k:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "content"])

        for piece in slices(batches, "payload"):
            for x in piece.to_pylist():
                held.append(page_record(x["id"], x["url"], x["payload"], x["size"], base64.b32encode(x["digest"]).decode(), x["refers_to"], x["revisit"]))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield row()
                    k, held, size = k + 1, [], 0
        if held:
            yield row()

    return written(records.mapInArrow(run, "archive string, content binary"), "warc")


def read_archives(archives: DataFrame, id_type: str) -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to) of all records of archives (archive, content);
    the binaryFile source gives the same columns as path and content."""

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").removeprefix(URN)
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "content"):
            for content in piece.column("content"):
                rows = [
                    {
                        "id": number(r.headers["warc-record-id"]),
                        "url": r.headers.get("warc-target-uri"),
                        "payload_bytes": int(r.http_headers["content-length"]) if r.kind == "revisit" else len(r.payload),
                        "payload_digest": r.headers["warc-payload-digest"].removeprefix("sha1:"),
                        "record_type": r.kind,
                        "refers_to": number(r.headers.get("warc-refers-to")),
                    }
                    for r in read_records(io.BytesIO(content.as_buffer()))
                ]
                kinds = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.mapInArrow(run, f"id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(plan_revisits(table(spark, sf_dir, "pages"), "page_id", "url", "html"))
    return read_archives(archives, "long").select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM d),
f AS (SELECT s, max(page_id) AS first FROM h GROUP BY s),
x AS (SELECT page_id, n, s, first, list_reduce(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j:
          (((strpos('0123456789abcdef', substr(s, 1 + (5 * i + j) // 4, 1)) - 1) >> (3 - (5 * i + j) % 4)) & 1) << (4 - j)))::INT, 1)), lambda a, c: a || c) AS digest
      FROM h JOIN f USING (s))
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""
