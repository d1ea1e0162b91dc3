"""WARC archives whose repeated payloads are revisit records.

Archives are written by Spark's text writer, one record a row, so that output commits, retries and any file system that
Spark knows work as for any table. A record ends in two CRLF, which is the writer's line separator.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.common import batches, shared_dir

MIN_PAYLOAD = 100
#: Bytes of payload in one archive; a reader holds one archive at a time. A longer record has an archive of its own size.
ARCHIVE_BYTES = 8 << 20
CRLF = "\r\n"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest: what is shuffled to resolve revisits; payloads stay where they are."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def resolve(heads: DataFrame) -> DataFrame:
    """heads with refers_to and refers_uri: the smallest page_id of an equal payload of MIN_PAYLOAD bytes or more and its url
    (of repeated rows the smallest), null for that page itself. A page without an id refers to it as well.

    The smallest id per digest is a grouped minimum (summed before the shuffle); only digests that recur are joined back,
    and adaptive execution splits a digest that many pages share.
    """
    firsts = heads.where(f"payload_bytes >= {MIN_PAYLOAD}").groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    joined = heads.join(firsts, "payload_digest", "left")
    later = F.coalesce(F.col("page_id") > F.col("first.page_id"), F.lit(True))
    return joined.withColumns({"refers_to": F.when(later, F.col("first.page_id")), "refers_uri": F.when(later, F.col("first.url"))}).drop("first", "copies")


def _uri(url: Column, page_id: Column) -> Column:
    """A URI that fits one header line: white space and control characters are percent-encoded; a null url is a urn."""
    clean = url
    for c in [*range(33), 127]:
        clean = F.replace(clean, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.coalesce(clean, F.concat(F.lit("urn:page:"), page_id.cast("string")), F.lit("urn:page:none"))


def record(page_id: Column, url: Column, digest: Column, refers_to: Column, refers_uri: Column, payload: Column, payload_bytes: Column) -> Column:
    """One WARC record without its final separator: an HTTP response, dated when it is written. A revisit's response ends
    after its header; the digest, length and origin stand for the payload."""
    revisit = refers_to.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), payload_bytes.cast("string"), F.lit(CRLF + CRLF))
    body = F.concat(http, F.when(revisit, "").otherwise(payload))
    now = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:"), F.coalesce(F.concat(F.lit("page:"), page_id.cast("string")), F.concat(F.lit("uuid:"), F.uuid())), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), now),
        F.concat(F.lit("WARC-Target-URI: "), _uri(url, page_id)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("WARC-Payload-Length: "), payload_bytes.cast("string")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri(refers_uri, refers_to))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Date: "), now)),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def write_archives(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """Deduplicated archives of pages under path, with fresh headers, gzipped; about ARCHIVE_BYTES of payload in each."""
    size = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    files = max(1, -(-((size[0] or 0) + 400 * size[1]) // ARCHIVE_BYTES))
    key, name = ["record", "payload_digest"], F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("record")
    resolved = resolve(headers(pages)).select(name, "payload_digest", "payload_bytes", "refers_to", "refers_uri").distinct().repartition(files, *key)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(name, "page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("payload_digest")).repartition(files, *key).join(resolved, key)
    records = rows.select(record(F.col("page_id"), F.col("url"), F.col("payload_digest"), F.col("refers_to"), F.col("refers_uri"), F.col("html"), F.col("payload_bytes")).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _parse(content: bytes) -> Iterator[tuple]:
    import zlib

    data, at = memoryview(zlib.decompress(content, 47)), 0
    while at < len(data):
        lines = []
        while True:  # header lines are short; the payload is skipped by its length
            end = bytes(data[at : at + 65536]).find(b"\r\n")
            if end < 0:
                end = bytes(data[at:]).find(b"\r\n")
            if end < 0:
                raise ValueError("a record's header does not end")
            if end == 0:
                at += 2
                break
            lines.append(bytes(data[at : at + end]))
            at += end + 2
        if lines[0] != b"WARC/1.1":
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = dict(x.split(b": ", 1) for x in lines[1:])
        size = int(head[b"Content-Length"])
        body = data[at : at + size]
        at += size
        if bytes(data[at : at + 4]) != b"\r\n\r\n" or len(body) != size:
            raise ValueError("a record is cut short")
        at += 4
        named = re.search(rb"page:(-?\d+)", head[b"WARC-Record-ID"])
        page, kind, digest = int(named[1]) if named else None, head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
        start = bytes(body[:4096]).find(b"\r\n\r\n") + 4
        if start < 4:
            raise ValueError(f"page {page}: its HTTP header does not end")
        body = body[start:]
        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
            raise ValueError(f"page {page}: the payload is not that of its digest")
        refers = int(re.search(rb"page:(-?\d+)", head[b"WARC-Refers-To"])[1]) if kind == "revisit" else None
        yield page, int(head[b"WARC-Payload-Length"]), digest, kind, refers, head[b"WARC-Target-URI"].decode(), bytes(body) if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records under path: page_id, payload_bytes, payload_digest, record_type, refers_to, uri (and payload, null for revisits).

    Each response's payload is checked against its digest. A revisit's payload is that of the page it refers to.
    """
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())]
    n = 7 if payloads else 6
    schema = pa.schema(fields[:n])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                yield from batches((r[:n] for r in _parse(content.as_py())), schema, 500)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string" + ", payload binary" * payloads)


def archive(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as deduplicated archives, and return their records as read back.

    A null html is an empty payload; payloads under MIN_PAYLOAD bytes never become revisits. page_id names the record: rows
    that repeat one are written once each; a row without one is written under an id of its own, comes back with a null
    page_id, and is a revisit where a page with an id has its payload, else a response. No rows give no records. Other columns of
    pages are not archived.
    """
    path = path or f"{shared_dir(spark)}/turnframe/warc-{uuid.uuid4().hex}"
    write_archives(spark, pages.select("page_id", "url", "html"), path)
    return read_archives(spark, path)
