"""WARC archives of captured pages: revisit resolution, writing and reading.

The library's records hold no web captures, so these operators are general: a capture is
``page_id, url, html``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageflow.functions.binding import let

# Fixed value: the RFC 4648 base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 16 * 1024 * 1024
RECORDS = """page_id long, url string, record_type string, refers_to long, payload_bytes long,
    payload_digest string, html string"""
CRLF = "\r\n"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: five hex digits give four characters."""

    def letters(digits: Column) -> Column:
        out = []
        for i in range(8):
            bits = F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("int")
            for shift in (15, 10, 5, 0):
                out.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
        return F.concat(*out)

    return let(F.sha1(payload), letters)


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest``; null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"), sha1_base32(html).alias("payload_digest"),
    )


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of every revisit among capture headers.

    Headers (no payloads) are reduced to the largest id per digest, with map-side combine, and
    joined back on the digest. Payloads under ``min_bytes`` are never revisits; a capture
    without an id neither is a revisit nor is referred to.
    """
    heads = headers.select("page_id", "payload_digest", "payload_bytes").filter(
        F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes))
    originals = heads.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    originals = originals.filter("n > 1").drop("n")
    return heads.join(originals, "payload_digest").filter("page_id <> refers_to").select(
        "page_id", "payload_digest", "refers_to").distinct()


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Control characters cannot end the line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]", " "), F.lit(CRLF)), F.lit(""))


def warc_records(resolved: DataFrame, written_at: datetime) -> Column:
    """A record without its closing blank lines, from captures with ``refers_to``.

    Fresh headers for both kinds: a response carries the HTTP header and the payload, a revisit
    the HTTP header alone, with the payload's length and digest and the record it refers to.
    """
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    profile = F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(written_at.strftime("%Y-%m-%dT%H:%M:%SZ"))),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _field("WARC-Profile", profile),
        _field("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _field("Content-Length", length.cast("string")),
        F.lit(CRLF), http, F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES,
                   written_at: datetime | None = None) -> None:
    """Write one WARC record per row of ``page_id, url, html`` below ``path``.

    Of the captures with equal payloads of at least ``min_bytes``, the one with the largest
    ``page_id`` is the response and the others are revisits of it; rows equal in id and payload
    are the same capture and all of its kind. Payloads cross the network once, spread by
    ``page_id`` (never by digest, so a payload that a third of all captures share does not meet
    in one task), into about ``file_bytes`` of payload a file. Spark's text writer commits the
    files, gzipped, with the two blank lines that end a record as its line separator: an
    attempt that dies leaves nothing behind. Null html is an empty payload, null url gives no
    target header, a null id is written as ``none``; other columns are not read; an empty table
    writes an archive without records.
    """
    all_captures = captures(pages)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    files = int(total // file_bytes) + 1
    revisits = resolve_revisits(all_captures, min_bytes)
    c = all_captures.repartition(files, "page_id").alias("c")
    r = revisits.alias("r")
    resolved = c.join(
        r, (F.col("c.page_id") == F.col("r.page_id")) & (F.col("c.payload_digest") == F.col("r.payload_digest")), "left"
    ).select("c.*", "r.refers_to")
    records = resolved.select(warc_records(resolved, written_at or datetime.now(timezone.utc)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


_HEAD_END = (CRLF + CRLF).encode()
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one WARC file, found by their Content-Length. A response's length and
    digest are taken from its payload, a revisit's from its headers."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(_HEAD_END, at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        http_end = data.index(_HEAD_END, start, stop) + 4
        page, refers = _PAGE.match(head["WARC-Record-ID"]), _PAGE.match(head.get("WARC-Refers-To", ""))
        record = {
            "page_id": int(page[1]) if page else None, "url": head.get("WARC-Target-URI"),
            "record_type": head["WARC-Type"], "refers_to": int(refers[1]) if refers else None,
        }
        if record["record_type"] == "response":
            payload = data[http_end:stop]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            record |= {"payload_bytes": len(payload), "payload_digest": digest, "html": payload.decode()}
        else:
            http = dict(x.split(": ", 1) for x in data[start : http_end - 4].decode().split(CRLF)[1:])
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            record |= {"payload_bytes": int(http["Content-Length"]), "payload_digest": digest, "html": None}
        yield record
        at = stop + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives below ``path``; a revisit's ``html`` is null. One file at a time
    is in a task's memory. Without ``payloads`` no payload leaves the Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                packed, plain, done = content.as_py(), bytearray(), 0
                while packed:  # gzip members one after another
                    part = zlib.decompressobj(31)
                    plain += part.decompress(packed) + part.flush()
                    packed = part.unused_data
                rows = []
                for record in parse_records(bytes(plain)):
                    rows.append(record if payloads else record | {"html": None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    text, number = pa.string(), pa.int64()
    schema = pa.schema([("page_id", number), ("url", text), ("record_type", text), ("refers_to", number),
                        ("payload_bytes", number), ("payload_digest", text), ("html", text)])
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return found.mapInArrow(run, RECORDS)


def restore_payloads(records: DataFrame) -> DataFrame:
    """Records with every revisit's payload taken from the response it refers to."""
    plain = records.filter("refers_to is null")
    originals = records.filter("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"), F.col("html").alias("original")).dropDuplicates(["refers_to"])
    revisits = records.filter("refers_to is not null").join(originals, "refers_to").withColumn("html", F.col("original"))
    return plain.unionByName(revisits.select(plain.columns))
