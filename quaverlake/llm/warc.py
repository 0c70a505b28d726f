r"""WARC archives with revisit resolution.

Writing: headers (page id and SHA-1 payload digest) are grouped by digest, without
payloads; the largest page id of a digest becomes the ``response``, and other
captures of at least ``min_bytes`` become ``revisit`` records that refer to it and
carry no payload.  Captures learn of their group by a join on the digest, in which
they are shuffled once, payload and all, where the groups are too many to broadcast.
Each record gets fresh headers and is written by Spark's text writer with the line
separator CR LF CR LF, which is how a WARC record ends, so archives go through Spark's
commit protocol to any store it can write.  A file has at most ``file_bytes`` bytes of
payload, or one record, and is compressed as one gzip stream.

Reading: archives are parsed by Content-Length (the payload may hold any bytes),
payload length and digest are taken from the bytes read and kept, and revisit records
are joined to their original responses, those of one original dealt over tasks.

Defined cases: null html is an empty payload; a null url becomes ``urn:none``;
control characters in a url are percent-encoded; a null page id is a response or
revisit like another, and is the original only where its digest has no other id;
rows that repeat page id and payload are the same capture and share its record
type; rows of one page id with different payloads are different records, as a record
id names page and digest; an empty table gives an empty result.  Extra columns are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, new_folder, saved, table

CRLF = "\r\n"
#: RFC 4648 digits, and the digits that conv() writes in base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "record_type string, page_id long, record_id string, refers_to_record string, payload_bytes long, payload_digest string"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, and ``original_id`` where the record is a revisit."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    captures = pages.select("page_id", "url", payload.alias("payload"), sha1_base32(payload.cast("binary")).alias("digest"))
    headers = captures.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("__rows"))
    # most digests have one capture: only those of several need the join
    joined = join_groups(captures, headers.where("__rows > 1"), "digest", pages.count(), F.col("page_id"))
    small = F.octet_length("payload") < min_bytes
    return joined.withColumn("original_id", F.when(~small & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))).drop("latest")


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One text per record, without the CR LF CR LF that ends it."""
    revisit = F.col("original_id").isNotNull()
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), r"[\x00-\x20\x7f]", "%20")
    head = F.concat(F.lit(HTTP_HEAD), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("original_id")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 64 << 20, usual_bytes: int = 32 << 10) -> None:
    """Writes ``pages`` as deduplicated archives, each of at most ``file_bytes`` of payload or one record.

    Payloads above ``usual_bytes`` go to files of their own, of fewer records.
    """
    resolved, length = resolve_revisits(pages, min_bytes), F.octet_length("payload")
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    shares = [(resolved, max(1, most))] if most <= usual_bytes else [(resolved.where(length <= usual_bytes), usual_bytes), (resolved.where(length > usual_bytes), most)]
    for rows, largest in shares:
        writer = records(rows).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip")
        writer.option("maxRecordsPerFile", max(1, min(2000, file_bytes // largest))).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The headers (names in lower case) and the block of each record."""
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split(CRLF)
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if lines[0] != "WARC/1.1" or bytes(view[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError(f"broken WARC record at byte {at}")
        yield headers, view[start:stop]
        at = stop + 4


def _page_of(record_id: str | None) -> int | None:
    number = record_id[len("<urn:x-page:") :].partition(":")[0] if record_id else "none"
    return None if number == "none" else int(number)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PARSED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for headers, block in parse_archive(gzip.decompress(content.as_py())):
                kind = headers["warc-type"]
                size = digest = None
                if kind == "response":
                    body = block[bytes(block[:256]).index(b"\r\n\r\n") + 4 :]
                    size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
                record = headers["warc-record-id"]
                rows.append((kind, _page_of(record), record, headers.get("warc-refers-to"), size, digest))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, revisits resolved to their original's payload figures."""
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = saved(files.mapInArrow(_parse_batches, PARSED), "warc-records")
    originals = parsed.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(
        F.first("payload_bytes").alias("original_bytes"), F.first("payload_digest").alias("original_digest"), F.first("page_id").alias("refers_to")
    )
    responses = parsed.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = parsed.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_record")
    counts = again.groupBy("refers_to_record").agg(F.count(F.lit(1)).alias("__rows"))
    revisits = join_groups(again, originals.join(counts, "refers_to_record"), "refers_to_record", again.count(), F.col("page_id")).select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), F.col("original_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.unionByName(revisits)


def query(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path)


ORACLE = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (
  SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS latest FROM p),
b AS (
  SELECT page_id, payload_bytes, latest,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM h)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM b
"""
