"""WARC archives: writing captures as request, response/revisit and metadata records, and assembling them again.

Writing: every page becomes three records (request, response or revisit, metadata) tied by WARC-Concurrent-To to the
response's id. Records are text in UTF-8 and WARC ends each record by CRLF CRLF, so Spark's own text writer makes the
archives, with that as its line separator. Of pages with equal payloads of at least 100 bytes the smallest page_id is
the response; the others become revisits that refer to it.

Reading: each archive is parsed by Content-Length, and the records of one capture are joined through their
concurrent-to ids into one nested row.

Defined results: null html is an empty payload; payloads under 100 bytes are always responses; equal pages under
different ids are separate captures, and so are rows of one page_id, equal or not; null urls are written as an empty target; an empty table makes no captures.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseworks.llm.common import fits, materialize

#: Payloads of fewer bytes are never written as revisits.
LEAST_REVISIT = 100
#: Records in an archive at most, so that a reader's task holds a bounded file.
ARCHIVE_RECORDS = 6000
CAPTURE_DATE = "2024-01-01T00:00:00Z"


def _record(kind: str | Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n")]
    for name, value in fields:  # a null value leaves its field out
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def _urn(kind: str, page_id: Column) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), page_id.cast("string"), F.lit(">"))


def first_captures(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to: the smallest page_id of an equal payload where that is another page."""
    d = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    d = d.withColumn("digest", F.sha2("html", 256))
    repeated = d.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    repeated = fits(materialize(repeated, "repeated-payloads"))  # as a rule few, so that no html is shuffled
    return d.join(repeated, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def write_warc(pages: DataFrame, path: str) -> None:
    d = first_captures(pages)
    # rows of a repeated page_id, and of none, are captures of their own: their ids go on with a number of the row
    again = materialize(pages.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select("page_id", F.lit(True).alias("_again")), "repeated-pages")
    d = d.withColumn("_again", F.lit(False)) if again.isEmpty() else d.join(fits(again), "page_id", "left")
    page = F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.when(F.col("_again") | F.col("page_id").isNull(), F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise(F.lit("")))
    d = d.withColumn("_name", page)
    page, date = F.col("_name"), F.lit(CAPTURE_DATE)
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", _urn("capture", page)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Date", date),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(again, _urn("capture", F.col("refers_to")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(again, http).otherwise(F.concat(http, F.col("html"))),
    )
    request = _record(
        "request",
        [("WARC-Record-ID", _urn("request", page)), ("WARC-Concurrent-To", _urn("capture", page)), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("Content-Type", F.lit("application/http; msgtype=request"))],
        asked,
    )
    meta = _record(
        "metadata",
        [("WARC-Record-ID", _urn("metadata", page)), ("WARC-Concurrent-To", _urn("capture", page)), ("WARC-Target-URI", F.col("url")), ("WARC-Date", date), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("payload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n")),
    )
    records = d.select(F.explode(F.array(request, response, meta)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    pos = 0
    while pos < len(data):
        if not data.startswith(b"WARC/", pos):
            raise ValueError(f"no WARC record at byte {pos}")
        end = data.index(b"\r\n\r\n", pos)
        lines = data[pos:end].decode().split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        pos = end + 4 + size + 4


RECORD = "record_id string, capture_id string, kind string, url string, warc_date string, refers_to string, declared_digest string, http_head string, payload_bytes long, payload_digest string"


def read_records(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """One row per record; the digest and size of a response are computed from its bytes, a revisit's are as declared."""
    schema = RECORD + (", payload binary" if keep_payload else "")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for f, block in parse_records(data):
                    kind = f["warc-type"]
                    own, tied = f["warc-record-id"], f.get("warc-concurrent-to")
                    head, _, body = block.partition(b"\r\n\r\n") if kind in ("request", "response", "revisit") else (block, b"", b"")
                    size = digest = None
                    if kind == "response":
                        size, digest = len(body), hashlib.sha256(body).hexdigest()
                    elif kind == "revisit":
                        size = int(re.search(rb"(?i)content-length:\s*(\d+)", head)[1])
                        digest = f["warc-payload-digest"].partition(":")[2]
                    row = (own, tied or own, kind, f.get("warc-target-uri", ""), f["warc-date"], f.get("warc-refers-to"), f.get("warc-payload-digest", "").partition(":")[2], head.decode(), size, digest)
                    rows.append((*row, body) if keep_payload else row)
                out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
                yield out.astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parse, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response (or revisit) and metadata record, missing ones null.

    The records of a capture share its id, which no other capture has, so the groups stay small. A record that
    appears twice counts once (the greatest by value).
    """
    part = F.struct(*[c for c in records.columns if c not in ("capture_id",)])
    one = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), part))
    return records.groupBy("capture_id").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from caseworks.llm.common import shared_dir, table

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.nullif(F.regexp_extract(c, r"urn:capture:(-?\d+)", 1), F.lit("")).cast("long")
    captures = assemble(read_records(spark, path))
    return captures.select(
        number("capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.when(F.col("response.refers_to").isNotNull(), number("response.refers_to")).alias("refers_to"),
        F.col("request.url").alias("url"),
        F.col("metadata.record_id").alias("metadata_id"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, url, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to,
  regexp_replace(url, '[\\r\\n]+', ' ', 'g') AS url, '<urn:metadata:' || page_id || '>' AS metadata_id
FROM f
"""
