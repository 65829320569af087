"""WARC archives: pages written as captures, archives read back as captures.

Writing. Each page becomes a transaction of three records: a request, a
response (or a revisit), and a metadata record, tied together by
WARC-Concurrent-To. The three are one value of Spark's text sink, whose line
separator is the blank line that ends a WARC record; so files are committed,
retried and stored like any other output of Spark, on whatever store the path
names, and no page is shuffled. ``maxRecordsPerFile`` keeps an archive near
``ARCHIVE_BYTES``, from the mean page length.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the
smallest page_id is stored as a response; the others are revisits, which hold
its digest and a reference but no payload. Equality is decided on SHA-256 and
length. Only payloads that repeat are looked up; few of them, by count, are
broadcast, more are joined (AQE splits a payload that a third of all pages has).

Reading, by transaction assembly: records are read by their Content-Length, in
batches; requests, responses or revisits, and metadata are joined through their
concurrent-to identifiers, and each capture becomes one nested row. A revisit's
digest and length come from the response that it refers to, and must agree with
what the revisit states.

Defined results: null html is an empty payload (a response; nothing smaller than
100 bytes is a revisit). Null urls have no WARC-Target-URI and read back as
null; control characters in urls are percent-encoded in headers, the metadata
record keeps the url as it is. Null page_ids come after all others: such a page
revisits a page with an id, and is a response if there is none. Pages that share
the smallest page_id of their payload are all responses; revisits then name their
common payload (stated in their metadata records) instead of a record. Every row
is a capture of its own, repeated ones too. Other columns are not read. An empty table gives
archives without records and no rows. A truncated archive raises an error.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlens.session import checkpoint_dir

from .common import BROADCAST_KEYS, stored, table

MIN_REVISIT = 100                  # payload bytes from which copies become revisits
ARCHIVE_BYTES = 16 * 1024 * 1024   # wanted size of an archive: one is held by a task when read
DATE = "2024-01-01T00:00:00Z"      # capture date of pages that state none
BATCH_BYTES = 4 * 1024 * 1024      # payload bytes per batch when reading

# Names of the WARC 1.1 format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_digest, payload_bytes) of each page."""
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.sha2(html, 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))


def repeated_payloads(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Payloads that more than one page has: digest, bytes, first page_id, and
    whether a single page has this id."""
    per_page = (payload_digests(pages).where(F.col("payload_bytes") >= min_bytes)
                .groupBy("payload_digest", "payload_bytes", "page_id").agg(F.count(F.lit(1)).alias("_n")))
    return (per_page.groupBy("payload_digest", "payload_bytes")
            .agg(F.min("page_id").alias("first_id"), (F.min_by("_n", "page_id") == 1).alias("single"), F.sum("_n").alias("_n"))
            .where("_n > 1").drop("_n"))


def _urn(base: Column, kind: str) -> Column:
    h = F.md5(F.concat(base, F.lit(kind)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"),
                    part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def _record(headers: list, block: Column) -> Column:
    """One record without its ending; null header values are left out."""
    lines = [F.lit(VERSION)] + [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _uri(url: Column) -> Column:
    """``url`` for a header: blanks and control characters percent-encoded."""
    out = F.regexp_replace(url, "\r", "%0D")
    out = F.regexp_replace(out, "\n", "%0A")
    return F.regexp_replace(out, "[\\x00-\\x20\\x7F]", "%20")


def transactions(pages: DataFrame, first: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: the request, response or revisit, and metadata records of each
    page, separated like records of an archive."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    f = first.select(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "first_id", "single")
    p = p.join(f, (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    copy = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    # Record ids of a response follow from its page and payload, so revisits can name it.
    named = lambda page: F.concat(F.lit("response "), page.cast("string"), F.lit(" "), F.col("digest"))
    p = p.withColumn("_own", F.expr("uuid()")).withColumn("_copy", copy)
    target = F.when(F.col("_copy"), _urn(named(F.col("first_id")), "payload"))
    p = (p.withColumn("_target", target)
         .withColumn("_names", F.when(F.col("first_id").isNotNull() & ~F.col("_copy"), _urn(named(F.col("page_id")), "payload"))))
    p = p.withColumn("_id", F.coalesce(F.when(F.col("single"), F.col("_names")), _urn(F.col("_own"), "capture")))
    uri, day, sha = _uri(F.col("url")), F.lit(date), F.concat(F.lit("sha256:"), F.col("digest"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.col("_own"), "request")),
                       ("WARC-Date", day), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("_id")),
                       ("Content-Type", F.lit("application/http;msgtype=request"))],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    capture = [("WARC-Record-ID", F.col("_id")), ("WARC-Date", day), ("WARC-Target-URI", uri),
               ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", sha)]
    response = _record([("WARC-Type", F.lit("response")), *capture], F.concat(http, F.col("html")))
    revisit = _record([("WARC-Type", F.lit("revisit")), *capture, ("WARC-Profile", F.lit(PROFILE)),
                       ("WARC-Refers-To", F.col("_target"))], http)
    about = F.to_json(F.struct("page_id", "url", F.col("_names").alias("payload_id")))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.col("_own"), "metadata")),
                        ("WARC-Date", day), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("_id")),
                        ("Content-Type", F.lit("application/json"))], about)
    main = F.when(F.col("_copy"), revisit).otherwise(response)
    return p.select(F.concat_ws(END, request, main, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, min_bytes: int = MIN_REVISIT,
                   date: str = DATE) -> None:
    """Write all pages as WARC archives under ``path``."""
    first = stored(repeated_payloads(pages, min_bytes), "warc-repeated")
    if first.count() <= BROADCAST_KEYS:
        first = F.broadcast(first)
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0.0
    per_file = max(1, int(archive_bytes / (mean + 1500)))  # 1500: headers of three records
    (transactions(pages, first, date).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path))


_RECORDS = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()), T.StructField("stated_digest", T.StringType()),
    T.StructField("stated_bytes", T.LongType()), T.StructField("payload", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType())])


def _headers(block: bytes) -> dict:
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return {name.strip().lower(): value.strip().decode("utf-8") for name, _, value in pairs}


def _records(data: memoryview, whole: bytes, name: str):
    """Rows of ``_RECORDS`` of one archive, found by Content-Length."""
    at, end = 0, END.encode()
    while at < len(data):
        if whole[at:at + 5] != b"WARC/":
            raise ValueError(f"{name}: no WARC record at byte {at}")
        stop = whole.find(end, at)
        if stop < 0:
            raise ValueError(f"{name}: record at byte {at} is cut off")
        head = _headers(whole[at:stop])
        start = stop + len(end)
        done = start + int(head[b"content-length"])
        if whole[done:done + len(end)] != end:
            raise ValueError(f"{name}: record at byte {at} is cut off")
        kind, stated, size = head[b"warc-type"], head.get(b"warc-payload-digest"), None
        body = start
        if kind in ("response", "revisit"):
            body = whole.find(end, start, done) + len(end)
            if body < len(end):
                raise ValueError(f"{name}: record at byte {at} has no end of its HTTP headers")
            size = int(_headers(whole[start:body - len(end)]).get(b"content-length", done - body))
        payload = bytes(data[body:done])
        yield (kind, head[b"warc-record-id"], head.get(b"warc-concurrent-to"), head.get(b"warc-target-uri"),
               head.get(b"warc-refers-to"), stated.partition(":")[2] if stated else None, size, payload,
               len(payload), hashlib.sha256(payload).hexdigest())
        at = done + len(end)


def _parse(batches):
    types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def batch(rows):
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        cols[7] = cols[7].cast(pa.string())
        return pa.RecordBatch.from_arrays(cols, names=_RECORDS.names)

    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows, held = [], 0
            whole = content.as_py()
            for r in _records(memoryview(whole), whole, name):
                rows.append(r)
                held += r[8] + 500
                if held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``: headers, payload (of a
    response or revisit: what follows the HTTP headers), its length and digest."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse, _RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture`` (response or revisit record),
    ``request`` and ``metadata`` records, joined through their concurrent-to ids."""
    def of(name, *kinds):
        return records.where(F.col("record_type").isin(*kinds)).select(*[F.col(c).alias(f"{name}_{c}") for c in records.columns])

    # Joined as flat columns and nested at the end, so fields that a query does
    # not use, payloads above all, are not shuffled.
    found = of("capture", "response", "revisit")
    for name in ("request", "metadata"):
        found = found.join(of(name, name), F.col("capture_record_id") == F.col(f"{name}_concurrent_to"), "left")
    nested = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in records.columns])
    return found.select(nested("capture").alias("capture"), *[
        F.when(F.col(f"{name}_record_id").isNotNull(), nested(name)).alias(name) for name in ("request", "metadata")])


_ABOUT = "page_id long, url string, payload_id string"


def pages_of(found: DataFrame) -> DataFrame:
    """Pages of captures, all written by ``write_archives``: page_id, url,
    record_type, payload (null for revisits), its digest and length, and, for
    revisits, the page_id of the response that holds the payload."""
    about = F.from_json("metadata.payload", _ABOUT)
    p = found.select(about.alias("about"), "capture.record_type", F.col("capture.refers_to").alias("_target"), "capture.payload",
                     "capture.payload_digest", "capture.payload_bytes", "capture.stated_digest", "capture.stated_bytes")
    p = p.select("about.page_id", "about.url", "about.payload_id", *p.columns[1:])
    # Responses that revisits can name; those alike in page and payload are one.
    named = (p.where("payload_id is not null").groupBy("payload_id")
             .agg(F.first("page_id").alias("_first"), F.first("payload_digest").alias("_digest"), F.first("payload_bytes").alias("_bytes")))
    named = stored(named, "warc-named")
    if named.count() <= BROADCAST_KEYS:
        named = F.broadcast(named)
    p = p.drop("payload_id").join(named, F.col("_target") == F.col("payload_id"), "left")
    copy = F.col("record_type") == "revisit"
    digest = F.when(copy, F.col("_digest")).otherwise(F.col("payload_digest"))
    size = F.when(copy, F.col("_bytes")).otherwise(F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("payload does not match its record: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    good = digest.eqNullSafe(F.col("stated_digest")) & size.eqNullSafe(F.col("stated_bytes"))
    return p.select("page_id", "url", "record_type", F.when(~copy, F.col("payload")).alias("payload"),
                    F.when(good, digest).otherwise(wrong.cast("string")).alias("payload_digest"), size.alias("payload_bytes"),
                    F.when(copy, F.col("_first")).alias("refers_to"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = os.path.join(checkpoint_dir(spark), f"warc-{uuid.uuid4().hex}")
    write_archives(table(spark, sf_dir, "pages"), path)
    return pages_of(captures(read_records(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS copy FROM f)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN copy THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copy THEN first_id END AS refers_to
FROM r
"""
