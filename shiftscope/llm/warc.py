"""WARC archives: write captures as transactions, read them back assembled.

A capture is written as four parts that belong together: a *request*, a
*response* (or a *revisit* of an equal payload) and a *metadata* record,
linked by ``WARC-Concurrent-To``.  Reading parses single records and joins
them through those identifiers into one nested row per capture.

Archive format: WARC/1.1 records, gzip-compressed files, written and read
by Spark's own text source with the record separator CRLF CRLF, so archives
live on any file system Spark reaches.  Gzip files are not split; one task
streams a file record by record, holding one record at a time.

Defined results: NULL html is an empty payload; NULL url writes no target;
a url is written and read as it is, save for line breaks (percent-encoded)
and blanks at its ends (not kept);
NULL ids are written as such and read back as NULL.  Repeated rows are
captures of their own: the first is the response, the others revisit it.
Payloads under ``min_revisit_bytes`` are never revisited.  An empty table
gives an archive without records and an empty result.  Extra columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, shared_folder, text_of

SEP = "\r\n\r\n"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 100
CAPTURES_PER_FILE = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = """record_type string, record_id string, concurrent_to string, refers_to string, target_uri string,
    date string, payload_digest string, payload_bytes long, stored_digest string, fields map<string,string>, payload string"""


def _uuid(kind: str, key: Column) -> Column:
    h = F.sha2(F.concat(F.lit(kind + "|"), key), 256)
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                           for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _header_value(c: Column) -> Column:
    """Line breaks cannot stand in a header line: percent-encode them, nothing else."""
    out = c
    for ch, code in (("\r", "%0D"), ("\n", "%0A")):
        out = F.replace(out, F.lit(ch), F.lit(code))
    return out


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        if isinstance(value, str):
            lines.append(F.lit(f"{name}: {value}"))
        else:  # a NULL value leaves the whole line out
            lines.append(F.concat(F.lit(f"{name}: "), value))
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEP), block)


def plan_captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, digest, n_bytes, copy, record_type, html (responses only).

    The html of large payloads is shuffled once, already reduced to one per
    digest inside every task; everything else that moves is narrow."""
    p = pages.select("page_id", "url", text_of(F.col("html")).alias("html"))
    p = p.select("*", F.sha2(F.col("html").cast("binary"), 256).alias("digest"),
                 F.octet_length("html").cast("long").alias("n_bytes"))
    small = p.filter(F.col("n_bytes") < min_revisit_bytes)
    large = p.filter(F.col("n_bytes") >= min_revisit_bytes)
    key = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id"), F.col("url").isNull().alias("u"), F.col("url"))
    responses = large.groupBy("digest").agg(
        F.min(key).alias("first"), F.any_value("html").alias("html"), F.any_value("n_bytes").alias("n_bytes"))
    firsts = large.groupBy("digest").agg(F.min(key).alias("first"))
    counted = large.groupBy("digest", "page_id", "url", "n_bytes").agg(F.count("*").alias("n"))
    revisits = (counted.join(firsts, "digest")
                .withColumn("is_first", F.col("page_id").eqNullSafe(F.col("first.page_id"))
                            & F.col("url").eqNullSafe(F.col("first.url")))
                .withColumn("from", F.col("is_first").cast("long"))
                .filter(F.col("n") > F.col("from"))
                .withColumn("copy", F.explode(F.sequence(F.col("from"), F.col("n") - 1))))
    small_rows = (small.groupBy("digest", "page_id", "url", "n_bytes", "html").agg(F.count("*").alias("n"))
                  .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))))
    cols = ["page_id", "url", "digest", "n_bytes", "copy", "record_type", "html"]
    return (responses.select(F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"), "digest", "n_bytes",
                             F.lit(0).cast("long").alias("copy"), F.lit("response").alias("record_type"), "html")
            .unionByName(small_rows.withColumn("record_type", F.lit("response")).select(*cols))
            .unionByName(revisits.withColumn("record_type", F.lit("revisit"))
                         .withColumn("html", F.lit(None).cast("string")).select(*cols)))


def capture_text(min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE) -> Column:
    """The records of one capture as archive text (a column over plan_captures)."""
    c = F.col
    own = F.concat_ws("|", F.coalesce(c("page_id").cast("string"), F.lit("\\N")),
                      F.coalesce(c("url"), F.lit("\\N")), c("digest"), c("copy").cast("string"))
    # the response of a large payload is named by its digest alone: revisits know it without a join
    rid = F.when((c("record_type") == "response") & (c("n_bytes") >= min_revisit_bytes), _uuid("response", c("digest"))) \
        .otherwise(_uuid("capture", own))
    uri, digest = _header_value(c("url")), F.concat(F.lit("sha256:"), c("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    c("n_bytes").cast("string"), F.lit(SEP))
    request = _record([
        ("WARC-Type", "request"), ("WARC-Record-ID", _uuid("request", own)), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/http;msgtype=request"),
    ], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{SEP}")))
    response = _record([
        ("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"),
    ], F.concat(http, c("html")))
    revisit = _record([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest), ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", _uuid("response", c("digest"))), ("Content-Type", "application/http;msgtype=response"),
    ], http)
    metadata = _record([
        ("WARC-Type", "metadata"), ("WARC-Record-ID", _uuid("metadata", own)), ("WARC-Date", date),
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields"),
    ], F.concat_ws(CRLF, F.concat(F.lit("pageId: "), c("page_id").cast("string")),
                   F.concat(F.lit("copy: "), c("copy").cast("string"))))
    return F.concat_ws(SEP, request, F.when(c("record_type") == "response", response).otherwise(revisit), metadata)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE,
                  captures_per_file: int = CAPTURES_PER_FILE) -> None:
    """Gzip files are read whole by one task each: ``captures_per_file`` bounds
    them, however many captures a task writes."""
    (plan_captures(pages, min_revisit_bytes).select(capture_text(min_revisit_bytes, date).alias("value"))
     .write.option("lineSep", SEP).option("compression", "gzip").option("maxRecordsPerFile", captures_per_file).text(path))


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split(CRLF)[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _record_row(h: dict[str, str], block: bytes) -> tuple:
    kind, payload, http_length, fields = h.get("warc-type"), None, None, {}
    if h.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http_length = _headers(head).get("content-length")
        if kind == "response":
            payload = body
    elif kind == "metadata":
        fields = _headers(b"\r\n" + block)
    stored = (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
    return (kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"),
            h.get("warc-date"), hashlib.sha256(payload).hexdigest() if payload is not None else stored,
            len(payload) if payload is not None else (int(http_length) if http_length and http_length.isdigit() else None),
            stored, fields, payload.decode("utf-8", "replace") if payload is not None else None)


def _parse(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of the files of a task, from text rows cut at CRLF CRLF.

    Payloads may hold the separator themselves: the block's Content-Length
    decides, pieces are put together until it is reached."""
    names = [x.split()[0] for x in RECORD_SCHEMA.replace("\n", " ").replace("map<string,string>", "map").split(",")]
    buf, need, head = bytearray(), 0, None
    for pdf in chunks:
        rows = []
        for piece in pdf["value"]:
            if head is None and not buf and not piece.strip():
                continue  # what a block's own final line break leaves behind
            buf += piece
            buf += b"\r\n\r\n"
            if len(buf) < need:
                continue
            if head is None:
                while buf[:1] in (b"\r", b"\n"):
                    del buf[:1]
                end = buf.find(b"\r\n\r\n")
                if end < 0:
                    continue
                head = _headers(bytes(buf[:end]))
                start = end + 4
                need = start + int(head.get("content-length", 0))
                if len(buf) < need:
                    continue
            rows.append(_record_row(head, bytes(buf[start:need])))
            del buf[:need]
            while buf[:1] in (b"\r", b"\n"):
                del buf[:1]
            head, need = None, 0
        yield pd.DataFrame(rows, columns=names)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", SEP).text(path).select(F.col("value").cast("binary").alias("value"))
    return raw.mapInPandas(_parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: request and metadata records joined to
    the response or revisit that they were recorded with."""
    r = records
    main = r.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "record_type", "refers_to", "target_uri", "date", "payload_digest",
        "payload_bytes", "stored_digest", "payload")
    request = r.filter(F.col("record_type") == "request").select(
        F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "target_uri", "date").alias("request"))
    meta = r.filter(F.col("record_type") == "metadata").select(
        F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return (main.join(request, "capture_id", "left").join(meta, "capture_id", "left")
            .select("capture_id", "record_type", "refers_to", "target_uri", "date", "request", "metadata",
                    F.struct("payload_digest", "payload_bytes", "stored_digest", "payload").alias("response")))


def op9_warc(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back, one row per page."""
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archive(pages, path)
    # parsed once: what the captures are assembled from here has no payload
    records = cut_lineage(read_records(spark, path).withColumn("payload", F.lit(None).cast("string")))
    caps = assemble(records).select(
        "capture_id", "record_type", "refers_to",
        F.col("metadata.fields")["pageid"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"))
    target = caps.filter(F.col("record_type") == "response").select(
        F.col("capture_id").alias("refers_to"), F.col("page_id").alias("refers_page"))
    return caps.join(target, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER (ORDER BY page_id, url) AS r FROM pages),
d AS (SELECT *, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, first_value(page_id) OVER w AS first_id, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id, r))
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND k > 1 THEN first_id END AS refers_to
FROM f"""
