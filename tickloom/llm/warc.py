"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds every distinct payload once under
its SHA-256 digest, ``records`` the exact header block of every record and the
digest it points to. A join gives the original records back.

Defined results: a null payload is an empty one; a null URL has no
WARC-Target-URI line; control characters of a URL are percent-encoded; a null
page id prints as an empty string and ranks below all others. Rows that repeat
both payload and page id are records of their own: one is the response, the
others revisit it. An empty table gives an empty archive. Other columns of the
input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.skew import lookup
from tickloom.llm.store import shared_folder, stored

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    records: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: eight groups of 20 bits, four characters each."""
    digest = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)
    ]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def content_key(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column, serial: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), serial.cast("string"), F.lit(">"))


def write_archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_payload_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Write one record per row. Of equal payloads of at least ``min_payload_bytes``
    bytes the row with the largest page id is the response and the others revisit it."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    )
    # Narrow rows first, stored: serial numbers are fixed and digests computed once.
    narrow = stored(
        rows.select(
            F.monotonically_increasing_id().alias("serial"),
            "page_id",
            "url",
            content_key(F.col("payload")).alias("content"),
            base32_sha1(F.col("payload")).alias("digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
        ),
        "warc-rows",
    )
    first = narrow.groupBy("content").agg(F.max(F.struct("page_id", "serial")).alias("first"))
    joined = lookup(narrow, first, "content", F.col("serial"))
    shared = F.col("payload_bytes") >= min_payload_bytes
    revisit = shared & (F.col("serial") != F.col("first.serial"))
    safe_url = F.col("url")
    for code in range(32):
        safe_url = F.replace(safe_url, F.lit(chr(code)), F.lit(f"%{code:02X}")) if code in (0, 9, 10, 13) else safe_url
    header = F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("serial"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", safe_url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first.page_id"), F.col("first.serial")))),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    archive = Archive(shared_folder(spark, "warc-records"), shared_folder(spark, "warc-payloads"))
    joined.select("content", header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(archive.records)
    # Equal digests must mean equal bytes: length and a second hash agree within each.
    second = F.xxhash64("payload")
    distinct = rows.groupBy(content_key(F.col("payload")).alias("content")).agg(
        F.first("payload").alias("payload"),
        (F.min(second) == F.max(second)).alias("same"),
    )
    distinct.select(
        "content",
        F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary")).alias("payload"),
    ).write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record again: ``header``, ``payload`` (the full one, also for revisits)
    and ``record``, the exact bytes of the WARC record (a revisit has an empty block)."""
    records = spark.read.schema("content binary, header binary").parquet(archive.records)
    payloads = spark.read.schema("content binary, payload binary").parquet(archive.payloads)
    checked = payloads.select(
        "content",
        F.when(content_key(F.col("payload")) == F.col("content"), F.col("payload"))
        .otherwise(F.raise_error(F.lit("stored payload does not match its digest")).cast("binary"))
        .alias("payload"),
    )
    whole = lookup(records, checked, "content", F.col("header"))
    text = F.decode("header", "UTF-8")
    block = F.when(_field(text, "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit(2 * CRLF).cast("binary")
    return whole.select("header", "payload", F.concat("header", block, end).alias("record"))


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(value != "", value)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of the records read back, with length and digest computed from the payload bytes."""
    header = F.decode("header", "UTF-8")
    digest = base32_sha1(F.col("payload"))
    fields = records.select(
        F.regexp_extract(_field(header, "WARC-Record-ID"), r"^<urn:page:([^:]*):", 1).alias("page_id"),
        _field(header, "WARC-Target-URI").alias("url"),
        _field(header, "WARC-Type").alias("record_type"),
        F.regexp_extract(_field(header, "WARC-Refers-To"), r"^<urn:page:([^:]*):", 1).alias("refers_to"),
        _field(header, "WARC-Payload-Digest").alias("stated"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )
    right = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("stated")
    return fields.select(
        F.when(F.col("page_id") != "", F.col("page_id")).cast("long").alias("page_id"),
        "url",
        "payload_bytes",
        F.when(right, F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload does not match its record")).cast("string")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to") != "", F.col("refers_to")).cast("long").alias("refers_to"),
        "record_bytes",
    )
