"""A content-addressed WARC archive.

An archive is a folder of two tables: ``payloads`` holds the bytes of each distinct payload once, under its SHA-256;
``records`` holds the exact header bytes of every record, and the digest of its payload. Reading joins both, checks
every stored payload against its digest, and gives the records as they were.

Null html is the empty payload. Of records with equal payloads of at least ``least`` bytes, that with the largest
page_id is the response and the others revisit it; smaller payloads are always responses. A record without page_id
is a response, and so is each of several rows that repeat the largest page_id. Line ends in a URL are percent-coded
in headers; a null URL has no target line. Record ids hold the archive's own, so they differ between archives. Texts of
any length are stored whole. An empty table makes an empty archive. Extra columns aren't read.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(kind: Column, page_id: Column, url: Column, sha1: Column, size: Column, refers: Column, archive: str, date: str) -> Column:
    name = f"urn:page:{archive}:"
    safe = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    none = F.lit("")
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit(f"<{name}"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.when(url.isNull(), none).otherwise(line("WARC-Target-URI", safe)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(refers.isNull(), none).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{name}"), refers.cast("string"), F.lit(">"))))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))),
        F.lit("\r\n"),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, least: int = 1000, date: str | None = None) -> None:
    """Writes the archive of ``pages`` (page_id, url, html) below ``path``; ``date`` is that of its records, or now."""
    spark, archive = pages.sparkSession, uuid.uuid4().hex
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # One shuffle of payloads, each partition sending a distinct one once.
    rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")
    keepers = spark.read.parquet(f"{path}/payloads").select("digest", "keeper")
    heads = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    heads = heads.join(keepers, "digest")
    again = (F.col("size") >= least) & (F.col("page_id") < F.col("keeper"))
    heads = heads.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("refers", F.when(again, F.col("keeper")))
    heads.select("page_id", "digest", _header(F.col("kind"), F.col("page_id"), F.col("url"), F.col("sha1"), F.col("size"), F.col("refers"), archive, date).alias("header")).write.parquet(f"{path}/records")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest and payload; a payload that doesn't have its digest ends the read with an error."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("digest")
    return stored.select("digest", F.when(right, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), "digest"))).alias("payload"))


def _field(name: str) -> Column:
    text = F.col("header").cast("string")
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, digest and size of the full payload, and the whole record as bytes."""
    whole = spark.read.parquet(f"{path}/records").join(read_payloads(spark, path), "digest")
    kind = _field("WARC-Type")
    body = F.when(kind == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    number = lambda c: F.regexp_extract(c, "<urn:page:[0-9a-f]+:(-?[0-9]+)>", 1).try_cast("long")
    return whole.select(
        number(_field("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        number(F.coalesce(_field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.concat("header", body, F.lit("\r\n\r\n").cast("binary")).alias("record"),
    )


def archive_and_read(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the archive of ``pages`` into the shared folder and reads its records back."""
    path = shared_path(pages.sparkSession, "archive")
    write_archive(pages, path, least)
    return read_records(pages.sparkSession, path)
