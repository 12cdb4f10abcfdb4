"""A content-addressed web archive: payload bytes once per digest, record headers beside them.

``write_archive`` leaves two tables below a folder: ``payloads`` (digest, payload, one row per
distinct payload) and ``headers`` (the exact bytes of every record's WARC header, in page order per
file). ``read_archive`` takes every fact about a record from those bytes and joins it to its
payload, whose digest and length it computes anew and compares with what the header says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import join_by_size, table
from perfsieve.session import work_folder

# Payloads below this many bytes are stored as responses even where they repeat.
LEAST_REVISIT_BYTES = 100
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """One header line; nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def _header() -> Column:
    """The header block of a record; a revisit carries no payload, its length line says so."""
    revisit = F.col("refers_to").isNotNull()
    # A line break inside a URL would start a new header line.
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        F.when(revisit, F.lit("WARC-Type: revisit" + CRLF)).otherwise(F.lit("WARC-Type: response" + CRLF)),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF)),
        _line("WARC-Refers-To", _urn(F.col("refers_to"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}")).otherwise(F.lit("")),
        F.lit("Content-Type: text/html" + CRLF),
        F.when(revisit, F.lit("Content-Length: 0" + CRLF)).otherwise(_line("Content-Length", F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least: int = LEAST_REVISIT_BYTES,
) -> None:
    """Store ``pages`` below ``path``.

    Null payloads count as empty, a null url leaves its line out, a null id its record id. Copies
    are merged before the shuffle, so a payload that a third of the pages share moves once per map
    task. Two payloads of one digest, were there any, end the run: their lengths and a second hash
    are compared. Rows that repeat id and payload are each a record. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    second = F.struct(F.octet_length("payload"), F.xxhash64("payload"))
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_page"),
        F.count(F.lit(1)).alias("records"),
        (F.min(second) == F.max(second)).alias("same"),
    )
    checked = F.when(F.col("same"), F.col("digest")).otherwise(F.raise_error(F.lit("two payloads share a digest")))
    stored.select(checked.alias("digest"), "payload", "first_page", "records").write.option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")
    owners = spark.read.parquet(f"{path}/payloads").select("digest", "first_page", "records")
    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    placed = join_by_size(narrow, owners, "digest", "records", F.xxhash64("page_id", "url"))
    follows = (F.col("bytes") >= least) & (F.col("page_id") != F.col("first_page"))
    heads = placed.withColumn("refers_to", F.when(follows, F.col("first_page")))
    heads.select(F.encode(_header(), "UTF-8").alias("header"), "digest").write.option("compression", "zstd").parquet(
        f"{path}/headers"
    )


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract(F.col("text"), rf"(?md)^{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Every record, as its header bytes tell it."""
    text = spark.read.parquet(f"{path}/headers").select("header", F.decode("header", "UTF-8").alias("text"))
    return text.select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Target-URI", "([^\\r\\n]*)").alias("url"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
        _field("Content-Length", "([0-9]+)").cast("long").alias("content_length"),
        "header",
    )


def _verified(payloads: DataFrame) -> Column:
    """The digest of the stored bytes; a payload that does not hash to its key ends the run."""
    measured = F.sha2("payload", 256)
    return F.when(measured == F.col("digest"), measured).otherwise(F.raise_error(F.lit("payload does not match its digest")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the facts of its full payload, which a revisit takes from its response."""
    payloads = spark.read.parquet(f"{path}/payloads")
    facts = payloads.select(
        "digest",
        _verified(payloads).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        "records",
    )
    records = join_by_size(read_headers(spark, path), facts, "digest", "records", F.xxhash64("header"))
    length_ok = (F.col("record_type") == "revisit") | (F.col("content_length") == F.col("payload_bytes"))
    size = F.when(length_ok, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("record length differs")).cast("long"))
    return records.select("page_id", "url", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, payload (full) and record (the exact WARC bytes) of every record."""
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    whole = read_headers(spark, path).join(payloads, "digest", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return whole.select(
        "page_id", "record_type", "payload", F.concat("header", body, F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record")
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc-archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    found = read_archive(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc_archive": _query}
CHECKS = {
    "op5_warc_archive": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, min(page_id) AS first_page FROM p GROUP BY t)
SELECT p.page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, sha256(p.t) AS payload_digest,
  CASE WHEN strlen(p.t) >= 100 AND p.page_id <> g.first_page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p.t) >= 100 AND p.page_id <> g.first_page THEN g.first_page END AS refers_to
FROM p JOIN g ON p.t = g.t
"""
}
