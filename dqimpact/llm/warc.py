"""Web archive in two tables: payloads, each stored once under its digest, and exact record headers.

The strong digest (SHA-256) is the address of a payload; the record headers carry the usual SHA-1 of the
format.  Of the records with one payload the one with the smallest id is the response, the others are
revisits that name it.  Which record that is comes from a small aggregate (one row for each digest, with
minima taken on the map side), and the payloads are picked by record id, so that a payload shared by a
third of all records is never gathered.  Reading joins headers and payloads again, checks every payload
against its address and gives back whole records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "\r\n"
# The alphabet of base 32, and the lines of a record of this format that never change.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
DATE = "1970-01-01T00:00:00Z"


def _digit(hex_digits: Column, shift: int) -> Column:
    place = F.shiftright(F.conv(hex_digits, 16, 10).cast("int"), shift).bitwiseAND(F.lit(31))
    return F.substring(F.lit(BASE32), place + 1, F.lit(1))


def _base32(sha1_hex: Column) -> Column:
    """Bare upper-case base 32 of a SHA-1 in hex digits: eight times 20 bits, four characters each."""
    return F.concat(
        *[_digit(F.substring(sha1_hex, 5 * i + 1, 5), k) for i in range(8) for k in (15, 10, 5, 0)]
    )


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(LINE))).otherwise("")


def _one_line(value: Column) -> Column:
    """Line ends cannot stand in a header; they are percent-encoded."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Write headers and payloads of `pages` (page_id, url, html) below `path`.

    Payloads of fewer than `min_revisit_bytes` bytes are all responses.  Defined results for odd rows: a
    null html is an empty payload, a null url leaves its header out; rows with one page_id and one payload
    are the same kind of record, so repeated rows of the smallest page_id are all responses; a page_id of
    null comes after all others and cannot be referred to unless its payload has no other record; further
    columns are left out.
    """
    whole = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    digest = F.sha2("payload", 256)
    facts = whole.select("page_id", "url", digest.alias("digest"), F.sha1("payload").alias("sha1"),
                         F.octet_length("payload").cast("long").alias("bytes"))
    # min leaves nulls out: a payload of null ids only has no id to refer to.
    first = facts.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    told = facts.join(first, "digest")
    answer = (F.col("bytes") < min_revisit_bytes) | F.col("first_id").isNull() | F.col("page_id").eqNullSafe(
        F.col("first_id")
    )
    kind = F.when(answer, "response").otherwise("revisit")
    refers = F.when(~answer, F.concat(F.lit(f"<{RECORD}"), F.col("first_id").cast("string"), F.lit(">")))
    header = F.concat(
        F.lit(f"{VERSION}{LINE}"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", _one_line(F.col("url"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        _header("WARC-Refers-To", refers),
        _header("WARC-Profile", F.when(~answer, F.lit(SAME_PAYLOAD))),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(answer, F.col("bytes")).otherwise(0).cast("string")),
        F.lit(LINE),
    )
    told.select("page_id", "digest", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")

    # The smallest page_id of a digest stands for it; with null ids only, the digest itself is the key.
    named = whole.select("page_id", digest.alias("digest"), "payload")
    held = named.join(first.withColumnRenamed("first_id", "page_id").filter("page_id is not null"), ["digest", "page_id"], "left_semi")
    loose = named.filter("page_id is null").join(first.filter("first_id is null"), "digest", "left_semi")
    # Repeated rows of that page_id are equal, and stand in one partition already.
    once = held.dropDuplicates(["digest", "page_id"]).unionByName(loose.dropDuplicates(["digest"]))
    once.select("digest", "payload").write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload, verified: whole records; `verified` tells that the payload fits its address."""
    headers = spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = payloads.withColumn("verified", F.sha2("payload", 256) == F.col("digest"))
    return headers.join(checked, "digest").select("page_id", "header", "payload", "verified")


def raw_record(header: Column, payload: Column, answer: Column) -> Column:
    """The bytes of a record as it stands in a file: a revisit has no block of its own."""
    end = F.encode(F.lit(LINE * 2), "UTF-8")
    return F.concat(header, F.when(answer, payload).otherwise(F.encode(F.lit(""), "UTF-8")), end)


def header_value(header: Column, name: str) -> Column:
    found = F.regexp_extract(F.decode(header, "UTF-8"), f"(?m)^{name}: (.*?)\\r?$", 1)
    return F.when(found != "", found)


def record_facts(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified, read from whole records."""
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        _base32(F.sha1("payload")).alias("payload_digest"),
        header_value(F.col("header"), "WARC-Type").alias("record_type"),
        F.regexp_extract(header_value(F.col("header"), "WARC-Refers-To"), f"{RECORD}(-?[0-9]+)", 1)
        .cast("long")
        .alias("refers_to"),
        "verified",
    )
