"""A content-addressed web archive.

``payloads`` holds the bytes of each distinct payload once, under its SHA-256. ``records`` holds one WARC/1.1 record
header block for each page, byte for byte, with the address of its payload. Reading joins the two again; each stored
payload is hashed anew and compared with its address, so damage shows as ``verified = false``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import cut

# The WARC/1.1 profile of a revisit, the base-32 alphabet and the date given to records without one.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"


def sha1_base32(data: Column) -> Column:
    """Upper-case base-32 SHA-1: 160 bits are 8 groups of 5 hex digits, each of which is 4 base-32 digits."""
    digest = F.sha1(data)
    digits = []
    for group in range(8):
        bits = F.conv(F.substring(digest, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*digits)


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
) -> None:
    """Write ``records`` and ``payloads`` below ``path``.

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest id is the response
    (of several rows with that id, the last read) and the others revisit it; smaller ones are all responses. A null payload
    is the empty one; a null id is smaller than any other; a null url leaves its header out; control characters in a
    url are written as %XX. Repeated rows are records of their own. Other columns are not read.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"))
    facts = cut(
        source.select(
            F.monotonically_increasing_id().alias("rid"),
            "id",
            F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
            F.octet_length("payload").cast("long").alias("size"),
            F.sha2("payload", 256).alias("address"),
            sha1_base32(F.col("payload")).alias("digest"),
        )
    )
    first = cut(facts.groupBy("address").agg(F.max(F.struct("id", "rid")).alias("keep")))
    typed = facts.join(first, "address").withColumn(
        "revisit", (F.col("size") >= min_revisit_bytes) & (F.col("rid") != F.col("keep.rid"))
    )
    headers = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("id"))),
        F.coalesce(_header("WARC-Target-URI", F.col("url")), F.lit("")),
        _header("WARC-Date", F.lit(NO_DATE)),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            F.col("revisit"),
            F.concat(_header("WARC-Profile", F.lit(REVISIT_PROFILE)), _header("WARC-Refers-To", _record_id(F.col("keep.id")))),
        ).otherwise(""),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(F.col("revisit"), 0).otherwise(F.col("size")).cast("string")),
    )
    typed.select("rid", F.col("address").alias("payload_address"), headers.alias("headers")).write.parquet(f"{path}/records")
    held_as = F.concat("address", F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit("none")))
    wanted = first.select("address", F.col("keep.id").alias("id")).select(held_as.alias("held_as"))
    (
        source.withColumn("address", F.sha2("payload", 256))
        .withColumn("held_as", held_as)
        .join(wanted, "held_as")
        .select("held_as", "address", "payload")
        .dropDuplicates(["held_as"])  # dealt as the join's rows already are; each address is held as one
        .select("address", "payload")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("headers", f"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def _page_of(name: str) -> Column:
    return F.regexp_extract("headers", f"\r\n{name}: <urn:page:([^>]*)>", 1).try_cast("long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, from the archive: the header fields, and size and state of its payload as stored.

    A page without an id, or without a url, has null there; a null payload was written as an empty one. Rows that were repeated are records
    of their own. A record whose payload is missing has null payload_bytes and isn't verified. An archive of no pages has no records.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        F.col("address").alias("payload_address"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        sha1_base32(F.col("payload")).alias("stored_digest"),
        (F.sha2("payload", 256) == F.col("address")).alias("intact"),
    )
    return (
        spark.read.parquet(f"{path}/records")
        .join(stored, "payload_address", "left")
        .select(
            _page_of("WARC-Record-ID").alias("page_id"),
            "payload_bytes",
            F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
            _field("WARC-Type").alias("record_type"),
            _page_of("WARC-Refers-To").alias("refers_to"),
            _field("WARC-Target-URI").alias("url"),
            (
                F.coalesce("intact", F.lit(False))
                & F.coalesce(F.col("stored_digest") == F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""), F.lit(False))
            ).alias("verified"),
        )
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The original pages: page_id, url, payload (bytes) and record, the exact bytes of the WARC record.

    A page for each record whose payload is there, repeated ones too; ids and urls that were null are null, and a null payload is empty.
    """
    joined = spark.read.parquet(f"{path}/records").join(
        spark.read.parquet(f"{path}/payloads").withColumnRenamed("address", "payload_address"), "payload_address"
    )
    body = F.when(_field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.select(
        _page_of("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        "payload",
        F.concat(F.concat("headers", F.lit(CRLF)).cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"),
    )
