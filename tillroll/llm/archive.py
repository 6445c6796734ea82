"""A content-addressed web archive.

An archive is a folder of two tables. ``payloads`` holds each payload's bytes once, under their SHA-256;
``headers`` holds the exact WARC header of every record, with the SHA-256 of its payload. Of the records of one
payload, the one with the largest id is the response and the others revisit it. Joins on the digest give the
original records back, and whoever reads a payload checks its digest first.

Writing shuffles each payload once and drops its copies before the shuffle. Headers meet the payloads' owners,
a few bytes a payload; a payload that a third of all records share is an ordinary skewed join there, which
adaptive execution splits. Reading records without their bytes does not move the payloads at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.texts import as_text

DATE = "1970-01-01T00:00:00Z"  # of records whose time of capture is not known
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# The alphabet of RFC 4648, fixed.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """A hexadecimal digest of 160 bits in base 32; five hexadecimal digits make four characters."""
    parts = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(digest, start, 5), 16, 10).cast("int")
        places = [F.shiftright(bits, shift).bitwiseAND(31) + 1 for shift in (15, 10, 5, 0)]
        parts += [F.substr(F.lit(BASE32), place, F.lit(1)) for place in places]
    return F.concat(*parts)


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _header(record_type: Column, date: str) -> Column:
    """Header lines of a record and the empty line behind them. A line break in an address is escaped."""
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    refers_to = F.concat(_line("WARC-Refers-To", _urn(F.col("owner"))), _line("WARC-Profile", F.lit(PROFILE)))
    revisit = record_type == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", record_type),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        F.coalesce(_line("WARC-Target-URI", address), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, refers_to).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
    date: str = DATE,
) -> None:
    """Write a record for each row of pages below folder, which must not hold an archive yet.

    A null payload is empty; payloads of fewer than least_bytes are never revisited. A null address leaves its
    line out. Of a payload's rows all with the largest id are responses, so a repeated row is a second response;
    null ids come last, and are responses where a payload has no other. Other columns are left out. Two payloads
    with one SHA-256 but different lengths or SHA-1 stop the job.
    """
    body = F.encode(F.coalesce(as_text(payload), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"),
        as_text(url).alias("url"),
        body.alias("payload"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    one = F.min(F.struct("sha1", "bytes"))
    stored = rows.groupBy("digest").agg(
        F.max("page_id").alias("owner"),
        F.when(one == F.max(F.struct("sha1", "bytes")), F.first("payload"))
        .otherwise(F.raise_error(F.lit("two payloads have one SHA-256")).cast("binary"))
        .alias("payload"),
    )
    stored.write.parquet(f"{folder}/payloads")
    owners = pages.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "owner")
    known = rows.select("page_id", "url", "digest", "sha1", "bytes").join(owners, "digest")
    own = F.col("page_id").eqNullSafe(F.col("owner")) | (F.col("bytes") < least_bytes)
    kind = F.when(own, "response").otherwise("revisit")
    known.select("digest", _header(kind, date).alias("header")).write.parquet(f"{folder}/headers")


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload) with each payload checked against its digest."""
    rows = spark.read.parquet(f"{folder}/payloads")
    damaged = F.raise_error(F.lit("a payload differs from its digest")).cast("binary")
    intact = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return rows.select("digest", F.when(intact, F.col("payload")).otherwise(damaged).alias("payload"))


def _field(name: str) -> Column:
    """A header field's value, null where the header has none. Only a line feed starts a line."""
    value = F.regexp_extract("header", rf"(?dm)^{name}: ([^\r]*)", 1)
    return F.when(F.col("header").rlike(rf"(?dm)^{name}: "), value)


def _id(name: str, kind: str) -> Column:
    value = F.regexp_extract("header", rf"(?dm)^{name}: <urn:page:([^>\r]*)>", 1)
    return F.when(value != "", value).cast(kind)


def read_records(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, header) of every record.

    The length and the digest are worked out anew from the stored bytes; a header that tells another digest
    stops the job.
    """
    found = _payloads(spark, folder).select(
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
    )
    same = F.concat(F.lit("sha1:"), F.col("payload_digest")) == _field("WARC-Payload-Digest")
    other = F.raise_error(F.lit("a header tells another digest"))
    return spark.read.parquet(f"{folder}/headers").join(found, "digest").select(
        _id("WARC-Record-ID", id_type).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(other).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _id("WARC-Refers-To", id_type).alias("refers_to"),
        "header",
    )


def reconstruct(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(page_id, record, payload): the record's text as a WARC file has it, and the page it stands for.

    A revisit's record has no body; its payload is that of the response.
    """
    body = F.decode("payload", "UTF-8")
    whole = spark.read.parquet(f"{folder}/headers").join(_payloads(spark, folder), "digest")
    record = F.concat("header", F.when(_field("WARC-Type") == "revisit", F.lit("")).otherwise(body))
    page_id = _id("WARC-Record-ID", id_type)
    return whole.select(page_id.alias("page_id"), record.alias("record"), body.alias("payload"))


def export_warc(spark: SparkSession, folder: str, target: str) -> None:
    """Write the records as WARC files, one for each partition."""
    reconstruct(spark, folder).select("record").write.option("lineSep", "\r\n\r\n").text(target)
