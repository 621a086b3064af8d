"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; record headers are stored exactly,
apart from the payloads; a join of both gives the original records back. Reading
recomputes each payload's digests and stops on any that does not match. A payload that
many records share is dealt out with its records, ``HOT_ROWS`` of them to one copy, so
no task gathers them all. Records hold the page itself and no HTTP block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm.common import HOT_ROWS, spread_join, stored

# The digits of base 32, in hexadecimal style and in that of RFC 4648.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_BYTES = 0
WARC_DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)\r$", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> None:
    """Write ``{path}/headers`` (record_id, digest, header, copies) and ``{path}/payloads`` (digest, payload, copies).

    Of records with equal payloads of at least ``min_bytes`` bytes the one with the
    smallest identifier is a response and the others are revisits that refer to it;
    records below that are all responses. A null html is an empty payload, a null URL
    has no target line, line breaks in a URL are percent-encoded; a null identifier
    is never the smallest and its record has no identifier line; repeated rows of one
    identifier and payload are alike; column names do not matter; an empty table gives
    an archive without records.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    payloads = keyed.groupBy("digest").agg(F.first("payload").alias("payload"), F.count("*").alias("copies"))
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")

    facts = keyed.select("record_id", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    owners = stored(facts.groupBy("digest").agg(F.min("record_id").alias("owner"), F.count("*").alias("copies")), "owners")
    joined = spread_join(facts, owners, ["digest"], "copies", owners.agg(F.sum("copies")).first()[0] or 0)
    revisit = (F.col("n_bytes") >= min_bytes) & F.col("owner").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("owner"))
    named = lambda c: F.concat(F.lit("<urn:record:"), F.url_encode(c.cast("string")), F.lit(">"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.coalesce(_line("WARC-Record-ID", named(F.col("record_id"))), F.lit("")),
        _line("WARC-Date", F.lit(WARC_DATE)),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Refers-To", named(F.col("owner")))).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    joined.select("record_id", "digest", header.cast("binary").alias("header"), "copies").write.option("compression", "zstd").parquet(f"{path}/headers")


def _verified(payloads: DataFrame) -> DataFrame:
    """The payload table, stopping at bytes that do not match the digest they are stored under."""
    whole = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    return payloads.withColumn("payload", F.when(whole, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.hex("digest"))).cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, header and payload bytes (of revisits too), joined by digest.

    One row for each row that was written, repeated ones repeated, a null identifier null;
    the payload of a null html is empty; an archive without records gives no rows.
    """
    parts = F.ceil(F.col("copies") / HOT_ROWS).cast("int")
    headers = spark.read.parquet(f"{path}/headers").withColumn("part", F.pmod(F.xxhash64("record_id", "header"), parts).cast("int"))
    payloads = _verified(spark.read.parquet(f"{path}/payloads")).select("digest", "payload", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return headers.drop("copies").join(payloads, ["digest", "part"]).select("record_id", "header", "payload")


def read_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """What the archive says of each of its records, with lengths and digests taken from the records as they are put together again.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to. A header
    that names another digest than its payload has stops the job. Cases as for
    ``read_records``.
    """
    header = F.col("header").cast("string")
    parsed = read_records(spark, path).select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        _field(header, "WARC-Type").alias("record_type"), _field(header, "WARC-Payload-Digest").alias("__named"),
        F.url_decode(F.regexp_extract(_field(header, "WARC-Refers-To"), "^<urn:record:(.*)>$", 1)).cast(id_type).alias("refers_to"),
    )
    same = F.col("__named") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    checked = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload digests differ")))
    return parsed.select(F.col("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
