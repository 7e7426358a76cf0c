"""A content-addressed archive of WARC records.

A payload is stored once, under its SHA-256. Record headers are kept apart, byte for byte, with the digest of the
payload they describe, and reading joins the two: a record is its header, for a response followed by its payload.
Of records with equal payloads of ``least`` bytes or more, that with the smallest id is the response, the others are
revisits that refer to it. On reading, each stored payload is hashed again, and a digest that differs is an error.

Everything is DataFrame operations. Only digests and ids move to find the responses; a payload moves once, to meet its
copies, which each task has already reduced to one. Reading moves no payload unless whole records are asked for.

A record's id is that of its page and the number of its row, so it is its own also where a page's row is repeated.

Nulls: a null body is an empty payload, a null URL an empty one; a null id is the largest, and refers to nothing.
Repeated rows are records each; of two with the smallest id and equal payloads both are responses, and revisits refer to
the first of them. An empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# The names of the WARC format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
END = "\r\n"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100, date: Column | None = None) -> None:
    """Write the archive of a record per row to the folder ``uri``: ``payloads`` and ``headers``.

    ``date``: when a page was captured, as the format has it; not given, the time of writing.
    """
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    when = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date is None else date
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url_col, F.lit("")).alias("url"), when.alias("date"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{uri}/payloads")
    keys = rows.select("id", "url", "date", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    keys = shared.written(keys, "warc-keys")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    first = keys.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bytes").alias("b")).where(f"b >= {least}").select("digest", "n", F.col("first.id").alias("first"), F.col("first.row").alias("first_row"))
    typed = shared.spread_join(keys, first, "digest", keys.count(), "left")
    typed = typed.withColumn("revisit", F.col("first_row").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    urn = lambda c, row: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.col(row).cast("string"), F.lit(">"))
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit(f"{VERSION}{END}"),
        _field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _field("WARC-Record-ID", urn("id", "row")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", clean),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(_field("WARC-Refers-To", urn("first", "first_row")), _field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(END),
    )
    typed.select(header.cast("binary").alias("header"), "digest").write.option("compression", "zstd").parquet(f"{uri}/headers")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """(header, payload, payload_bytes, payload_digest): the records' headers with their full, verified payloads."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{uri}/payloads")
    again = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    stored = stored.select(F.col("digest"), "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(again == F.col("digest"), again).otherwise(wrong).alias("payload_digest"))
    headers = spark.read.schema("header binary, digest string").parquet(f"{uri}/headers")
    return headers.join(stored, "digest").select("header", "payload", "payload_bytes", "payload_digest")


def parsed(records: DataFrame) -> DataFrame:
    """``records`` with the fields of their headers: record_type, id, url, refers_to."""
    text = F.col("header").cast("string")
    get = lambda name, value=r"([^\r\n]*)": F.regexp_extract(text, rf"\n{name}: {value}\r", 1)
    number = lambda name: F.nullif(get(name, rf"<{URN}([^\r\n]*):\d+>"), F.lit(""))
    return records.withColumns({"record_type": get("WARC-Type"), "id": number("WARC-Record-ID"), "url": get("WARC-Target-URI"), "refers_to": number("WARC-Refers-To")})


def records(read_records: DataFrame) -> DataFrame:
    """(record binary): the original records, header, block and end."""
    revisit = F.col("header").cast("string").contains(f"WARC-Type: revisit{END}")
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return read_records.select(F.concat("header", block, F.lit(END * 2).cast("binary")).alias("record"))
