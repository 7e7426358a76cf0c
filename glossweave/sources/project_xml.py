"""Project XML: ``<rt class guid ownerguid>`` records with references and texts, scanned record by record.

Files are split at the records' ends by the text reader, so a large file is read by many tasks and never as a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unescaped(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1), F.lit(""))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(guid, class, owner_guid, body): GUIDs in lower case."""
    rows = spark.read.option("lineSep", "</rt>").text(path).where(F.col("value").rlike(r"<rt\s"))
    tag = F.regexp_extract("value", r"<rt\s[^>]*>", 0)
    body = F.regexp_replace("value", r"(?s)^.*?<rt\s[^>]*>", "")
    return rows.select(F.lower(_attribute(tag, "guid")).alias("guid"), _attribute(tag, "class").alias("class"), F.lower(_attribute(tag, "ownerguid")).alias("owner_guid"), body.alias("body"))


def edges(rows: DataFrame) -> DataFrame:
    """(src_guid, field, ordinal, dst_guid, t) of the references in each record's fields, in order."""
    fields = F.regexp_extract_all("body", F.lit(r"(?s)<(\w+)>\s*(?:<objsur\b[^>]*/>\s*)+</\1>"), F.lit(0))
    each = rows.select(F.col("guid").alias("src_guid"), F.explode(fields).alias("f"))
    name = F.regexp_extract("f", r"^<(\w+)>", 1)
    refs = each.select("src_guid", name.alias("field"), F.posexplode(F.regexp_extract_all("f", F.lit(r"<objsur\b[^>]*/>"), F.lit(0))).alias("ordinal", "o"))
    return refs.select("src_guid", "field", "ordinal", F.lower(_attribute(F.col("o"), "guid")).alias("dst_guid"), _attribute(F.col("o"), "t").alias("t"))


def texts(rows: DataFrame) -> DataFrame:
    """(src_guid, field, ws, value) of multilingual and plain texts."""
    multi = rows.select(F.col("guid").alias("src_guid"), F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(\w+)>\s*(?:<AUni\b[^>]*>[^<]*</AUni>\s*)+</\1>"), F.lit(0))).alias("f"))
    multi = multi.select("src_guid", F.regexp_extract("f", r"^<(\w+)>", 1).alias("field"), F.explode(F.regexp_extract_all("f", F.lit(r"<AUni\b[^>]*>[^<]*</AUni>"), F.lit(0))).alias("a"))
    multi = multi.select("src_guid", "field", _attribute(F.col("a"), "ws").alias("ws"), unescaped(F.regexp_extract("a", r">([^<]*)<", 1)).alias("value"))
    plain = rows.select(F.col("guid").alias("src_guid"), F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(\w+)>\s*<Uni>[^<]*</Uni>\s*</\1>"), F.lit(0))).alias("f"))
    plain = plain.select("src_guid", F.regexp_extract("f", r"^<(\w+)>", 1).alias("field"), F.lit(None).cast("string").alias("ws"), unescaped(F.regexp_extract("f", r"<Uni>([^<]*)</Uni>", 1)).alias("value"))
    return multi.unionByName(plain)


def by_class(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("class") == name)


def census(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("occurrences"))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, header_sha256) of each project file: a digest of all that stands before its first record."""
    first = spark.read.option("lineSep", "</rt>").text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike(r"^\s*<\?xml"))
    head = F.regexp_extract("value", r"(?s)^(.*?)(?:<rt\s.*)?$", 1)
    return first.select("file", F.regexp_extract(head, r'<\w+[^>]*\bversion="([^"]*)"[^>]*>\s*(?:<(?!/)|$)', 1).alias("version"), F.sha2(head, 256).alias("header_sha256"))


def dangling(rows: DataFrame) -> DataFrame:
    """Warnings: references to records that are not in the file."""
    e = edges(rows)
    known = rows.select(F.col("guid").alias("dst_guid"))
    return e.join(known, "dst_guid", "left_anti").select("src_guid", "field", "dst_guid")


def snapshot(rows: DataFrame) -> DataFrame:
    """(guid, class, owner_guid, references, texts): a record as a nested row."""
    r = edges(rows).groupBy("src_guid").agg(F.array_sort(F.collect_list(F.struct("field", "ordinal", "dst_guid", "t"))).alias("references"))
    t = texts(rows).groupBy("src_guid").agg(F.array_sort(F.collect_list(F.struct("field", "ws", "value"))).alias("texts"))
    out = rows.select("guid", "class", "owner_guid").join(r, F.col("guid") == r["src_guid"], "left").drop("src_guid")
    return out.join(t, F.col("guid") == t["src_guid"], "left").drop("src_guid")


def backup(spark: SparkSession, path: str, out: str, suffix: str = ".xml") -> None:
    """Unpack the project files (by their ``suffix``) of zip backups into text files below ``out``, whole records on a line."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for b in batches:
            for data in b.column(0):
                with zipfile.ZipFile(io.BytesIO(data.as_py())) as z:
                    for n in z.namelist():
                        if n.endswith(suffix):
                            text = z.read(n).decode("utf-8").replace("\n", " ")
                            yield pa.record_batch([pa.array([x + "</rt>" for x in text.split("</rt>")[:-1]])], names=["value"])

    spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string").write.text(out)
