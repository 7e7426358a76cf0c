"""Line formats: batch results, token lines, word lists, dictionaries, segmentation profiles, snapshots."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns of a batch line, the last always the cost if it is there.
BATCH = ["idx", "word", "elapsed_ms", "status", "signature"]
STATUSES = ("ok", "CAP", "MEMCAP", "TIMEOUT", "SKIPPED")
TOKEN = "surface string, doc_id string, sentence_id string, position int, is_sentence_start boolean, is_sentence_end boolean, is_punct boolean, analyses array<struct<pos:string,features:map<string,string>,morphemes:array<string>,stem:string,score:double,guessed:boolean>>"


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, word): words of a text file, blank lines not counted. Lines are numbered by file and place in it, a count
    per task at a time."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("word"), F.monotonically_increasing_id().alias("id"))
    rows = rows.withColumn("part", F.shiftright("id", 33)).withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy("id")))
    sizes = rows.groupBy("part").agg(F.max("own").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select((F.col("before") + F.col("own") - 1).alias("idx"), "word")  # a row for each task


def write_batch(rows: DataFrame, path: str) -> None:
    """Tab-separated lines; ``cost`` goes last."""
    more = [c for c in rows.columns if c not in BATCH and c != "cost"] + ["cost"] * ("cost" in rows.columns)
    rows.select(*BATCH, *more).write.option("sep", "\t").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def read_batch(spark: SparkSession, path: str, cost: bool = False) -> DataFrame:
    """The last line of each word, lines of words that only started left out; rows may be of different widths."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    lines = lines.where(F.get("f", F.lit(2)) != "STARTED")
    last = lines.groupBy(F.get("f", F.lit(1)).alias("word")).agg(F.max_by("f", "line").alias("f"))
    out = [F.get("f", F.lit(0)).try_cast("int").alias("idx"), "word", F.get("f", F.lit(2)).try_cast("long").alias("elapsed_ms"), F.get("f", F.lit(3)).alias("status"), F.get("f", F.lit(4)).alias("signature")]
    return last.select(*out, *([F.element_at("f", -1).try_cast("long").alias("cost")] if cost else []))


def write_tokens(rows: DataFrame, path: str, name: str = "tokens", version: int = 1) -> None:
    """JSON lines; each file begins with a header of the format's name and version."""
    spark = rows.sparkSession
    spark.range(1).select(F.to_json(F.struct(F.lit(name).alias("format"), F.lit(version).alias("version"))).alias("value")).coalesce(1).write.text(path)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def read_tokens(spark: SparkSession, path: str, name: str = "tokens", version: int = 1) -> DataFrame:
    """Token rows; a header of another format or version is an error, and so is a broken line before a file's end.

    A file whose writer was interrupted may end inside a line, and that line is left out. Headers and lines are checked
    where the rows are read.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    header = F.col("value").startswith('{"format"')
    head = F.from_json("value", "format string, version int")
    known = F.coalesce((head["format"] == name) & (head["version"] == version), F.lit(False))
    t = F.from_json("value", f"{TOKEN}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("file", "at", header.alias("header"), F.when(header & ~known, F.raise_error(F.lit("unknown token format"))).alias("bad"), t.alias("t"))
    rows = rows.where(F.col("bad").isNull() & ~F.col("header"))
    broken = F.col("t").isNull() | F.col("t._broken").isNotNull()
    ends = rows.groupBy("file").agg(F.max("at").alias("end"))
    whole = F.when(~broken, True).when(F.col("at") == F.col("end"), False).otherwise(F.raise_error(F.concat(F.lit("a broken line in "), F.col("file"))).cast("boolean"))
    return rows.join(ends, "file").where(whole).select("t.*").drop("_broken")


def sentences(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "surface"))), lambda t: t["surface"]).alias("surfaces"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(stem, flags) of a ``.dic`` file: byte-order mark, count line and ``\\/`` are tolerated, a line without a stem is not kept."""
    line = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\s+$", "")
    rows = spark.read.text(path).select(line.alias("l")).where((F.col("l") != "") & ~F.col("l").rlike(r"^\d+$"))
    stem = F.replace(F.regexp_extract("l", r"^((?:\\/|[^/\t])*)", 1), F.lit("\\/"), F.lit("/"))
    return rows.select(stem.alias("stem"), F.regexp_extract("l", r"(?<!\\)/([^\s]*)", 1).alias("flags")).where("stem <> ''")


def profile(xml: str) -> set[str]:
    """The word-forming characters that an LDML document's main exemplars name; ranges and ``{...}`` are known."""
    out: set[str] = set()
    for e in ET.fromstring(xml).iter("exemplarCharacters"):
        if e.get("type") in (None, "main"):
            body = (e.text or "").strip().removeprefix("[").removesuffix("]")
            for m in re.finditer(r"\{([^}]*)\}|(\S)-(\S)|(\S)", body):
                if m[1] is not None:
                    out |= set(m[1])
                elif m[2]:
                    out |= {chr(c) for c in range(ord(m[2]), ord(m[3]) + 1)}
                else:
                    out.add(m[4])
    return out


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str, name: str = "project", version: int = 1) -> DataFrame:
    """Project documents with ``snapshot_sha256``, a digest of the text; an unknown format or version is an error."""
    raw = spark.read.option("wholetext", True).text(path)
    head = F.from_json("value", "format string, version int")
    checked = F.when((head["format"] == name) & (head["version"] == version), F.from_json("value", schema)).otherwise(F.raise_error(F.lit("unknown snapshot format or version")))
    return raw.select(checked.alias("s"), F.sha2("value", 256).alias("snapshot_sha256")).select("s.*", "snapshot_sha256")


def write_snapshot(rows: DataFrame, path: str, name: str = "project", version: int = 1) -> None:
    rows.select(F.to_json(F.struct(F.lit(name).alias("format"), F.lit(version).alias("version"), *rows.columns)).alias("value")).write.text(path)


def affix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(kind, flag, cross, strip, add, condition) of the rules of an ``.aff`` file. A rule that is not of its header's flag, or
    has too few fields, is an error; other lines are left out."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+#.*$", "")), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where(F.get("f", F.lit(0)).isin("SFX", "PFX"))
    head = rows.where((F.size("f") == 4) & F.get("f", F.lit(2)).isin("Y", "N") & F.get("f", F.lit(3)).rlike(r"^\d+$"))
    body = rows.where(~((F.size("f") == 4) & F.get("f", F.lit(2)).isin("Y", "N") & F.get("f", F.lit(3)).rlike(r"^\d+$")))
    at = lambda i: F.get("f", F.lit(i))
    cross = head.select(at(0).alias("kind"), at(1).alias("flag"), (at(2) == "Y").alias("cross"))
    given = body.select(at(0).alias("kind"), at(1).alias("flag"), at(2).alias("strip"), F.regexp_replace(at(3), "/.*$", "").alias("add"), F.coalesce(at(4), F.lit(".")).alias("condition"))
    known = given.join(cross, ["kind", "flag"], "left")
    bad = F.col("cross").isNull() | F.col("add").isNull()
    checked = known.withColumn("cross", F.when(bad, F.raise_error(F.concat(F.lit("a malformed rule of "), "flag")).cast("boolean")).otherwise(F.col("cross")))
    none = lambda c: F.when(F.col(c) == "0", "").otherwise(F.col(c)).alias(c)
    return checked.select("kind", "flag", "cross", none("strip"), none("add"), "condition")


def spelled(stems: DataFrame, rules: DataFrame) -> DataFrame:
    """(form, stem) of (stem, flags) and the rules of the stems' flags, one letter each: the stems, with a suffix, with a
    prefix, and with both where both rules allow it."""
    flagged = stems.select("stem", F.explode(F.array_distinct(F.split("flags", ""))).alias("flag")).where("flag <> ''")

    def made(rows: DataFrame, kind: str) -> DataFrame:
        n, k = F.length("form"), F.length("strip")
        with_rules = rows.join(rules.where(F.col("kind") == kind), "flag")
        if kind == "SFX":
            fits = F.expr("endswith(form, strip)") & F.rlike("form", F.concat("condition", F.lit("$")))
            new = F.concat(F.substr("form", F.lit(1), n - k), "add")
        else:
            fits = F.expr("startswith(form, strip)") & F.rlike("form", F.concat(F.lit("^"), "condition"))
            new = F.concat("add", F.substr("form", k + 1, n))
        return with_rules.where(fits & (n > k)).select(new.alias("form"), "stem", "cross")

    own = flagged.withColumn("form", F.col("stem"))
    suffixed, prefixed = made(own, "SFX"), made(own, "PFX")
    crossing = suffixed.where("cross").join(flagged, "stem").select("form", "stem", "flag")
    both = made(crossing, "PFX").where("cross")
    every = stems.select(F.col("stem").alias("form"), "stem").unionByName(suffixed.drop("cross")).unionByName(prefixed.drop("cross")).unionByName(both.drop("cross"))
    return every.distinct()


def write_analyses(parsed: DataFrame, path: str) -> None:
    """JSON lines, one for each word, with its status and its analyses in order."""
    parsed.select(F.to_json(F.struct("word", "status", "analyses")).alias("value")).write.text(path)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    kind = "word string, status string, analyses array<struct<roots:array<string>,affixes:array<string>,category:string,guessed:boolean>>"
    return spark.read.text(path).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("t")).select("t.*")


LEXICON = "entries array<struct<entry:string,stem:string,glosses:array<string>,pos:string,state:string,revision:long>>"


def write_lexicon(entries: DataFrame, path: str, parts: int = 64) -> None:
    """Documents of entries in their order, each of a bounded share, with the format's name and version."""
    share = F.pmod(F.xxhash64("entry"), F.lit(parts)).alias("share")
    own = ["entry", "stem", "glosses", "pos", "state", "revision"]
    write_snapshot(entries.select(share, F.struct(*own).alias("e")).groupBy("share").agg(F.array_sort(F.collect_list("e"), lambda a, b: F.when(a["entry"] < b["entry"], -1).when(a["entry"] > b["entry"], 1).otherwise(0)).alias("entries")).select("entries"), path, "lexicon")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.text(path).select(F.from_json("value", f"format string, version int, {LEXICON}").alias("d"))
    known = (F.col("d.format") == "lexicon") & (F.col("d.version") == 1)
    return documents.select(F.explode(F.when(known, F.col("d.entries")).otherwise(F.raise_error(F.lit("unknown lexicon format")))).alias("e")).select("e.*")
