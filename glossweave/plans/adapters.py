"""Logical tables bound to the driver's star schema; each also as SQL, for the oracle.

The mapping is arbitrary but fixed. It keeps every report from being empty; see README.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What stands for the kinds of rule objects.
KIND_OF_TYPE = {"MEDIUM": "morph_rule", "STANDARD": "phon_rule", "LARGE": "lex_entry", "PROMO": "affix_template", "SMALL": "compound_rule", "ECONOMY": "unattributed"}
SUMS = ["attempts", "work", "work_steps", "outputs", "not_applied", "no_root", "surface_mismatch", "uses", "self_time_ns"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def word(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("word_id"),
        F.year("o_orderdate").alias("run_id"),
        F.col("o_orderkey").cast("string").alias("form"),
        _long(F.col("o_totalprice") * 100).alias("elapsed_ns"),
        (F.col("o_custkey") % 1000 * 40).alias("work"),
        (1 + F.col("o_custkey") % 4).alias("passes"),
        (F.col("o_orderstatus") == "P").alias("capped"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).alias("timed_out"),
        (F.col("o_custkey") % 29 == 0).alias("invalid_shape"),
        (F.col("o_orderpriority") != "5-LOW").alias("gates_measured"),
        F.col("o_custkey").alias("text_id"),
    )


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    n = _long(F.col("l_quantity"))
    when = lambda flag: F.when(F.col("l_returnflag") == flag, n).otherwise(F.lit(0).cast("long"))
    return li.select(
        F.col("l_orderkey").alias("word_id"),
        F.col("l_partkey").alias("object_id"),
        F.col("l_suppkey").alias("stratum_id"),
        (F.col("l_linenumber") - 1).alias("allomorph_id"),
        F.when(F.col("l_linestatus") == "O", "analysis").otherwise("synthesis").alias("direction"),
        n.alias("attempts"),
        (n * 4).alias("work"),
        (n * 2).alias("work_steps"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") <= 2), n).otherwise(F.lit(0).cast("long")).alias("outputs"),
        when("N").alias("not_applied"),
        when("R").alias("no_root"),
        _long(F.col("l_discount") * 100).alias("surface_mismatch"),
        _long(F.col("l_tax") * 100).alias("uses"),
        _long(F.col("l_extendedprice") * 100).alias("self_time_ns"),
        F.col("l_shipdate").alias("written"),
    )


def object_(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF_TYPE.items() for x in kv])
    return p.select(F.col("p_partkey").alias("object_id"), F.col("p_partkey").cast("string").alias("key"), F.coalesce(kinds[F.col("p_type")], F.lit("other")).alias("kind"), F.col("p_name").alias("label"), F.col("p_brand").alias("morpheme_id"))


def morpheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as morphemes; the first, the sentinel of unresolved ones, has no key."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("morpheme_id")).distinct()
    return b.select("morpheme_id", F.when(F.col("morpheme_id") != "Brand#1", F.lower("morpheme_id")).alias("morpheme_key"))


def stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("stratum_id"), F.col("s_name").alias("stratum"), F.col("n_name").alias("stratum_group"))


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two runs: a case is a user's day, an identity what happened."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 2 == 0).alias("baseline"), (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("case_id"), F.col("event_type").alias("identity"), F.col("value"), F.col("event_id"), F.col("ts"))


_L = "CAST(floor({}) AS BIGINT)"
SQL = {
    "word": f"""SELECT o_orderkey AS word_id, CAST(year(o_orderdate) AS INTEGER) AS run_id, CAST(o_orderkey AS VARCHAR) AS form, {_L.format('o_totalprice * 100')} AS elapsed_ns, o_custkey % 1000 * 40 AS work, 1 + o_custkey % 4 AS passes, o_custkey % 29 = 0 AS invalid_shape,
  o_orderstatus = 'P' AS capped, (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS timed_out, o_orderpriority <> '5-LOW' AS gates_measured, o_custkey AS text_id FROM orders""",
    "fact": f"""SELECT l_orderkey AS word_id, l_partkey AS object_id, l_suppkey AS stratum_id, l_linenumber - 1 AS allomorph_id,
  CASE WHEN l_linestatus = 'O' THEN 'analysis' ELSE 'synthesis' END AS direction, {_L.format('l_quantity')} AS attempts, {_L.format('l_quantity')} * 4 AS work, {_L.format('l_quantity')} * 2 AS work_steps,
  CASE WHEN l_returnflag = 'A' AND l_linenumber <= 2 THEN {_L.format('l_quantity')} ELSE 0 END AS outputs, CASE WHEN l_returnflag = 'N' THEN {_L.format('l_quantity')} ELSE 0 END AS not_applied,
  CASE WHEN l_returnflag = 'R' THEN {_L.format('l_quantity')} ELSE 0 END AS no_root, {_L.format('l_discount * 100')} AS surface_mismatch, {_L.format('l_tax * 100')} AS uses,
  {_L.format('l_extendedprice * 100')} AS self_time_ns, l_shipdate AS written FROM lineitem""",
    "object": "SELECT p_partkey AS object_id, CAST(p_partkey AS VARCHAR) AS key, CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KIND_OF_TYPE.items()) + " ELSE 'other' END AS kind, p_name AS label, p_brand AS morpheme_id FROM part",
    "morpheme": "SELECT DISTINCT p_brand AS morpheme_id, CASE WHEN p_brand <> 'Brand#1' THEN lower(p_brand) END AS morpheme_key FROM part",
    "stratum": "SELECT s_suppkey AS stratum_id, s_name AS stratum, n_name AS stratum_group FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "outcome": "SELECT event_id % 2 = 0 AS baseline, user_id * 1000 + dayofyear(ts) AS case_id, event_type AS identity, value, event_id, ts FROM events",
}


def sql(body: str, *names: str) -> str:
    """``body`` with the logical tables as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + (", " if body.lstrip().startswith("!") else "\n") + body.lstrip().removeprefix("!")
