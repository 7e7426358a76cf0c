"""Health of a grammar's tables and references of a snapshot: a query for each kind of finding, unions of them as reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of findings and how severe they are.
SEVERITY = {
    "grammar.phoneme.nfd-collision": "error",
    "grammar.boundary.nfd-collision": "error",
    "grammar.phoneme.feature-unresolved": "error",
    "grammar.natclass.feature-constraint-unresolved": "error",
    "grammar.compound-rule.side-pos-unresolved": "error",
    "grammar.msa.no-allomorphs": "error",
    "grammar.msa.inflection-class-unresolved": "error",
    "grammar.circumfix.missing-half": "error",
    "grammar.environment.unresolved": "error",
    "grammar.limit.parts-of-speech": "error",
    "grammar.limit.feature-values": "error",
    "substrate.classification-ambiguous": "error",
}
MOST = 63  # symbols of a feature, and parts of speech, that a lane of bits holds


def _found(code: str, rows: DataFrame, subject: str | Column) -> DataFrame:
    c = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), c.cast("string").alias("subject"))


def collisions(code: str, rows: DataFrame, by: list[str]) -> DataFrame:
    """What several rows are named alike: each such name once."""
    return _found(code, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), F.concat_ws("|", *by))


def unresolved(code: str, rows: DataFrame, subject: str, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows that refer to something which is not there; a null refers to nothing."""
    return _found(code, rows.where(F.col(reference).isNotNull()).join(targets.select(F.col(key).alias(reference)).distinct(), reference, "left_anti"), subject)


def childless(code: str, rows: DataFrame, key: str, children: DataFrame, reference: str) -> DataFrame:
    return _found(code, rows.join(children.select(F.col(reference).alias(key)).distinct(), key, "left_anti"), key)


def halves(code: str, rows: DataFrame, key: str, half: str, both: tuple[str, str]) -> DataFrame:
    """Keys that have one of two halves without the other."""
    sides = rows.groupBy(key).agg(*(F.bool_or(F.col(half) == b).alias(f"_h{i}") for i, b in enumerate(both)))
    return _found(code, sides.where(F.col("_h0") != F.col("_h1")), key)


def too_many(code: str, rows: DataFrame, group: str | None, value: str, most: int = MOST) -> DataFrame:
    """Groups, or the whole table, with more distinct values than a lane holds."""
    if group is None:
        return _found(code, rows.agg(F.count_distinct(value).alias("_n")).where(F.col("_n") > most), "_n")
    return _found(code, rows.groupBy(group).agg(F.count_distinct(value).alias("_n")).where(F.col("_n") > most), group)


def report(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def validated(references: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(field, problem, referrer, target) over (field, rows of referrer and target, rows of key): references to what is not
    there, and keys that stand twice."""
    parts = []
    for name, edges, keys in references:
        e = edges.select(F.col("referrer").cast("string"), F.col("target").cast("string"))
        k = keys.select(F.col("key").cast("string").alias("target"))
        parts.append(e.where("target IS NOT NULL").join(k.distinct(), "target", "left_anti").select(F.lit(name).alias("field"), F.lit("missing").alias("problem"), "referrer", "target"))
        twice = k.groupBy("target").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts.append(twice.select(F.lit(name).alias("field"), F.lit("repeated").alias("problem"), F.lit(None).cast("string").alias("referrer"), "target"))
    return reduce(DataFrame.unionByName, parts)


def projected(morphemes: DataFrame, forms: DataFrame, analyses: DataFrame, types: DataFrame) -> DataFrame:
    """(word, forms, analyses, types) of rows (word, ix, morpheme): the identities of what each morpheme was compiled from,
    in the morphemes' order; a hyphen where there is none."""
    rows = morphemes.join(forms, "morpheme", "left").join(analyses, "morpheme", "left").join(types, "morpheme", "left")
    names = ("form", "analysis", "type")
    rows = rows.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ix", *(F.coalesce(n, F.lit("-")).alias(n) for n in names)))).alias("m"))
    return rows.select("word", *(F.array_join(F.col(f"m.{n}"), " ").alias("analyses" if n == "analysis" else f"{n}s") for n in names))


# The edges that a plan can have: parent, child, the child's own kind, strategy.
SHAPES = [
    ("Union", "Gate", "", ""),
    ("Union", "Leaf", "CompositeEmissionMarker", ""),
    ("Union", "Leaf", "StructuralCompositeMarker", ""),
    ("Gate", "Compose", "", "Static"),
    ("Compose", "Leaf", "LexiconFragment", "Static"),
    ("Compose", "Replace", "", "Static"),
    ("Replace", "Leaf", "RewriteRule", ""),
]


def interactions(edges: DataFrame) -> DataFrame:
    """(parent, child, detail, strategy, status, edges): each shape that a plan can have, covered or not, and edges of no
    known shape as unknown."""
    key = ["parent", "child", "detail", "strategy"]
    shapes = edges.sparkSession.createDataFrame(SHAPES, ", ".join(f"{k} string" for k in key)).withColumn("known", F.lit(True))
    seen = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("edges"))
    both = seen.join(shapes, key, "full_outer")
    status = F.when(F.col("known").isNull(), "unknown").when(F.col("edges").isNull(), "uncovered").otherwise("covered")
    return both.select(*key, status.alias("status"), F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def pass_report(witnesses: DataFrame, mode: str = "enforce") -> DataFrame:
    """(candidate, kept, would_go, passes) of rows (candidate, witness, pass, rejected): a witness is rejected by its first
    pass that says so, and a candidate goes when all its witnesses are. ``off`` keeps all and tells nothing, ``shadow``
    tells what would go, ``enforce`` lets it go."""
    each = witnesses.groupBy("candidate", "witness").agg(F.min(F.when(F.col("rejected"), F.col("pass"))).alias("by"))
    sums = each.groupBy("candidate").agg(F.bool_and(F.col("by").isNotNull()).alias("gone"), F.array_sort(F.collect_set("by")).alias("passes"))
    told = F.col("gone") if mode != "off" else F.lit(None).cast("boolean")
    return sums.select("candidate", (~F.col("gone") | F.lit(mode != "enforce")).alias("kept"), told.alias("would_go"), F.array_join(F.col("passes").cast("array<string>"), ",").alias("passes"))
