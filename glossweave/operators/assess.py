"""Comparing runs: identity sets of cases, multiset signatures, ledgers and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories of a case that count as a change.
CHANGED = ("added_only", "removed_only", "mixed", "baseline_only", "candidate_only")
ELIGIBLE = "adjudicated"


def digest(identity: Column) -> Column:
    """A stable digest of an identity: SHA-256 of its JSON, fields in the order of the type."""
    return F.sha2(F.to_json(F.struct(identity.alias("identity"))), 256)


def analysis_sets(rows: DataFrame) -> DataFrame:
    """(case_id, identity, duplicate_count, guessed): an identity once for each case; a count of zero is an error."""
    n = F.when(F.col("count") > 0, F.col("count")).otherwise(F.raise_error(F.lit("an analysis was seen zero times")))
    return rows.groupBy("case_id", "identity").agg(F.sum(n).alias("duplicate_count"), F.bool_or("guessed").alias("guessed"))


def identity_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, identity, change): added, removed or retained."""
    b = before.select("case_id", "identity").distinct().withColumn("b", F.lit(True))
    a = after.select("case_id", "identity").distinct().withColumn("a", F.lit(True))
    both = b.join(a, ["case_id", "identity"], "full_outer")
    return both.select("case_id", "identity", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("retained").alias("change"))


def case_delta(before: DataFrame, after: DataFrame, supersedes: DataFrame | None = None) -> DataFrame:
    """(case_id, added, removed, retained, category) of each case of either run.

    ``supersedes`` (new_id, old_id) moves a baseline case to the case that replaced it.
    """
    if supersedes is not None:
        before = before.join(supersedes, before["case_id"] == supersedes["old_id"], "left").select(F.coalesce("new_id", "case_id").alias("case_id"), "identity")
    b = before.select("case_id", "identity").distinct().withColumn("side", F.lit(1))
    a = after.select("case_id", "identity").distinct().withColumn("side", F.lit(2))
    marks = b.unionByName(a).groupBy("case_id", "identity").agg(F.bit_or("side").alias("m"))
    sums = marks.groupBy("case_id").agg(F.count_if(F.col("m") == 2).alias("added"), F.count_if(F.col("m") == 1).alias("removed"), F.count_if(F.col("m") == 3).alias("retained"), F.bit_or("m").alias("sides"))
    category = (
        F.when(F.col("sides") == 1, "baseline_only").when(F.col("sides") == 2, "candidate_only").when((F.col("added") == 0) & (F.col("removed") == 0), "unchanged").when(F.col("removed") == 0, "added_only").when(F.col("added") == 0, "removed_only").otherwise("mixed")
    )
    return sums.select("case_id", "added", "removed", "retained", category.alias("category"))


def ambiguous_supersession(supersedes: DataFrame) -> DataFrame:
    """Baseline cases that more cases than one claim; ``require_unambiguous`` makes them an error."""
    return supersedes.groupBy("old_id").agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")


def require_unambiguous(supersedes: DataFrame) -> None:
    if bad := ambiguous_supersession(supersedes).limit(1).collect():
        raise ValueError(f"case {bad[0]['old_id']} is superseded by {bad[0]['claims']} cases")


def delta_summary(delta: DataFrame) -> DataFrame:
    return delta.groupBy("category").agg(F.count(F.lit(1)).alias("cases"), F.bool_or(F.col("category").isin(*CHANGED)).alias("changed"))


def report_status(rows: DataFrame, group: str) -> DataFrame:
    """complete, partial or failed, from the outcomes of a group's cases."""
    s = rows.groupBy(group).agg(F.bool_or(F.col("outcome") == "complete").alias("c"), F.bool_or(F.col("outcome") == "incomplete").alias("i"), F.bool_or(F.col("outcome") == "not_attempted").alias("n"))
    return s.select(group, F.when(F.col("c") & ~F.col("i") & ~F.col("n"), "complete").when(F.col("c"), "partial").otherwise("failed").alias("status"))


def ledger(rows: DataFrame, group: str, statuses: list[str], exact: str) -> DataFrame:
    """A counter for each status; certified if all declared cases, and one at least, are exact."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("declared"), *counts).withColumn("certified", (F.col("declared") > 0) & (F.col(f"n_{exact}") == F.col("declared")))


def all_certified(ledgers: DataFrame, expected: DataFrame, group: str) -> DataFrame:
    """Whether each expected group has a ledger of the expected size that is certified."""
    both = expected.join(ledgers, group, "left")
    ok = F.coalesce((F.col("declared") == F.col("expected")) & F.col("certified"), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("groups"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("gate"))


def run_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, side): inner, left or right: where each word of two runs was found."""
    l, r = left.select("word").distinct().withColumn("l", F.lit(1)), right.select("word").distinct().withColumn("r", F.lit(1))
    return l.join(r, "word", "full_outer").select("word", F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both").alias("side"))


def bucket(left: Column, right: Column, left_status: Column, right_status: Column) -> Column:
    """How two lists of signatures compare; repeats are signal until only the sets agree."""
    a, b = F.sort_array(left), F.sort_array(right)
    return (
        F.when((left_status != "ok") & (right_status != "ok"), "CAPPED")
        .when(left_status != right_status, "STATUS_DIFF")
        .when(left == right, "IDENTICAL")
        .when(a == b, "MULTISET_EQUAL")
        .when(F.array_distinct(a) == F.array_distinct(b), "SET_EQUAL")
        .otherwise("DIFFERENT")
    )


def bucket_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(bucket, words, percent) over the words of both runs; columns word, status, parts."""
    l, r = left.select("word", F.col("status").alias("ls"), F.col("parts").alias("lp")), right.select("word", F.col("status").alias("rs"), F.col("parts").alias("rp"))
    counts = l.join(r, "word").groupBy(bucket(F.col("lp"), F.col("rp"), F.col("ls"), F.col("rs")).alias("bucket")).agg(F.count(F.lit(1)).alias("words"))
    total = counts.agg(F.sum("words").alias("total"))  # one row
    return counts.join(F.broadcast(total)).select("bucket", "words", F.round(100.0 * F.col("words") / F.col("total"), 6).alias("percent"))


def set_verify(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per word, what the second run misses and has besides; incomparable where a side did not finish."""
    l, r = left.select("word", F.col("status").alias("ls"), F.col("parts").alias("lp")), right.select("word", F.col("status").alias("rs"), F.col("parts").alias("rp"))
    both = l.join(r, "word")
    ok = (F.col("ls") == "ok") & (F.col("rs") == "ok")
    return both.select("word", ok.alias("comparable"), F.array_except("lp", "rp").alias("missing"), F.array_except("rp", "lp").alias("extra"))


def verify_totals(verified: DataFrame) -> DataFrame:
    c, m, x = F.col("comparable"), F.size("missing") > 0, F.size("extra") > 0
    return verified.agg(F.count_if(c & ~m & ~x).alias("equal"), F.count_if(c & m).alias("missing"), F.count_if(c & x).alias("extra"), F.count_if(~c).alias("incomparable"))


def cost_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Total cost over words that both runs finished, its change in percent and a verdict.

    Within two percent is neutral, up to five small; a word whose status changed makes it inconclusive.
    """
    l, r = left.select("word", F.col("status").alias("ls"), F.col("cost").alias("lc")), right.select("word", F.col("status").alias("rs"), F.col("cost").alias("rc"))
    ok = (F.col("ls") == "ok") & (F.col("rs") == "ok")
    s = l.join(r, "word").agg(F.count_if(ok).alias("words"), F.coalesce(F.sum(F.when(ok, F.col("lc"))), F.lit(0)).alias("before"), F.coalesce(F.sum(F.when(ok, F.col("rc"))), F.lit(0)).alias("after"), F.count_if(F.col("ls") != F.col("rs")).alias("status_changes"))
    change = F.when(F.col("before") == 0, 0.0).otherwise(100.0 * (F.col("after") / F.col("before") - 1))
    size = F.abs(change)
    direction = F.when(change < 0, "improvement").otherwise("regression")
    verdict = F.when(F.col("status_changes") > 0, "inconclusive").when(size <= 2, "neutral").when(size <= 5, F.concat(F.lit("small_"), direction)).otherwise(direction)
    return s.select("words", "before", "after", "status_changes", F.round(change, 6).alias("percent"), verdict.alias("verdict"))


def differential(expected: DataFrame, observed: DataFrame, oracle: DataFrame) -> DataFrame:
    """Counters of expected, observed and oracle acceptances by word_id."""
    rows = expected.join(observed, "word_id", "left").join(oracle, "word_id", "left")
    o, e, x = F.coalesce("observed", F.lit(False)), F.col("expected"), F.col("oracle")
    return rows.agg(
        F.count(F.lit(1)).alias("words"), F.count_if(e & o).alias("accepted"), F.count_if(~e & ~o).alias("rejected"), F.count_if(e & ~o).alias("missed"), F.count_if(~e & o).alias("overaccepted"),
        F.count_if(F.col("observed").isNull()).alias("unobserved"), F.count_if(x.isNull()).alias("without_oracle"), F.count_if(x.isNotNull() & (x != o)).alias("oracle_differs"),
    )


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side beyond the other's copies of them, with ``side`` and how many."""
    cols = left.columns
    l, r = left.withColumn("d", F.lit(1)), right.select(*cols).withColumn("d", F.lit(-1))
    return l.unionByName(r).groupBy(*cols).agg(F.sum("d").alias("d")).where("d <> 0").select(*cols, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("copies"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both; a training set that shares one with its test set leaks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if bad := disjoint(a, b, key).limit(1).collect():
        raise ValueError(f"{key} {bad[0][0]!r} is on both sides")


def readiness(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, verdict): a value against its threshold and floor. What is missing never passes; a rate lies in [0, 1]."""
    v, t, f = F.col("value"), F.col("threshold"), F.col("floor")
    verdict = F.when(f > t, "bad_policy").when(v.isNull(), "missing").when((v < 0) | (v > 1), "bad_value").when(v >= t, "pass").when(v < f, "below_floor").otherwise("fail")
    return thresholds.join(measured, "name", "left").select("name", verdict.alias("verdict"))
