"""Reports over measured counters: a fact per word, object, stratum, allomorph and direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUMS = ["attempts", "work", "work_steps", "outputs", "not_applied", "no_root", "surface_mismatch", "uses", "self_time_ns"]
SENTINEL = "unattributed"
RULES = ("morph_rule", "phon_rule")
KEY = ["word_id", "object_id", "stratum_id", "allomorph_id", "direction"]
SEMANTICS = 8


@dataclass
class Selection:
    """Optional filters of a report; what is None is not part of the plan."""

    form: str | None = None
    kind: str | None = None
    direction: str | None = None
    run_id: int | None = None
    exclude_censored: bool = False

    def words(self, word: DataFrame) -> DataFrame:
        if self.form is not None:
            word = word.where(F.col("form") == self.form)
        if self.run_id is not None:
            word = word.where(F.col("run_id") == self.run_id)
        return word.where(uncensored()) if self.exclude_censored else word

    def objects(self, obj: DataFrame) -> DataFrame:
        obj = obj.where(F.col("kind") != SENTINEL)
        return obj.where(F.col("kind") == self.kind) if self.kind is not None else obj

    def facts(self, fact: DataFrame) -> DataFrame:
        return fact.where(F.col("direction") == self.direction) if self.direction is not None else fact

    @property
    def on_words(self) -> bool:
        return self.form is not None or self.run_id is not None or self.exclude_censored


def uncensored() -> Column:
    return ~F.col("capped") & ~F.col("timed_out")


def amplification(outputs: str = "outputs", attempts: str = "attempts") -> Column:
    """Outputs per attempt, null without attempts."""
    return F.try_divide(F.col(outputs).cast("double"), F.col(attempts))


def _masked() -> list[Column]:
    """Sums; at a named allomorph ``not_applied`` would count the rule level again, so only that level counts."""
    rule = F.when(F.col("allomorph_id") == 0, F.col("not_applied")).otherwise(0)
    return [F.sum(rule if c == "not_applied" else F.col(c)).alias(c) for c in SUMS]


def _selected(fact: DataFrame, obj: DataFrame, word: DataFrame | None, pick: Selection) -> DataFrame:
    """Facts of the selected objects and words. The objects are a dimension that AQE broadcasts if it is small; words
    meet the facts only if a filter is on them, as every fact has its word."""
    rows = pick.facts(fact).join(pick.objects(obj), "object_id")
    return rows.join(pick.words(word).select("word_id"), "word_id") if pick.on_words and word is not None else rows


def per_word(word: DataFrame) -> DataFrame:
    """Words with what their measurement says, the slowest first."""
    return word.select("form", "elapsed_ns", "work", "passes", "capped", "timed_out", "invalid_shape", "run_id").orderBy(F.desc("elapsed_ns"), "form")


def total_elapsed(word: DataFrame, form: str | None = None) -> DataFrame:
    return Selection(form=form).words(word).agg(F.coalesce(F.sum("elapsed_ns"), F.lit(0)).alias("total_elapsed_ns"))


def per_object(fact: DataFrame, obj: DataFrame, word: DataFrame, pick: Selection = Selection(), sort: str = "work") -> DataFrame:
    rows = _selected(fact, obj, word, pick).groupBy("object_id", "key", "kind", "label").agg(*_masked()).drop("object_id").withColumn("amplification", amplification())
    return rows.orderBy(F.col(sort).desc_nulls_last(), "key", "kind")


def per_stratum_object(fact: DataFrame, obj: DataFrame, stratum: DataFrame) -> DataFrame:
    rows = _selected(fact, obj, None, Selection()).join(stratum, "stratum_id", "left")
    return rows.groupBy("stratum_group", "kind").agg(*_masked())


def guarded(fact: DataFrame, word: DataFrame, runs: DataFrame) -> DataFrame:
    """How many facts of named allomorphs have no run, or one whose counters mean something else; a report over them is refused."""
    named = fact.where(F.col("allomorph_id") != 0).join(word.select("word_id", "run_id"), "word_id").join(runs, "run_id", "left")
    return named.agg(F.count(F.lit(1)).alias("named_facts"), F.count_if(F.col("counter_semantics").isNull()).alias("without_run"), F.count_if(F.col("counter_semantics") != SEMANTICS).alias("other_semantics"))


def require_provenance(fact: DataFrame, word: DataFrame, runs: DataFrame) -> None:
    bad = guarded(fact, word, runs).first()
    if bad["without_run"] or bad["other_semantics"]:
        raise ValueError(f"{bad['without_run']} facts without a run, {bad['other_semantics']} with other counter semantics")


def per_allomorph(fact: DataFrame, obj: DataFrame, word: DataFrame, pick: Selection = Selection()) -> DataFrame:
    rows = _selected(fact, obj, word, pick).groupBy("key", "kind", "allomorph_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    return rows.withColumn("amplification", amplification())


def per_kind(fact: DataFrame, obj: DataFrame, word: DataFrame, pick: Selection = Selection()) -> DataFrame:
    return _selected(fact, obj, word, pick).groupBy("kind").agg(F.count_distinct("object_id").alias("objects"), *_masked())


def per_morpheme(fact: DataFrame, obj: DataFrame, morpheme: DataFrame) -> DataFrame:
    """Lexical entries by morpheme; a null key gathers the unresolved ones."""
    rows = _selected(fact, obj, None, Selection(kind="lex_entry")).join(morpheme, "morpheme_id", "left")
    return rows.groupBy("morpheme_id", "morpheme_key").agg(*_masked())


def never_fires(fact: DataFrame, obj: DataFrame, min_attempts: int = 1000) -> DataFrame:
    rows = _selected(fact, obj.where(F.col("kind").isin(*RULES)), None, Selection())
    sums = rows.groupBy("key", "kind", "direction").agg(F.sum("attempts").alias("attempts"), F.sum("outputs").alias("outputs"))
    return sums.where((F.col("outputs") == 0) & (F.col("attempts") >= min_attempts)).drop("outputs")


def gates(passed_blocked: DataFrame) -> DataFrame:
    """Passes and blocks by object and feature, most blocked first."""
    return passed_blocked.groupBy("object_id", "feature").agg(F.sum("passed").alias("passed"), F.sum("blocked").alias("blocked")).orderBy(F.desc("blocked"), "object_id", "feature")


def gate_header(word: DataFrame) -> DataFrame:
    return word.agg(F.count_if(F.col("gates_measured")).alias("measured"), F.count_if(~F.col("gates_measured")).alias("unmeasured"), F.count_if(~uncensored()).alias("censored"))


def mixed_settings(word: DataFrame, runs: DataFrame) -> DataFrame:
    return word.select("run_id").distinct().join(runs, "run_id").agg(F.count_distinct("options_hash").alias("options"), F.count_distinct("work_cap").alias("caps"))


def kind_exists(obj: DataFrame, kind: str) -> DataFrame:
    return obj.where(F.col("kind") == kind).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def compacted(fact: DataFrame, obj: DataFrame, order: str) -> DataFrame:
    """Facts of the last writer for each key, summed by object and direction, without rows of zeros."""
    last = fact.groupBy(*KEY).agg(F.max_by(F.struct(*SUMS), order).alias("s")).select(*KEY, "s.*")
    sums = last.join(obj.select("object_id", "kind"), "object_id").groupBy("object_id", "kind", "direction").agg(*[F.sum(c).alias(c) for c in SUMS])
    anything = F.lit(False)
    for c in SUMS:
        anything = anything | (F.col(c) != 0)
    return sums.where(anything)


def kind_summary(fact: DataFrame, obj: DataFrame, kind: str) -> DataFrame:
    return fact.join(obj.where(F.col("kind") == kind).select("object_id"), "object_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


def top_per_kind(report: DataFrame, n: int, sort: str = "work") -> DataFrame:
    """The first ``n`` rows of each kind with their share of the kind's total, which counts all rows."""
    totals = report.groupBy("kind").agg(F.sum(sort).alias("total"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col(sort).desc_nulls_last(), "key"))
    first = report.select("kind", "key", sort, place.alias("place")).where(F.col("place") <= n)  # each task keeps n rows of a kind
    return first.join(totals, "kind").select("kind", "key", sort, F.round(F.try_divide(F.col(sort).cast("double"), "total"), 9).alias("share"), "place")


def gate_totals(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Stored passes and blocks by object and feature with those of a new run added."""
    rows = new if old is None else old.unionByName(new)
    return rows.groupBy("object_id", "feature").agg(F.sum("passed").alias("passed"), F.sum("blocked").alias("blocked"))


def reusable(wanted: DataFrame, word: DataFrame, runs: DataFrame, identity: dict) -> DataFrame:
    """Wanted forms with a stored, uncensored measurement of the same identity."""
    same = runs
    for c, v in identity.items():
        same = same.where(F.col(c).eqNullSafe(F.lit(v)))
    return wanted.join(word.where(uncensored()).join(same.select("run_id"), "run_id", "left_semi"), "form", "left_semi")


def missing(wanted: DataFrame, word: DataFrame, runs: DataFrame, identity: dict) -> DataFrame:
    return wanted.join(reusable(wanted, word, runs, identity), "form", "left_anti")


def existing(wanted: DataFrame, word: DataFrame) -> DataFrame:
    return wanted.join(word, "form", "left_semi")


def merged_counters(parts: DataFrame) -> DataFrame:
    """Element-wise sums of pruning counters that workers report."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def cost(work: Column, bytes_: Column, registers: Column, allocations: Column) -> Column:
    """Weighted counts; fixed weights 800, 5, 0 and 600 over a scale of 4."""
    return F.expr("0L") + F.floor((work * 800 + bytes_ * 5 + registers * 0 + allocations * 600) / 4).cast("long")


def calibrated(rows: DataFrame, least_work: int = 1000, least_words: int = 8, steps: int = 500) -> DataFrame:
    """(work_weight, alloc_weight, words): non-negative least squares of elapsed time, from sums alone.

    The normal equations of two weights need five sums, so the words are never gathered; the solution is one of four
    cases of which weights are zero.
    """
    x, y, t = F.col("work").cast("double"), F.col("allocations").cast("double"), F.col("elapsed_ns").cast("double")
    s = rows.where(F.col("work") >= least_work).agg(F.count(F.lit(1)).alias("words"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * t).alias("xt"), F.sum(y * t).alias("yt"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a, b = F.try_divide(F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy"), det), F.try_divide(F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy"), det)
    inner = (a >= 0) & (b >= 0)
    only_x, only_y = F.greatest(F.try_divide("xt", "xx"), F.lit(0.0)), F.greatest(F.try_divide("yt", "yy"), F.lit(0.0))
    x_better = only_x * F.col("xt") >= only_y * F.col("yt")
    solved = s.select("words", F.when(inner, a).when(x_better, only_x).otherwise(0.0).alias("work_weight"), F.when(inner, b).when(x_better, 0.0).otherwise(only_y).alias("alloc_weight"))
    return solved.where(F.col("words") >= least_words)


def percentiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact p50, p95, p99 (continuous, to three places), largest value and sum.

    Equal values are counted first and dealt in ranges, however large a group is. A range's place in its group follows
    from the counts of the ranges before it, a row for each range and group; so no task holds a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange(F.col(group), F.col(value)).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("part", group).orderBy(value)))
    sizes = ranged.groupBy("part", group).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col(value)).alias("sum"), F.max(value).alias("most"))
    before = sizes.select("part", group, (F.sum("size").over(Window.partitionBy(group).orderBy("part")) - F.col("size")).alias("before"))
    whole = sizes.groupBy(group).agg(F.sum("size").alias("all"), F.sum("sum").alias("total"), F.max("most").alias("largest"))
    same = lambda a, b: a.eqNullSafe(b)
    placed = ranged.join(before.withColumnRenamed(group, "_g"), (ranged["part"] == before["part"]) & same(ranged[group], F.col("_g"))).select(ranged[group], value, "n", (F.col("before") + F.col("upto") - F.col("n")).alias("first"))
    placed = placed.join(whole.withColumnRenamed(group, "_g"), same(placed[group], F.col("_g"))).drop("_g")
    marks = {}
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        at = (F.col("all") - 1) * F.lit(q)
        for end, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            marks[name + end] = F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col(value)))
    found = placed.groupBy(group, "all", "total", "largest").agg(*(m.alias(k) for k, m in marks.items()))
    cut = lambda name, q: F.round(F.col(name + "a") + (F.col(name + "b") - F.col(name + "a")) * ((F.col("all") - 1) * F.lit(q) - F.floor((F.col("all") - 1) * F.lit(q))), 3).alias(name)
    return found.select(group, F.col("all").alias("n"), cut("p50", 0.5), cut("p95", 0.95), cut("p99", 0.99), "largest", "total")


def median_of_medians(rows: DataFrame, group: str, item: str, value: str, noisy: float = 3.0) -> DataFrame:
    """The median over items of their medians; a group with an item whose values spread over ``noisy`` times is flagged."""
    items = rows.groupBy(group, item).agg(F.median(value).alias("m"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    return items.groupBy(group).agg(F.median("m").alias("median"), F.count(F.lit(1)).alias("items"), F.bool_or(F.col("hi") > noisy * F.col("lo")).alias("noisy"))
