"""Stats reports bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from . import adapters as A

_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in S.SUMS)
_MASKED = ", ".join(f"CAST(sum({'CASE WHEN allomorph_id = 0 THEN not_applied ELSE 0 END' if c == 'not_applied' else c}) AS BIGINT) AS {c}" for c in S.SUMS)
_AMP = "CAST(sum(outputs) AS DOUBLE) / nullif(sum(attempts), 0) AS amplification"
_RUNS = "SELECT DISTINCT run_id, 8 - (run_id % 2) * 0 AS counter_semantics, 'h' || (run_id % 3) AS options_hash, CASE WHEN run_id % 2 = 0 THEN 5000 END AS work_cap FROM word"


def runs(spark: SparkSession, d: str) -> DataFrame:
    r = A.word(spark, d).select("run_id").distinct()
    return r.select("run_id", F.lit(S.SEMANTICS).alias("counter_semantics"), F.concat(F.lit("h"), F.col("run_id") % 3).alias("options_hash"), F.when(F.col("run_id") % 2 == 0, F.lit(5000)).alias("work_cap"))


def wanted(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "customer").select((F.col("c_custkey") * 7).cast("string").alias("form"))


def gate_facts(spark: SparkSession, d: str) -> DataFrame:
    f = A.fact(spark, d)
    return f.select("object_id", (F.col("stratum_id") % 5).alias("feature"), F.col("outputs").alias("passed"), F.col("not_applied").alias("blocked"))


def star(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return A.fact(spark, d), A.object_(spark, d), A.word(spark, d)


_JOIN = "FROM fact JOIN object USING (object_id)"
_LIVE = "kind <> 'unattributed'"
_WORD = "JOIN (SELECT * EXCLUDE (work) FROM word) word USING (word_id)"
_SAME = {"options_hash": "h0", "work_cap": 5000}

QUERIES = {
    "per_word_report": lambda s, d: S.per_word(A.word(s, d)),
    "total_elapsed": lambda s, d: S.total_elapsed(A.word(s, d)),
    "total_elapsed_of_word": lambda s, d: S.total_elapsed(A.word(s, d), "7"),
    "per_object_report": lambda s, d: S.per_object(*star(s, d)),
    "per_object_no_censored": lambda s, d: S.per_object(*star(s, d), S.Selection(exclude_censored=True)),
    "per_object_filtered": lambda s, d: S.per_object(*star(s, d), S.Selection(kind="morph_rule", direction="analysis", run_id=1997)),
    "per_object_sort_amp": lambda s, d: S.per_object(*star(s, d), sort="amplification"),
    "per_stratum_group": lambda s, d: S.per_stratum_object(A.fact(s, d), A.object_(s, d), A.stratum(s, d)),
    "per_allomorph_report": lambda s, d: S.per_allomorph(*star(s, d)),
    "per_kind_report": lambda s, d: S.per_kind(*star(s, d)),
    "per_morpheme_report": lambda s, d: S.per_morpheme(A.fact(s, d), A.object_(s, d), A.morpheme(s, d)),
    "never_fires": lambda s, d: S.never_fires(A.fact(s, d), A.object_(s, d), 300),
    "gate_report": lambda s, d: S.gates(gate_facts(s, d)),
    "gate_accumulated": lambda s, d: S.gate_totals(S.gate_totals(None, gate_facts(s, d)), gate_facts(s, d).where("feature < 3")),
    "gate_header": lambda s, d: S.gate_header(A.word(s, d)),
    "mixed_settings": lambda s, d: S.mixed_settings(A.word(s, d), runs(s, d)),
    "kind_exists": lambda s, d: S.kind_exists(A.object_(s, d), "lex_entry"),
    "provenance_guard": lambda s, d: S.guarded(A.fact(s, d), A.word(s, d), runs(s, d)),
    "compact_facts": lambda s, d: S.compacted(A.fact(s, d), A.object_(s, d), "written"),
    "kind_summary": lambda s, d: S.kind_summary(A.fact(s, d), A.object_(s, d), "phon_rule"),
    "top_per_kind": lambda s, d: S.top_per_kind(S.per_object(*star(s, d)), 5),
    "reusable_words": lambda s, d: S.reusable(wanted(s, d), A.word(s, d), runs(s, d), _SAME),
    "missing_words": lambda s, d: S.missing(wanted(s, d), A.word(s, d), runs(s, d), _SAME),
    "existing_words": lambda s, d: S.existing(wanted(s, d), A.word(s, d)),
    "prune_counters": lambda s, d: S.merged_counters(A.fact(s, d).select(*S.SUMS)),
    "counts_to_cost": lambda s, d: A.fact(s, d).select("word_id", "object_id", "allomorph_id", S.cost(F.col("work"), F.col("work_steps"), F.col("uses"), F.col("outputs")).alias("cost")),
    "calibrated_weights": lambda s, d: S.calibrated(A.fact(s, d).groupBy("word_id").agg(F.sum("work").alias("work"), F.sum("outputs").alias("allocations")).join(A.word(s, d).drop("work"), "word_id"), 100).select("words", F.round("work_weight", 3).alias("work_weight"), F.round("alloc_weight", 3).alias("alloc_weight")),
    "latency_percentiles": lambda s, d: S.percentiles(A.word(s, d), "run_id", "elapsed_ns"),
    "median_of_medians": lambda s, d: S.median_of_medians(A.word(s, d), "run_id", "text_id", "elapsed_ns"),
}

SQL = {
    "per_word_report": A.sql("SELECT form, elapsed_ns, work, passes, capped, timed_out, invalid_shape, run_id FROM word", "word"),
    "total_elapsed": A.sql("SELECT CAST(coalesce(sum(elapsed_ns), 0) AS BIGINT) AS total_elapsed_ns FROM word", "word"),
    "total_elapsed_of_word": A.sql("SELECT CAST(coalesce(sum(elapsed_ns), 0) AS BIGINT) AS total_elapsed_ns FROM word WHERE form = '7'", "word"),
    "per_object_report": A.sql(f"SELECT key, kind, label, {_MASKED}, {_AMP} {_JOIN} WHERE {_LIVE} GROUP BY object_id, key, kind, label", "fact", "object"),
    "per_object_no_censored": A.sql(f"SELECT key, kind, label, {_MASKED}, {_AMP} {_JOIN} {_WORD} WHERE {_LIVE} AND NOT capped AND NOT timed_out GROUP BY object_id, key, kind, label", "fact", "object", "word"),
    "per_object_filtered": A.sql(f"SELECT key, kind, label, {_MASKED}, {_AMP} {_JOIN} {_WORD} WHERE kind = 'morph_rule' AND direction = 'analysis' AND run_id = 1997 GROUP BY object_id, key, kind, label", "fact", "object", "word"),
    "per_object_sort_amp": A.sql(f"SELECT key, kind, label, {_MASKED}, {_AMP} {_JOIN} WHERE {_LIVE} GROUP BY object_id, key, kind, label", "fact", "object"),
    "per_stratum_group": A.sql(f"SELECT stratum_group, kind, {_MASKED} {_JOIN} LEFT JOIN stratum USING (stratum_id) WHERE {_LIVE} GROUP BY stratum_group, kind", "fact", "object", "stratum"),
    "per_allomorph_report": A.sql(f"SELECT key, kind, allomorph_id, {_SUMS}, {_AMP} {_JOIN} WHERE {_LIVE} GROUP BY key, kind, allomorph_id", "fact", "object"),
    "per_kind_report": A.sql(f"SELECT kind, count(DISTINCT object_id) AS objects, {_MASKED} {_JOIN} WHERE {_LIVE} GROUP BY kind", "fact", "object"),
    "per_morpheme_report": A.sql(f"SELECT morpheme_id, morpheme_key, {_MASKED} {_JOIN} LEFT JOIN morpheme USING (morpheme_id) WHERE kind = 'lex_entry' GROUP BY morpheme_id, morpheme_key", "fact", "object", "morpheme"),
    "never_fires": A.sql(f"SELECT key, kind, direction, CAST(sum(attempts) AS BIGINT) AS attempts {_JOIN} WHERE kind IN ('morph_rule', 'phon_rule') GROUP BY key, kind, direction HAVING sum(outputs) = 0 AND sum(attempts) >= 300", "fact", "object"),
    "gate_report": A.sql("SELECT object_id, stratum_id % 5 AS feature, CAST(sum(outputs) AS BIGINT) AS passed, CAST(sum(not_applied) AS BIGINT) AS blocked FROM fact GROUP BY 1, 2", "fact"),
    "gate_accumulated": A.sql("SELECT object_id, stratum_id % 5 AS feature, CAST(sum(outputs * CASE WHEN stratum_id % 5 < 3 THEN 2 ELSE 1 END) AS BIGINT) AS passed, CAST(sum(not_applied * CASE WHEN stratum_id % 5 < 3 THEN 2 ELSE 1 END) AS BIGINT) AS blocked FROM fact GROUP BY 1, 2", "fact"),
    "gate_header": A.sql("SELECT count(*) FILTER (WHERE gates_measured) AS measured, count(*) FILTER (WHERE NOT gates_measured) AS unmeasured, count(*) FILTER (WHERE capped OR timed_out) AS censored FROM word", "word"),
    "mixed_settings": A.sql(f"!runs AS ({_RUNS}) SELECT count(DISTINCT options_hash) AS options, count(DISTINCT work_cap) AS caps FROM runs", "word"),
    "kind_exists": A.sql("SELECT count(*) > 0 AS present FROM object WHERE kind = 'lex_entry'", "object"),
    "provenance_guard": A.sql(f"!runs AS ({_RUNS}) SELECT count(*) AS named_facts, count(*) FILTER (WHERE counter_semantics IS NULL) AS without_run, count(*) FILTER (WHERE counter_semantics <> 8) AS other_semantics FROM fact JOIN word USING (word_id) LEFT JOIN runs USING (run_id) WHERE allomorph_id <> 0", "fact", "word"),
    "compact_facts": A.sql(f"!last AS (SELECT * FROM fact QUALIFY row_number() OVER (PARTITION BY {', '.join(S.KEY)} ORDER BY written DESC) = 1), sums AS (SELECT object_id, kind, direction, {_SUMS} FROM last JOIN object USING (object_id) GROUP BY object_id, kind, direction) SELECT * FROM sums WHERE {' OR '.join(c + ' <> 0' for c in S.SUMS)}", "fact", "object"),
    "kind_summary": A.sql(f"SELECT {_SUMS} {_JOIN} WHERE kind = 'phon_rule'", "fact", "object"),
    "top_per_kind": A.sql(f"!r AS (SELECT kind, key, CAST(sum(work) AS BIGINT) AS work {_JOIN} WHERE {_LIVE} GROUP BY kind, key) SELECT kind, key, work, round(CAST(work AS DOUBLE) / sum(work) OVER (PARTITION BY kind), 9) AS share, CAST(row_number() OVER (PARTITION BY kind ORDER BY work DESC, key) AS INTEGER) AS place FROM r QUALIFY place <= 5", "fact", "object"),
    "reusable_words": A.sql(f"!runs AS ({_RUNS}), good AS (SELECT form FROM word JOIN runs USING (run_id) WHERE options_hash = 'h0' AND work_cap = 5000 AND NOT capped AND NOT timed_out) SELECT CAST(c_custkey * 7 AS VARCHAR) AS form FROM customer WHERE CAST(c_custkey * 7 AS VARCHAR) IN (SELECT form FROM good)", "word"),
    "missing_words": A.sql(f"!runs AS ({_RUNS}), good AS (SELECT form FROM word JOIN runs USING (run_id) WHERE options_hash = 'h0' AND work_cap = 5000 AND NOT capped AND NOT timed_out) SELECT CAST(c_custkey * 7 AS VARCHAR) AS form FROM customer WHERE CAST(c_custkey * 7 AS VARCHAR) NOT IN (SELECT form FROM good)", "word"),
    "existing_words": A.sql("SELECT CAST(c_custkey * 7 AS VARCHAR) AS form FROM customer WHERE CAST(c_custkey * 7 AS VARCHAR) IN (SELECT form FROM word)", "word"),
    "prune_counters": A.sql(f"SELECT {_SUMS} FROM fact", "fact"),
    "counts_to_cost": A.sql("SELECT word_id, object_id, allomorph_id, CAST(floor((work * 800 + work_steps * 5 + outputs * 600) / 4) AS BIGINT) AS cost FROM fact", "fact"),
    "calibrated_weights": A.sql("""!w AS (SELECT word_id, CAST(sum(work) AS DOUBLE) AS x, CAST(sum(outputs) AS DOUBLE) AS y FROM fact GROUP BY word_id),
s AS (SELECT count(*) AS words, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * elapsed_ns) AS xt, sum(y * elapsed_ns) AS yt FROM w JOIN word USING (word_id) WHERE x >= 100),
t AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS a, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS b, greatest(xt / xx, 0) AS ox, greatest(yt / yy, 0) AS oy FROM s)
SELECT words, round(CASE WHEN a >= 0 AND b >= 0 THEN a WHEN ox * xt >= oy * yt THEN ox ELSE 0 END, 3) AS work_weight, round(CASE WHEN a >= 0 AND b >= 0 THEN b WHEN ox * xt >= oy * yt THEN 0 ELSE oy END, 3) AS alloc_weight FROM t""", "fact", "word"),
    "latency_percentiles": A.sql("SELECT run_id, count(*) AS n, round(quantile_cont(elapsed_ns, 0.5), 3) AS p50, round(quantile_cont(elapsed_ns, 0.95), 3) AS p95, round(quantile_cont(elapsed_ns, 0.99), 3) AS p99, max(elapsed_ns) AS largest, CAST(sum(elapsed_ns) AS BIGINT) AS total FROM word GROUP BY run_id", "word"),
    "median_of_medians": A.sql("!i AS (SELECT run_id, text_id, median(elapsed_ns) AS m, max(elapsed_ns) AS hi, min(elapsed_ns) AS lo FROM word GROUP BY 1, 2) SELECT run_id, median(m) AS median, count(*) AS items, bool_or(hi > 3.0 * lo) AS noisy FROM i GROUP BY run_id", "word"),
}
