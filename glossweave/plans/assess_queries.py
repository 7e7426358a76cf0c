"""Comparisons bound to events (two runs' outcomes) and to orders with their lines (two runs over words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assess as X
from . import adapters as A


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = A.outcome(s, d)
    return o.where("baseline"), o.where(~F.col("baseline"))


def run(s: SparkSession, d: str, left: bool) -> DataFrame:
    """(word, status, cost, parts) of one of two runs; the second names some words and reads some lines otherwise."""
    flag = F.when((F.col("l_linenumber") == 6) & F.lit(not left), "X").otherwise(F.col("l_returnflag")).alias("flag")
    li = A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag)
    parts = li.groupBy(F.col("l_orderkey").alias("word")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber" if left else "l_partkey", "l_suppkey", "flag"))), lambda x: x["flag"]).alias("parts"))
    o = A.table(s, d, "orders")
    late = F.col("o_custkey") % 17 == 0
    status = F.when(F.col("o_orderstatus") == "P", "CAP").when(late & F.lit(not left), "TIMEOUT").otherwise("ok")
    cost = F.floor(F.col("o_totalprice")).cast("long")
    cost = cost if left else cost + F.col("o_custkey") % 1000
    runs = o.select(F.col("o_orderkey").alias("word"), status.alias("status"), cost.alias("cost"), (F.col("o_custkey") % 13 == 0).alias("renamed")).join(parts, "word")
    return runs.select((F.col("word") if left else F.when(F.col("renamed"), -F.col("word")).otherwise(F.col("word"))).alias("word"), "status", "cost", "parts")


def supersedes(s: SparkSession, d: str) -> DataFrame:
    """Each fifth user's cases go on as those of the next user."""
    c = A.outcome(s, d).select("case_id").distinct().where(F.floor(F.col("case_id") / 1000) % 5 == 0)
    return c.select((F.col("case_id") + 1000).alias("new_id"), F.col("case_id").alias("old_id"))


def outcomes(s: SparkSession, d: str) -> DataFrame:
    return A.outcome(s, d).select(F.floor(F.col("case_id") / 1000).alias("user"), F.when(F.col("identity") == "error", "incomplete").when(F.col("identity") == "signup", "not_attempted").otherwise("complete").alias("outcome"))


def statuses(s: SparkSession, d: str) -> DataFrame:
    return A.outcome(s, d).select((F.col("event_id") % 40).alias("suite"), F.when(F.col("event_id") % 40 < 3, "purchase").otherwise(F.col("identity")).alias("status"))


_ST = ["click", "purchase", "error", "signup", "view"]


def verdicts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = A.table(s, d, "part").groupBy("p_brand").agg(F.round(F.avg(F.when(F.col("p_size") > 20, 1.0).otherwise(0.0)), 6).alias("v"))
    measured = p.select(F.col("p_brand").alias("name"), F.when(F.col("p_brand") != "Brand#3", F.col("v")).alias("value"))
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return measured, p.select(F.col("p_brand").alias("name"), (0.5 + number % 3 / 10).alias("threshold"), (0.4 + number % 7 / 20).alias("floor"))


def traces(s: SparkSession, d: str, left: bool) -> DataFrame:
    li = A.table(s, d, "lineitem").where(F.col("l_linestatus") == ("O" if left else "F"))
    return li.select(F.col("l_returnflag").alias("type"), (F.col("l_partkey") % 50).alias("name"), F.col("l_linenumber").alias("subrule"), F.floor(F.col("l_discount") * 100).cast("long").alias("reason"))


def expected(s: SparkSession, d: str) -> DataFrame:
    o = A.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("word_id"), (F.col("o_orderstatus") == "O").alias("expected"))


QUERIES = {
    "analysis_sets": lambda s, d: X.analysis_sets(A.outcome(s, d).select("case_id", "identity", F.lit(1).cast("long").alias("count"), (F.col("value") < 5).alias("guessed"))),
    "delta_identities": lambda s, d: X.identity_delta(*sides(s, d)),
    "delta_categories": lambda s, d: X.case_delta(*sides(s, d)),
    "delta_superseded": lambda s, d: X.case_delta(*sides(s, d), supersedes(s, d)),
    "ambiguous_supersession": lambda s, d: X.ambiguous_supersession(supersedes(s, d).unionByName(supersedes(s, d).where(F.col("old_id") % 3 == 0))),
    "delta_summary": lambda s, d: X.delta_summary(X.case_delta(*sides(s, d))),
    "report_status": lambda s, d: X.report_status(outcomes(s, d), "user"),
    "ledger": lambda s, d: X.ledger(statuses(s, d), "suite", _ST, "purchase"),
    "certification_gate": lambda s, d: X.all_certified(X.ledger(statuses(s, d), "suite", _ST, "purchase"), X.ledger(statuses(s, d), "suite", _ST, "purchase").select("suite", F.col("declared").alias("expected")), "suite"),
    "run_compare": lambda s, d: X.run_compare(run(s, d, True), run(s, d, False)),
    "bucket_compare": lambda s, d: X.bucket_compare(run(s, d, True), run(s, d, False)),
    "fst_verify": lambda s, d: X.set_verify(run(s, d, True), run(s, d, False)).select("word", "comparable", F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join(F.array_sort("extra"), ",").alias("extra")),
    "fst_verify_totals": lambda s, d: X.verify_totals(X.set_verify(run(s, d, True), run(s, d, False))),
    "cost_compare": lambda s, d: X.cost_compare(run(s, d, True), run(s, d, False)),
    "differential_counters": lambda s, d: X.differential(expected(s, d), run(s, d, True).select(F.col("word").alias("word_id"), (F.col("status") == "ok").alias("observed")), run(s, d, False).select(F.col("word").alias("word_id"), (F.col("cost") % 2 == 0).alias("oracle"))),
    "trace_diff": lambda s, d: X.bag_difference(traces(s, d, True), traces(s, d, False)),
    "leakage": lambda s, d: X.disjoint(A.table(s, d, "documents").where(F.col("doc_id") % 2 == 0).select("text"), A.table(s, d, "documents").where(F.col("doc_id") % 2 == 1).select("text"), "text").select(F.sha2("text", 256).alias("digest")),
    "readiness_verdicts": lambda s, d: X.readiness(*verdicts(s, d)),
    "adjudicated_only": lambda s, d: A.outcome(s, d).where(F.col("identity") == "purchase").groupBy("case_id").agg(F.count(F.lit(1)).alias("n")),
}

_RUN = """{n} AS (SELECT {word} AS word, CASE WHEN o_orderstatus = 'P' THEN 'CAP'{late} ELSE 'ok' END AS status, CAST(floor(o_totalprice) AS BIGINT){more} AS cost, parts FROM orders JOIN
 (SELECT l_orderkey, list({flag} ORDER BY {by}, l_suppkey, {flag}) AS parts FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
_TWO = "WITH " + _RUN.format(n="l", late="", more="", by="l_linenumber", word="o_orderkey", flag="l_returnflag") + ", " + _RUN.format(n="r", late=" WHEN o_custkey % 17 = 0 THEN 'TIMEOUT'", more=" + o_custkey % 1000", by="l_partkey", word="CASE WHEN o_custkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END", flag="CASE WHEN l_linenumber = 6 THEN 'X' ELSE l_returnflag END") + ", b AS (SELECT word, l.status AS ls, r.status AS rs, l.parts AS lp, r.parts AS rp, l.cost AS lc, r.cost AS rc FROM l JOIN r USING (word))"
_DELTA = """!b AS (SELECT DISTINCT {case} AS case_id, identity FROM outcome {join} WHERE baseline), a AS (SELECT DISTINCT case_id, identity FROM outcome WHERE NOT baseline),
m AS (SELECT case_id, identity, max(b) AS b, max(a) AS a FROM (SELECT case_id, identity, 1 AS b, 0 AS a FROM b UNION ALL SELECT case_id, identity, 0, 1 FROM a) GROUP BY ALL),
t AS (SELECT case_id, count(*) FILTER (WHERE b = 0) AS added, count(*) FILTER (WHERE a = 0) AS removed, count(*) FILTER (WHERE a = 1 AND b = 1) AS retained, max(a) AS ha, max(b) AS hb FROM m GROUP BY case_id),
delta AS (SELECT case_id, added, removed, retained, CASE WHEN ha = 0 THEN 'baseline_only' WHEN hb = 0 THEN 'candidate_only' WHEN added = 0 AND removed = 0 THEN 'unchanged' WHEN removed = 0 THEN 'added_only' WHEN added = 0 THEN 'removed_only' ELSE 'mixed' END AS category FROM t) """
_D = _DELTA.format(case="case_id", join="")
_LEDGER = "l AS (SELECT event_id % 40 AS suite, CASE WHEN event_id % 40 < 3 THEN 'purchase' ELSE event_type END AS status FROM events), g AS (SELECT suite, count(*) AS declared, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in _ST) + " FROM l GROUP BY suite), ledger AS (SELECT *, n_purchase = declared AS certified FROM g)"

SQL = {
    "analysis_sets": A.sql("SELECT case_id, identity, count(*) AS duplicate_count, bool_or(value < 5) AS guessed FROM outcome GROUP BY case_id, identity", "outcome"),
    "delta_identities": A.sql("!b AS (SELECT DISTINCT case_id, identity FROM outcome WHERE baseline), a AS (SELECT DISTINCT case_id, identity FROM outcome WHERE NOT baseline) SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.identity, a.identity) AS identity, CASE WHEN b.case_id IS NULL THEN 'added' WHEN a.case_id IS NULL THEN 'removed' ELSE 'retained' END AS change FROM b FULL JOIN a ON b.case_id = a.case_id AND b.identity = a.identity", "outcome"),
    "delta_categories": A.sql(_D + "SELECT * FROM delta", "outcome"),
    "delta_superseded": A.sql(_DELTA.format(case="CASE WHEN (case_id // 1000) % 5 = 0 THEN case_id + 1000 ELSE case_id END", join="") + "SELECT * FROM delta", "outcome"),
    "ambiguous_supersession": A.sql("SELECT DISTINCT case_id AS old_id, CAST(2 AS BIGINT) AS claims FROM outcome WHERE (case_id // 1000) % 5 = 0 AND case_id % 3 = 0", "outcome"),
    "delta_summary": A.sql(_D + "SELECT category, count(*) AS cases, category <> 'unchanged' AS changed FROM delta GROUP BY category", "outcome"),
    "report_status": A.sql("!s AS (SELECT case_id // 1000 AS user, bool_or(identity NOT IN ('error', 'signup')) AS c, bool_or(identity = 'error') AS i, bool_or(identity = 'signup') AS n FROM outcome GROUP BY 1) SELECT user, CASE WHEN c AND NOT i AND NOT n THEN 'complete' WHEN c THEN 'partial' ELSE 'failed' END AS status FROM s", "outcome"),
    "ledger": f"WITH {_LEDGER} SELECT * FROM ledger",
    "certification_gate": f"WITH {_LEDGER} SELECT count(*) AS groups, count(*) FILTER (WHERE certified) AS passed, bool_and(certified) AS gate FROM ledger",
    "run_compare": f"{_TWO} SELECT coalesce(l.word, r.word) AS word, CASE WHEN r.word IS NULL THEN 'left_only' WHEN l.word IS NULL THEN 'right_only' ELSE 'both' END AS side FROM l FULL JOIN r ON l.word = r.word",
    "bucket_compare": f"{_TWO}, k AS (SELECT CASE WHEN ls <> 'ok' AND rs <> 'ok' THEN 'CAPPED' WHEN ls <> rs THEN 'STATUS_DIFF' WHEN lp = rp THEN 'IDENTICAL' WHEN list_sort(lp) = list_sort(rp) THEN 'MULTISET_EQUAL' WHEN list_sort(list_distinct(lp)) = list_sort(list_distinct(rp)) THEN 'SET_EQUAL' ELSE 'DIFFERENT' END AS bucket FROM b) SELECT bucket, count(*) AS words, round(100.0 * count(*) / (SELECT count(*) FROM k), 6) AS percent FROM k GROUP BY bucket",
    "fst_verify": f"{_TWO} SELECT word, ls = 'ok' AND rs = 'ok' AS comparable, array_to_string(list_sort(list_distinct(list_filter(lp, lambda x: NOT list_contains(rp, x)))), ',') AS missing, array_to_string(list_sort(list_distinct(list_filter(rp, lambda x: NOT list_contains(lp, x)))), ',') AS extra FROM b",
    "fst_verify_totals": f"{_TWO}, v AS (SELECT ls = 'ok' AND rs = 'ok' AS c, len(list_filter(lp, lambda x: NOT list_contains(rp, x))) > 0 AS m, len(list_filter(rp, lambda x: NOT list_contains(lp, x))) > 0 AS x FROM b) SELECT count(*) FILTER (WHERE c AND NOT m AND NOT x) AS equal, count(*) FILTER (WHERE c AND m) AS missing, count(*) FILTER (WHERE c AND x) AS extra, count(*) FILTER (WHERE NOT c) AS incomparable FROM v",
    "cost_compare": f"{_TWO}, s AS (SELECT count(*) FILTER (WHERE ls = 'ok' AND rs = 'ok') AS words, CAST(sum(lc) FILTER (WHERE ls = 'ok' AND rs = 'ok') AS BIGINT) AS before, CAST(sum(rc) FILTER (WHERE ls = 'ok' AND rs = 'ok') AS BIGINT) AS after, count(*) FILTER (WHERE ls <> rs) AS status_changes FROM b) SELECT words, before, after, status_changes, round(100.0 * (CAST(after AS DOUBLE) / before - 1), 6) AS percent, CASE WHEN status_changes > 0 THEN 'inconclusive' WHEN abs(100.0 * (CAST(after AS DOUBLE) / before - 1)) <= 2 THEN 'neutral' ELSE 'other' END AS verdict FROM s",
    "differential_counters": f"{_TWO}, j AS (SELECT o_orderstatus = 'O' AS e, l.status = 'ok' AS ob, r.cost % 2 = 0 AS x FROM orders LEFT JOIN l ON o_orderkey = l.word LEFT JOIN r ON o_orderkey = r.word) SELECT count(*) AS words, count(*) FILTER (WHERE e AND coalesce(ob, false)) AS accepted, count(*) FILTER (WHERE NOT e AND NOT coalesce(ob, false)) AS rejected, count(*) FILTER (WHERE e AND NOT coalesce(ob, false)) AS missed, count(*) FILTER (WHERE NOT e AND coalesce(ob, false)) AS overaccepted, count(*) FILTER (WHERE ob IS NULL) AS unobserved, count(*) FILTER (WHERE x IS NULL) AS without_oracle, count(*) FILTER (WHERE x IS NOT NULL AND x <> coalesce(ob, false)) AS oracle_differs FROM j",
    "trace_diff": "WITH t AS (SELECT l_returnflag AS type, l_partkey % 50 AS name, l_linenumber AS subrule, CAST(floor(l_discount * 100) AS BIGINT) AS reason, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS d FROM lineitem) SELECT type, name, subrule, reason, CASE WHEN sum(d) > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(sum(d)) AS BIGINT) AS copies FROM t GROUP BY ALL HAVING sum(d) <> 0",
    "leakage": "SELECT sha256(text) AS digest FROM (SELECT text FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 2 = 1)",
    "readiness_verdicts": "WITH p AS (SELECT p_brand AS name, round(avg(CASE WHEN p_size > 20 THEN 1.0 ELSE 0.0 END), 6) AS v, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS n FROM part GROUP BY p_brand), t AS (SELECT name, CASE WHEN name <> 'Brand#3' THEN v END AS v, CAST(0.5 AS DOUBLE) + CAST(n % 3 AS DOUBLE) / 10 AS t, CAST(0.4 AS DOUBLE) + CAST(n % 7 AS DOUBLE) / 20 AS f FROM p) SELECT name, CASE WHEN f > t THEN 'bad_policy' WHEN v IS NULL THEN 'missing' WHEN v < 0 OR v > 1 THEN 'bad_value' WHEN v >= t THEN 'pass' WHEN v < f THEN 'below_floor' ELSE 'fail' END AS verdict FROM t",
    "adjudicated_only": A.sql("SELECT case_id, count(*) AS n FROM outcome WHERE identity = 'purchase' GROUP BY case_id", "outcome"),
}
