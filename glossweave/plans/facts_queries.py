"""Grammar facts and n-gram models bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import facts as X
from ..operators import ngrams as N
from ..session import stored
from . import adapters as A


def forest(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return A.table(s, d, "part").where(k > 0).select(k.alias("node"), F.when(k > 1, F.floor(k / 2).cast("long")).alias("parent"))


def nodes(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("work"), (F.col("p_partkey") % 97 == 5).alias("success"))


def edges(s: SparkSession, d: str) -> list:
    pick = lambda t, a, b: A.table(s, d, t).select(F.col(a).alias("referrer"), F.col(b).alias("target"))
    return [("order", "customer", pick("orders", "o_orderkey", "o_custkey")), ("line", "part", pick("lineitem", "l_orderkey", "l_partkey")), ("line", "supplier", pick("lineitem", "l_orderkey", "l_suppkey")), ("customer", "nation", pick("customer", "c_custkey", "c_nationkey")), ("nation", "region", pick("nation", "n_nationkey", "n_regionkey"))]


def decisions(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    return e.select(F.col("user_id").alias("subject"), F.hour("ts").alias("stage"), F.col("event_id").alias("decision"), (F.col("value") > 3).alias("loaded"), F.col("event_type").alias("disposition"), F.col("props").alias("reason"))


def lexicon(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "part").select("p_partkey", F.col("p_name").alias("stem"), F.array(F.lower("p_brand"), F.lower("p_type")).alias("glosses"), F.col("p_type").alias("pos"), F.when(F.col("p_size") > 25, "active").otherwise("draft").alias("state"))


def predictions(s: SparkSession, d: str) -> DataFrame:
    """Brands as candidates, sizes as forms."""
    p = A.table(s, d, "part")
    return p.groupBy(F.col("p_brand").alias("candidate"), (F.col("p_size") % 10).alias("form")).agg((F.sum("p_partkey") % 3 > 0).alias("predicted"))


def answers(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "region").select(F.col("r_regionkey").alias("form"), F.when(F.col("r_regionkey") == 0, True).when(F.col("r_regionkey") == 1, False).alias("answer"))


def mutations(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    return e.select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("entry"), F.when(F.col("event_type") == "error", "remove").otherwise("put").alias("action"), F.col("event_type").alias("value"), "event_id")


def expecting(s: SparkSession, d: str) -> DataFrame:
    """The mutations, each expecting the revision that its entry has; clicks expect another one and are refused."""
    m = mutations(s, d)
    good = (F.col("value") != "click").cast("long")
    before = F.sum(good).over(Window.partitionBy("entry").orderBy("event_id")) - good
    return m.withColumn("expected", F.when(F.col("value") == "click", -1).otherwise(before))


def state(s: SparkSession, d: str, odd: int) -> DataFrame:
    return X.latest(mutations(s, d).where(F.col("event_id") % 3 != odd), "entry", "event_id")


def witnesses(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), (F.col("l_returnflag") != "N").alias("rejected"))


def cells(s: SparkSession, d: str) -> DataFrame:
    li = A.table(s, d, "lineitem")
    return li.select((F.col("l_partkey") % 6).alias("fixture"), F.col("l_linestatus").alias("backend"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("word"), (F.col("l_tax") < 0.08).alias("exact"))


def classes(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    return A.table(s, d, "nation").select(n.alias("class_id"), F.array(F.when(n == 0, -1).otherwise(F.lit(1).cast("long") + n % 15).cast("long"), F.when(n == 0, -1).otherwise(n % 7 + 8).cast("long")).alias("features"))


def phonemes(s: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return A.table(s, d, "part").select(p.alias("member"), F.array(p % 15 + 1, p % 4 + 8).alias("lanes"))


def toks(s: SparkSession, d: str, train: bool) -> DataFrame:
    c = A.table(s, d, "conversations")
    fold = F.col("conv_id") % 5 != 0
    return N.tokens(c.where(fold if train else ~fold).select((F.col("conv_id") * 1000 + F.col("turn")).alias("sid"), "text"), "sid")


def cnt(s: SparkSession, d: str) -> DataFrame:
    """The counts that held-out sentences are scored with, computed once."""
    return stored(N.counts(toks(s, d, True)), "ngrams")


def every(s: SparkSession, d: str) -> DataFrame:
    """The counts of all conversations."""
    return N.counts(toks(s, d, True).unionByName(toks(s, d, False)))


def model(s: SparkSession, d: str) -> DataFrame:
    return stored(N.relative(cnt(s, d)), "relative")


def vocabulary(s: SparkSession, d: str) -> DataFrame:
    """The words of all conversations, those of both folds."""
    return every(s, d).where("n = 1").select("word")


QUERIES = {
    "closure": lambda s, d: X.closure(forest(s, d)),
    "reference_index": lambda s, d: X.reference_index(edges(s, d)),
    "dangling_references": lambda s, d: X.dangling(edges(s, d)[1][2], A.table(s, d, "part").where(F.col("p_partkey") % 7 > 0), "p_partkey").select("referrer", "target"),
    "object_state": lambda s, d: X.object_state(decisions(s, d)),
    "effective_members": lambda s, d: X.effective_members(classes(s, d), phonemes(s, d)),
    "class_members": lambda s, d: X.effective_members(classes(s, d), phonemes(s, d)).groupBy("class_id").agg(F.count(F.lit(1)).alias("members"), F.min("member").alias("first"), F.max("member").alias("last")),
    "class_census": lambda s, d: X.census(A.table(s, d, "lineitem"), "l_returnflag", F.col("l_linestatus") == "O"),
    "diagnostic_codes": lambda s, d: A.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "health_admission": lambda s, d: X.admission(A.table(s, d, "events").select("user_id", F.col("event_type").alias("severity")), "user_id", ["view", "click", "signup", "purchase", "error"]),
    "lexicon_search": lambda s, d: X.search(lexicon(s, d), "red", state="active").select("p_partkey", "stem"),
    "remaining_signatures": lambda s, d: X.remaining(predictions(s, d), answers(s, d)),
    "informative_forms": lambda s, d: X.informative(predictions(s, d), X.remaining(predictions(s, d), answers(s, d)), answers(s, d)),
    "next_best_form": lambda s, d: X.next_form(X.informative(predictions(s, d), X.remaining(predictions(s, d), answers(s, d)), answers(s, d))),
    "lexicon_latest": lambda s, d: X.latest(mutations(s, d), "entry", "event_id"),
    "lexicon_revisions": lambda s, d: X.checked_mutations(expecting(s, d), "entry", "event_id"),
    "lexicon_reconcile": lambda s, d: X.reconciled(state(s, d, 0), state(s, d, 1), "entry"),
    "msa_merge": lambda s, d: X.merged(A.table(s, d, "part"), ["p_brand", "p_type", "p_size"], "p_partkey"),
    "candidate_filter": lambda s, d: X.passed_candidates(witnesses(s, d)),
    "coverage_uncovered": lambda s, d: X.uncovered(A.table(s, d, "part").select("p_brand", "p_type"), A.table(s, d, "part").where("p_size > 45").select("p_brand", "p_type"), ["p_brand", "p_type"]),
    "strategy_coverage": lambda s, d: X.coverage_join(A.table(s, d, "part").where("p_size > 10").groupBy("p_brand").agg(F.max("p_size").alias("curated")), A.table(s, d, "part").where("p_size < 50 AND p_brand <> 'Brand#7'").groupBy("p_brand").agg(F.max("p_size").alias("measured")), "p_brand"),
    "scoreboard": lambda s, d: X.scoreboard(cells(s, d)),
    "branch_census": lambda s, d: X.dead_branches(X.closure(forest(s, d)), nodes(s, d)),
    "network_degrees": lambda s, d: X.degrees(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("src"))),
    "stored_without_parse": lambda s, d: X.stored_without_parse(A.outcome(s, d).where("baseline").select(F.col("case_id").alias("word"), "identity").distinct(), A.outcome(s, d).where(~F.col("baseline")).select(F.col("case_id").alias("word"), "identity"), A.outcome(s, d).where("value > 2").select(F.col("case_id").alias("word")).distinct()),
    "undeclared_segments": lambda s, d: X.undeclared(A.table(s, d, "documents"), A.table(s, d, "documents").where("lang = 'en'").select(F.explode(F.split("text", "")).alias("character")).distinct()),
    "evenly_spaced": lambda s, d: X.evenly(A.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100),
    "lineage_mapping": lambda s, d: X.lineage(A.table(s, d, "part").select(F.col("p_partkey").alias("source")), A.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("output")), A.table(s, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("role"), F.col("l_suppkey").alias("output")).distinct()),
    "occurrence_identities": lambda s, d: X.occurrence_identities(A.outcome(s, d).select(F.col("case_id").alias("occurrence"), "identity", (F.col("value") < 5).alias("guessed"))),
    "grammar_health": lambda s, d: X.health([("no_line", "warning", A.table(s, d, "part").join(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select(F.col("p_partkey").alias("subject"))), ("negative_balance", "error", A.table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("subject"))), ("repeated_name", "information", A.table(s, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).where("n > 100").select(F.col("p_name").alias("subject")))]),
    "ngram_counts": lambda s, d: every(s, d),
    "backoff_score": lambda s, d: N.scored(toks(s, d, False), model(s, d)).select("id", "ix", "word", F.round("score", 12).alias("score"), "known"),
    "predict_topk": lambda s, d: N.predicted(every(s, d)),
    "predict_next": lambda s, d: N.predict_next(toks(s, d, False), model(s, d)).select("c2", "word", F.round("score", 12).alias("score"), "rank"),
    "evaluate_model": lambda s, d: (lambda c: N.evaluated(toks(s, d, False), stored(N.relative(c), "relative"), c))(cnt(s, d)).select("tokens", *(F.round(c, 6 if c != "perplexity" else 3).alias(c) for c in ("oov_rate", "perplexity", "recall_at_1", "recall_at_k", "mrr", "saved"))),
    "retrieval_metrics": lambda s, d: N.retrieval(toks(s, d, False), N.predicted(cnt(s, d))).select("tokens", *(F.round(c, 9).alias(c) for c in ("recall_at_1", "recall_at_k", "mrr"))),
    "perplexity": lambda s, d: (lambda m: N.perplexity(N.scored(toks(s, d, False), m), N.mass(m), m))(model(s, d)).select("words", F.round("perplexity", 3).alias("perplexity")),
    "keystroke_savings": lambda s, d: N.keystrokes(toks(s, d, False), cnt(s, d)),
    "sentence_split": lambda s, d: N.split(A.table(s, d, "documents").select("doc_id"), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n")),
    "synthetic_corpus": lambda s, d: N.synthetic(s, A.table(s, d, "conversations").count()),
    "corrupted_words": lambda s, d: N.corrupted(vocabulary(s, d)),
}

_TREE = "t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, CAST(p_size AS BIGINT) AS work, p_partkey % 97 = 5 AS success FROM part WHERE p_partkey > 0), c AS (SELECT node, parent AS ancestor, 1 AS depth FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.node, t.parent, depth + 1 FROM c JOIN t ON c.ancestor = t.node WHERE t.parent IS NOT NULL)"
_REFS = [("order", "customer", "o_orderkey", "o_custkey", "orders"), ("line", "part", "l_orderkey", "l_partkey", "lineitem"), ("line", "supplier", "l_orderkey", "l_suppkey", "lineitem"), ("customer", "nation", "c_custkey", "c_nationkey", "customer"), ("nation", "region", "n_nationkey", "n_regionkey", "nation")]
_PRED = "p AS (SELECT p_brand AS candidate, p_size % 10 AS form, sum(p_partkey) % 3 > 0 AS predicted FROM part GROUP BY 1, 2), a AS (SELECT r_regionkey AS form, CASE r_regionkey WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM region), wrong AS (SELECT candidate FROM p JOIN a USING (form) WHERE predicted <> answer), rest AS (SELECT DISTINCT candidate FROM p WHERE candidate NOT IN (SELECT candidate FROM wrong)), inf AS (SELECT form, count(*) FILTER (WHERE predicted) AS yes, count(*) AS total FROM p JOIN rest USING (candidate) WHERE form NOT IN (SELECT form FROM a WHERE answer IS NOT NULL) GROUP BY form HAVING count(*) FILTER (WHERE predicted) BETWEEN 1 AND count(*) - 1)"
_LAST = "SELECT entry, value FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY event_id DESC) AS r FROM m{w}) WHERE r = 1 AND action <> 'remove'"
_MUT = "m AS (SELECT user_id * 10 + event_id % 10 AS entry, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'put' END AS action, event_type AS value, event_id FROM events)"
_TOK = """{n} AS (SELECT id, CAST(j - 3 AS INTEGER) AS ix, w[j] AS word, w[j - 1] AS c1, w[j - 2] || ' ' || w[j - 1] AS c2 FROM (SELECT id, w, unnest(generate_series(3, len(w))) AS j FROM
 (SELECT conv_id * 1000 + turn AS id, list_concat(['<s>', '<s>'], regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), ['</s>']) AS w FROM conversations WHERE conv_id % 5 {op} 0)))"""
_CNT = "WITH " + _TOK.format(n="train", op="<>") + ", " + _TOK.format(n="test", op="=") + ", cnt AS (SELECT n, context, word, count(*) AS count FROM (SELECT 1 AS n, '' AS context, word FROM train UNION ALL SELECT 2, c1, word FROM train UNION ALL SELECT 3, c2, word FROM train) GROUP BY ALL), rel AS (SELECT n, context, word, count, count / CAST(sum(count) OVER (PARTITION BY n, context) AS DOUBLE) AS p FROM cnt)"
_EVERY = "WITH " + _TOK.format(n="train", op="<>") + ", " + _TOK.format(n="test", op="=") + ", whole AS (SELECT * FROM train UNION ALL SELECT * FROM test), cnt AS (SELECT n, context, word, count(*) AS count FROM (SELECT 1 AS n, '' AS context, word FROM whole UNION ALL SELECT 2, c1, word FROM whole UNION ALL SELECT 3, c2, word FROM whole) GROUP BY ALL)"
_CNT = _CNT.replace("cnt AS (", "cnt AS MATERIALIZED (").replace("rel AS (", "rel AS MATERIALIZED (")
_SC = "sc AS (SELECT id, ix, test.word, c1, c2, coalesce(r3.p, r2.p * 0.4, r1.p * 0.16000000000000003, 1e-6) AS score, r1.p IS NOT NULL AS known FROM test LEFT JOIN rel r3 ON r3.n = 3 AND r3.context = c2 AND r3.word = test.word LEFT JOIN rel r2 ON r2.n = 2 AND r2.context = c1 AND r2.word = test.word LEFT JOIN rel r1 ON r1.n = 1 AND r1.word = test.word)"
_MASS = "m1 AS (SELECT b.context AS short, 1 + 0.4 * (1 - sum(a.p)) AS m FROM rel b JOIN rel a ON a.n = 1 AND a.word = b.word WHERE b.n = 2 GROUP BY 1), m2 AS (SELECT c.context, 1 + 0.4 * (max(m1.m) - sum(b.p)) AS m FROM rel c JOIN rel b ON b.n = 2 AND b.context = string_split(c.context, ' ')[2] AND b.word = c.word JOIN m1 ON m1.short = b.context WHERE c.n = 3 GROUP BY 1)"
_TOP = "pred AS (SELECT context, word, CAST(row_number() OVER (PARTITION BY context ORDER BY count DESC, word) AS INTEGER) AS rank FROM cnt WHERE n = 2 QUALIFY rank <= 5)"

SQL = {
    "closure": f"WITH RECURSIVE {_TREE} SELECT * FROM c",
    "reference_index": " UNION ".join(f"SELECT '{t}' AS target_kind, CAST({b} AS BIGINT) AS target, '{r}' AS referrer_kind, CAST({a} AS BIGINT) AS referrer FROM {x}" for r, t, a, b, x in _REFS),
    "dangling_references": "SELECT l_orderkey AS referrer, l_partkey AS target FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 > 0)",
    "object_state": "WITH e AS (SELECT user_id AS subject, CAST(hour(ts) AS INTEGER) AS stage, event_id, value > 3 AS loaded, event_type, props FROM events), l AS (SELECT * FROM e QUALIFY stage = max(stage) OVER (PARTITION BY subject)) SELECT subject, max(stage) AS final_stage, CASE WHEN bool_and(loaded) = bool_or(loaded) THEN bool_and(loaded) END AS loaded, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS dispositions, arg_min(props, event_id) AS primary_reason FROM l GROUP BY subject",
    "effective_members": "WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS class_id, CASE WHEN n_nationkey = 0 THEN CAST(-1 AS BIGINT) ELSE 1 + n_nationkey % 15 END AS f0, CASE WHEN n_nationkey = 0 THEN CAST(-1 AS BIGINT) ELSE n_nationkey % 7 + 8 END AS f1 FROM nation) SELECT class_id, p_partkey AS member, CASE WHEN f0 = -1 AND f1 = -1 THEN 'unrestricted' ELSE 'features' END AS basis FROM c, part WHERE ((p_partkey % 15 + 1) & ~f0) = 0 AND ((p_partkey % 4 + 8) & ~f1) = 0",
    "class_members": "WITH e AS (WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS class_id, CASE WHEN n_nationkey = 0 THEN CAST(-1 AS BIGINT) ELSE 1 + n_nationkey % 15 END AS f0, CASE WHEN n_nationkey = 0 THEN CAST(-1 AS BIGINT) ELSE n_nationkey % 7 + 8 END AS f1 FROM nation) SELECT class_id, p_partkey AS member, CASE WHEN f0 = -1 AND f1 = -1 THEN 'unrestricted' ELSE 'features' END AS basis FROM c, part WHERE ((p_partkey % 15 + 1) & ~f0) = 0 AND ((p_partkey % 4 + 8) & ~f1) = 0) SELECT class_id, count(*) AS members, min(member) AS first, max(member) AS last FROM e GROUP BY class_id",
    "class_census": "SELECT l_returnflag, count(*) AS occurrences, count(*) FILTER (WHERE l_linestatus <> 'O') AS unhandled FROM lineitem GROUP BY 1",
    "diagnostic_codes": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "health_admission": "WITH e AS (SELECT user_id, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS r FROM events) SELECT user_id, ['view', 'click', 'signup', 'purchase', 'error'][max(r)] AS worst FROM e GROUP BY GROUPING SETS ((user_id), ())",
    "lexicon_search": "SELECT p_partkey, p_name AS stem FROM part WHERE (contains(p_name, 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red')) AND p_size > 25",
    "remaining_signatures": f"WITH {_PRED} SELECT candidate FROM rest",
    "informative_forms": f"WITH {_PRED} SELECT form, yes, total FROM inf",
    "next_best_form": f"WITH {_PRED} SELECT form, yes, total, least(yes, total - yes) AS score FROM inf ORDER BY score DESC, form LIMIT 1",
    "lexicon_latest": f"WITH {_MUT} {_LAST.format(w='')}",
    "lexicon_revisions": f"WITH {_MUT}, g AS (SELECT entry, max_by(CASE WHEN action = 'remove' THEN '' ELSE value END, event_id) FILTER (WHERE value <> 'click') AS v, count(*) FILTER (WHERE value <> 'click') AS revision, count(*) FILTER (WHERE value = 'click') AS refused FROM m GROUP BY entry) SELECT entry, nullif(v, '') AS value, revision, refused FROM g",
    "lexicon_reconcile": f"WITH {_MUT}, a AS ({_LAST.format(w=' WHERE event_id % 3 <> 0')}), b AS ({_LAST.format(w=' WHERE event_id % 3 <> 1')}) SELECT coalesce(a.entry, b.entry) AS entry, CASE WHEN a.entry IS NULL THEN 'theirs_only' WHEN b.entry IS NULL THEN 'ours_only' WHEN a.value = b.value THEN 'equal' ELSE 'conflict' END AS state FROM a FULL JOIN b ON a.entry = b.entry",
    "msa_merge": "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size) AS representative FROM part",
    "candidate_filter": "SELECT l_orderkey AS candidate, NOT bool_and(l_returnflag <> 'N') AS kept, bool_and(l_returnflag <> 'N') AS rejected FROM lineitem GROUP BY 1",
    "coverage_uncovered": "SELECT p_brand, p_type FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 45",
    "strategy_coverage": "WITH a AS (SELECT p_brand, max(p_size) AS c FROM part WHERE p_size > 10 GROUP BY 1), b AS (SELECT p_brand, max(p_size) AS m FROM part WHERE p_size < 50 AND p_brand <> 'Brand#7' GROUP BY 1) SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, CASE WHEN c IS NULL THEN 'uncurated' WHEN m IS NULL THEN 'unmeasured' WHEN c = m THEN 'agrees' WHEN c > m THEN 'overclaimed' ELSE 'underclaimed' END AS verdict FROM a FULL JOIN b ON a.p_brand = b.p_brand",
    "scoreboard": "WITH c AS (SELECT l_partkey % 6 AS fixture, l_linestatus AS backend, l_orderkey * 10 + l_linenumber AS word, l_tax < 0.08 AS exact FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY fixture, backend ORDER BY word) AS r FROM c) SELECT fixture, backend, count(*) AS words, count(*) FILTER (WHERE exact) AS exact, CASE WHEN bool_and(exact) THEN 'exact' WHEN bool_or(exact) THEN 'partial' ELSE 'none' END AS outcome FROM r WHERE r <= 200 GROUP BY 1, 2",
    "branch_census": f"WITH RECURSIVE {_TREE}, alive AS (SELECT ancestor AS node FROM c JOIN t USING (node) WHERE success UNION SELECT node FROM t WHERE success) SELECT count(*) AS nodes, count(*) FILTER (WHERE node NOT IN (SELECT node FROM alive)) AS dead_nodes, CAST(sum(work) AS BIGINT) AS work, CAST(sum(work) FILTER (WHERE node NOT IN (SELECT node FROM alive)) AS BIGINT) AS dead_work FROM t",
    "network_degrees": "SELECT arcs, count(*) AS states FROM (SELECT count(*) AS arcs FROM lineitem GROUP BY l_partkey) GROUP BY arcs",
    "stored_without_parse": A.sql("SELECT DISTINCT case_id AS word, identity FROM outcome WHERE baseline AND case_id IN (SELECT case_id FROM outcome WHERE value > 2) EXCEPT SELECT case_id, identity FROM outcome WHERE NOT baseline", "outcome"),
    "undeclared_segments": "WITH c AS (SELECT lang, unnest(string_split(coalesce(text, ''), '')) AS character FROM documents) SELECT character, count(*) AS occurrences FROM c WHERE character <> '' AND character NOT IN (SELECT DISTINCT character FROM c WHERE lang = 'en') GROUP BY 1",
    "evenly_spaced": "SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 100 = 0",
    "lineage_mapping": "WITH m AS (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) SELECT p_partkey AS source, coalesce(l_returnflag, 'not_compiled') AS role, l_suppkey AS output FROM part LEFT JOIN m ON p_partkey = l_partkey",
    "occurrence_identities": A.sql("!o AS (SELECT case_id, identity, count(*) AS n, bool_or(value < 5) AS g FROM outcome GROUP BY 1, 2) SELECT case_id AS occurrence, count(*) AS identities, CAST(sum(n) AS BIGINT) AS raw, CAST(sum(n) - count(*) AS BIGINT) AS collapsed, bool_or(g) AS any_guessed FROM o GROUP BY 1", "outcome"),
    "grammar_health": "SELECT 'no_line' AS code, 'warning' AS severity, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'negative_balance', 'error', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'repeated_name', 'information', p_name FROM part GROUP BY p_name HAVING count(*) > 100",
    "ngram_counts": f"{_EVERY} SELECT * FROM cnt",
    "backoff_score": f"{_CNT}, {_SC} SELECT id, ix, word, round(score, 12) AS score, known FROM sc",
    "predict_next": f"""{_CNT}, q AS (SELECT DISTINCT c1, c2 FROM test), own AS (SELECT c2, word, max_by(s, n) AS s FROM (SELECT c2, word, p AS s, 3 AS n FROM q JOIN rel ON n = 3 AND context = c2 UNION ALL SELECT c2, word, p * 0.4, 2 FROM q JOIN rel ON n = 2 AND context = c1) GROUP BY 1, 2),
r AS (SELECT c2, word, s, row_number() OVER (PARTITION BY c2 ORDER BY s DESC, word) AS r FROM own QUALIFY r <= 5),
v AS (SELECT word, p * 0.4 * 0.4 AS s, row_number() OVER (ORDER BY p DESC, word) AS g FROM rel WHERE n = 1), m AS (SELECT q.c2, count(own.word) AS m FROM q LEFT JOIN own ON own.c2 = q.c2 GROUP BY 1),
f AS (SELECT c2, word, s FROM r UNION ALL SELECT q.c2, v.word, v.s FROM m q JOIN v ON g <= 5 + q.m WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.c2 = q.c2 AND own.word = v.word))
SELECT c2, word, round(s, 12) AS score, CAST(row_number() OVER (PARTITION BY c2 ORDER BY s DESC, word) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""",
    "predict_topk": f"{_EVERY}, {_TOP} SELECT * FROM pred",
    "retrieval_metrics": f"{_CNT}, {_TOP}, r AS (SELECT rank FROM test LEFT JOIN pred ON context = c1 AND pred.word = test.word) SELECT count(*) AS tokens, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k, round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 9) AS mrr FROM r",
    "perplexity": f"{_CNT}, {_SC}, {_MASS} SELECT count(*) AS words, round(exp(-avg(ln(greatest(score / coalesce(m2.m, 0.4 * coalesce(m1.m, 0.4)), 1e-12)))), 3) AS perplexity FROM sc LEFT JOIN m2 ON m2.context = c2 LEFT JOIN m1 ON m1.short = c1 WHERE known",
    "evaluate_model": f"""{_CNT}, {_SC}, {_MASS}, {_TOP}, r AS (SELECT rank FROM test LEFT JOIN pred ON context = c1 AND pred.word = test.word),
a AS (SELECT round(avg(CASE WHEN known THEN 0.0 ELSE 1.0 END), 6) AS oov_rate FROM sc), b AS (SELECT round(exp(-avg(ln(greatest(score / coalesce(m2.m, 0.4 * coalesce(m1.m, 0.4)), 1e-12)))), 3) AS perplexity FROM sc LEFT JOIN m2 ON m2.context = c2 LEFT JOIN m1 ON m1.short = c1 WHERE known),
c AS (SELECT count(*) AS tokens, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr FROM r),
v AS (SELECT word, count, unnest(generate_series(0, length(word))) AS p FROM cnt WHERE n = 1), k AS (SELECT word, p, row_number() OVER (PARTITION BY substring(word, 1, p) ORDER BY count DESC, word) AS r FROM v), need AS (SELECT word, min(p) AS p FROM k WHERE r <= 3 GROUP BY word),
z AS (SELECT round(1 - sum(least(length(test.word), coalesce(p + 1, length(test.word)))) / CAST(sum(length(test.word)) AS DOUBLE), 6) AS saved FROM test LEFT JOIN need ON need.word = test.word) SELECT * FROM a, b, c, z""",
    "keystroke_savings": f"{_CNT}, v AS (SELECT word, count, unnest(generate_series(0, length(word))) AS p FROM cnt WHERE n = 1), k AS (SELECT word, p, row_number() OVER (PARTITION BY substring(word, 1, p) ORDER BY count DESC, word) AS r FROM v), need AS (SELECT word, min(p) AS p FROM k WHERE r <= 3 GROUP BY word), s AS (SELECT CAST(sum(length(test.word)) AS BIGINT) AS letters, CAST(sum(least(length(test.word), coalesce(p + 1, length(test.word)))) AS BIGINT) AS typed FROM test LEFT JOIN need ON need.word = test.word) SELECT letters, typed, round(1 - typed / CAST(letters AS DOUBLE), 9) AS saved FROM s",
}
