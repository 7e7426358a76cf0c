"""Text analytics bound to the documents: even ids make the word lists, odd ids are evaluated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import features as FS
from ..functions import gloss as G
from ..functions import strings as S
from ..operators import text as T
from ..session import stored
from . import adapters as A


def listed(spark: SparkSession, d: str) -> DataFrame:
    return T.word_list(A.table(spark, d, "documents").where(F.col("doc_id") % 2 == 0))


def occ(spark: SparkSession, d: str) -> DataFrame:
    """The words of all documents."""
    return T.occurrences(A.table(spark, d, "documents"), "doc_id")


class Evaluated:
    """The texts that take no part in the word lists: their tally and evidence, each computed once."""

    def __init__(self, spark: SparkSession, d: str):
        self.lists = listed(spark, d)
        self.tally = stored(T.tallied(T.occurrences(A.table(spark, d, "documents").where(F.col("doc_id") % 2 == 1), "doc_id")), "tally")
        self.checked = stored(T.evidence(self.tally, self.lists), "evidence")

    def covered(self) -> DataFrame:
        return T.language_coverage(self.checked.where(F.size("langs") == 0).select("form"), T.trigram_inventory(self.lists))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def misspelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The unknown words of the evaluated texts, and the word lists."""
    e = Evaluated(spark, d)
    return e.checked.where(F.size("langs") == 0).select("form"), e.lists.select("form").distinct()


def names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The names of customers and of suppliers, which differ by few letters."""
    return A.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("form")).distinct(), A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("form")).distinct()


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of lanes, maps and sets of small numbers, from the columns of lineitem."""
    li = A.table(spark, d, "lineitem")
    q, p, s, o = F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    a, b = F.array(p % 16, s % 8 + 1), F.array(q % 16, o % 8 + 1, p % 32)
    m1 = F.map_from_arrays(F.array(F.lit("number"), F.lit("case")), F.array(p % 7 + 1, s % 15 + 1))
    m2 = F.map_from_arrays(F.array(F.lit("case"), F.lit("person")), F.array(q % 15 + 1, o % 7 + 1))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"), (p % 64).alias("x"), (q % 64).alias("y"), m1.alias("m1"), m2.alias("m2"), F.array(p % 5, s % 5).alias("has"), F.array(q % 5).alias("req"), F.array(o % 9).alias("exc"))


def flat(m: F.Column) -> F.Column:
    return F.when(m.isNotNull(), F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ","))


def environments() -> F.Column:
    k = F.col("p_partkey") % 5
    return F.when(k == 0, "/ # [C] _ a").when(k == 1, "/ _ (b) [V] #").when(k == 2, "a _ b").when(k == 3, "/ [C _ b").otherwise(F.concat(F.lit("/ "), F.element_at(F.split("p_name", " "), 1), F.lit(" _")))


def glosses() -> F.Column:
    return pick(["PL", "poss.1sg", "gen-3pl", "loc", "caus", "SG:abl", "All", "1sg"])


def pick(values: list[str], by: int = 1) -> F.Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(F.col("p_partkey") / by).cast("int") % len(values))


def joined_words(s: SparkSession, d: str) -> DataFrame:
    p = F.split("p_name", " ")
    return A.table(s, d, "part").select(F.concat(F.element_at(p, 1), F.lit("-"), F.element_at(p, -1), F.when(F.col("p_partkey") % 2 == 0, "\u2019s").otherwise("")).alias("form"))


ID = ["l_orderkey", "l_linenumber", "l_partkey"]

QUERIES = {
    "occurrences": lambda s, d: occ(s, d),
    "occurrence_spans": lambda s, d: T.spans(turns(s, d), "id"),
    "wordform_counts": lambda s, d: T.wordforms(occ(s, d)),
    "word_evidence": lambda s, d: Evaluated(s, d).checked.select("form", F.array_join("langs", ",").alias("langs")),
    "text_statistics": lambda s, d: (lambda e: T.statistics(e.tally, e.checked))(Evaluated(s, d)),
    "language_statistics": lambda s, d: (lambda e: T.language_statistics(e.tally, e.checked))(Evaluated(s, d)),
    "language_coverage": lambda s, d: Evaluated(s, d).covered(),
    "language_winner": lambda s, d: T.winner(Evaluated(s, d).covered()),
    "language_proposals": lambda s, d: (lambda e: T.proposals(e.tally, e.checked, T.winner(e.covered())))(Evaluated(s, d)),
    "budgeted_occurrences": lambda s, d: T.budgeted(occ(s, d), 5000),
    "trigram_coverage_percent": lambda s, d: A.table(s, d, "part").select("p_partkey", S.coverage(F.col("p_name"), F.array(*map(F.lit, ["^re", "red", "ed ", "sma", "mal", "all", " ri", "rin", "ing", "ng$"]))).alias("percent")),
    "edit_distance": lambda s, d: T.suggestions(*names(s, d), most=1).select("form", F.col("suggestion").alias("other"), F.col("distance").cast("long").alias("distance")),
    "spelling_suggestions": lambda s, d: T.suggestions(*misspelled(s, d)).select("form", "suggestion", F.col("distance").cast("long").alias("distance")),
    "suggestion_class": lambda s, d: T.suggestions(*names(s, d), most=1).select("form", "suggestion", S.suggestion_method(F.col("form"), F.col("suggestion"), F.length("form") == 2, 0).alias("method")),
    "leipzig_gloss": lambda s, d: A.table(s, d, "part").select("p_partkey", S.leipzig(F.array(F.when(F.col("p_size") % 3 > 0, F.lower("p_brand")), F.element_at(F.split("p_name", " "), 1), F.lit("PL")), F.col("p_size") % 2, F.col("p_size") % 5 > 1, F.col("p_name")).alias("gloss")),
    "result_signature": lambda s, d: T.signatures(A.table(s, d, "events"), "user_id", F.col("event_type")),
    "percent_change": lambda s, d: A.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.percent_change(F.col("l_tax"), F.col("l_discount")), 6).alias("change")),
    "feature_key": lambda s, d: lanes(s, d).select(*ID, S.feature_key(F.lit("noun"), F.transform_values("m1", lambda k, v: v.cast("string"))).alias("key")),
    "environment_key": lambda s, d: A.table(s, d, "part").select("p_partkey", S.environment_key(F.array(F.concat_ws("|", F.split("p_name", " ")), F.col("p_brand"))).alias("key")),
    "canonical_guid": lambda s, d: A.table(s, d, "part").select("p_partkey", S.guid(F.concat(F.col("p_brand"), F.lit(":"), F.upper(F.concat_ws("-", *[F.substr(F.md5("p_name"), F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])))).alias("key")),
    "lexical_date": lambda s, d: A.table(s, d, "orders").select("o_orderkey", S.lexical_date(F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("none")).isNotNull().alias("valid")),
    "nfd_words": lambda s, d: T.occurrences(A.table(s, d, "documents"), "doc_id").select("form").distinct().select("form", F.length(S.nfd(F.col("form"))).cast("long").alias("letters")),
    "environment_tokens": lambda s, d: A.table(s, d, "part").select("p_partkey", S.environment(environments()).alias("e")).select("p_partkey", F.array_join("e.left", " ").alias("left"), F.array_join("e.right", " ").alias("right"), "e.ok"),
    "gloss_features": lambda s, d: A.table(s, d, "part").select("p_partkey", G.inferred(glosses()).alias("feature")),
    "realized_phrases": lambda s, d: A.table(s, d, "part").select("p_partkey", G.realized(F.col("p_name"), pick(["None", "Loc", "Abl", "All"]), pick(list(G.POSSESSORS), 3), pick(["Unspec", "Sg", "Pl"], 7), F.col("p_size") == 9).alias("phrase")),
    "gloss_signatures": lambda s, d: T.signatures(A.table(s, d, "part"), "p_brand", G.gloss_signature(F.array(F.when(F.col("p_size") > 9, F.col("p_type")), F.lit("PL")), F.array(F.col("p_brand"), F.lit("-s")), F.element_at(F.split("p_name", " "), 1))).select("p_brand", F.sha2("signature", 256).alias("signature")),
    "segmentation_alternatives": lambda s, d: T.alternatives(joined_words(s, d)).select("form", "ix", F.array_join("parts", "|").alias("parts"), F.array_join(F.col("utf8_start").cast("array<string>"), ",").alias("starts"), "capped"),
    "readings_analysed_first": lambda s, d: T.analysed_first(T.alternatives(joined_words(s, d)).withColumn("analysed", F.size("parts") > 2)).select("form", F.size("readings").alias("n"), F.array_join(F.get("readings", F.lit(0)), "|").alias("first")),
    "incident_outcomes": lambda s, d: A.table(s, d, "lineitem").groupBy(T.outcome_of(F.col("l_returnflag") == "A", F.col("l_tax") > 0.07, F.col("l_discount") > 0.08, F.col("l_linenumber") == 1, F.col("l_linestatus") == "O").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
    "bit_unify": lambda s, d: lanes(s, d).select(*ID, F.array_join(B.unify(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("lanes"), B.unifiable(F.col("a"), F.col("b")).alias("unifiable")),
    "bit_subsumes": lambda s, d: lanes(s, d).select(*ID, B.subsumes(F.col("b"), F.col("a")).alias("subsumes"), B.superset(F.col("x"), F.col("y")).alias("superset"), B.overlaps(F.col("x"), F.col("y"), negate_b=True, mask=63).alias("overlaps")),
    "bit_algebra": lambda s, d: lanes(s, d).select(*ID, F.col("x").bitwiseAND(F.col("y")).alias("both"), F.col("x").bitwiseOR(F.col("y")).alias("either"), B.except_(F.col("x"), F.col("y")).alias("less"), B.complement(F.col("x"), 63).alias("rest")),
    "mpr_gate": lambda s, d: lanes(s, d).select(*ID, B.gate(F.col("has"), F.col("req"), F.col("exc")).alias("failed")),
    "fs_unify": lambda s, d: lanes(s, d).select(*ID, flat(FS.unify(F.col("m1"), F.col("m2"))).alias("unified"), flat(FS.unify_priority(F.col("m1"), F.col("m2"))).alias("priority")),
    "fs_subsumes": lambda s, d: lanes(s, d).select(*ID, FS.subsumes(FS.union(F.col("m1"), F.col("m2")), F.col("m2")).alias("general"), FS.subsumes(F.col("m1"), F.col("m2")).alias("direct")),
    "stem_names": lambda s, d: lanes(s, d).select(*ID, FS.stem_name(F.array(F.create_map(F.lit("number"), F.lit(3).cast("long"))), F.array(F.create_map(F.lit("case"), F.lit(7).cast("long"))), F.col("m1")).alias("failed")),
    "fs_algebra": lambda s, d: lanes(s, d).select(*ID, flat(FS.union(F.col("m1"), F.col("m2"))).alias("either"), flat(FS.add(F.col("m1"), F.col("m2"), F.create_map(F.lit("case"), F.lit(15).cast("long")))).alias("wide"), flat(FS.subtract(F.col("m1"), F.col("m2"))).alias("less"), flat(FS.without(F.col("m1"), F.array(F.lit("case")))).alias("bare")),
}

_W = "'[\\p{L}\\p{M}\\p{N}]+'"
_OCC = f"occ AS (SELECT doc_id AS text_id, CAST(generate_subscripts(regexp_extract_all(coalesce(text, ''), {_W}), 1) - 1 AS INTEGER) AS ix, unnest(regexp_extract_all(coalesce(text, ''), {_W})) AS form FROM documents WHERE doc_id % 2 = 1)"
_LIST = f"lists AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(coalesce(text, '')), {_W})) AS form FROM documents WHERE doc_id % 2 = 0)"
_FORMS = "forms AS (SELECT DISTINCT lower(form) AS form FROM occ), checked AS (SELECT forms.form, coalesce(list_sort(list(lang) FILTER (WHERE lang IS NOT NULL)), []) AS langs FROM forms LEFT JOIN lists ON forms.form = lists.form GROUP BY forms.form)"
_COVER = """unk AS (SELECT form FROM checked WHERE len(langs) = 0 AND length(form) >= 2), grams AS (SELECT form, unnest(list_transform(generate_series(1, length(form)), lambda i: substring('^' || form || '$', i, 3))) AS gram FROM unk),
inv AS (SELECT DISTINCT lang, unnest(list_transform(generate_series(1, length(form)), lambda i: substring('^' || lower(form) || '$', i, 3))) AS gram FROM lists),
cover AS (SELECT form, lang, CAST(floor(count(*) * 100 / length(form)) AS INTEGER) AS coverage FROM grams JOIN inv USING (gram) GROUP BY form, lang)"""
_WON = "won AS (SELECT form, lang, coverage, CAST(coverage - coalesce(nxt, 0) AS INTEGER) AS margin FROM (SELECT form, lang, coverage, row_number() OVER w AS r, lead(coverage) OVER w AS nxt FROM cover WINDOW w AS (PARTITION BY form ORDER BY coverage DESC, lang)) WHERE r = 1 AND coverage >= 50 AND coverage - coalesce(nxt, 0) >= 10)"
_BASE = f"WITH {_OCC}, {_LIST}, {_FORMS}"
_PAIR = "a AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS form FROM customer), b AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS other FROM supplier)"
_ALL = f"WITH occ AS (SELECT doc_id AS text_id, CAST(generate_subscripts(regexp_extract_all(coalesce(text, ''), {_W}), 1) - 1 AS INTEGER) AS ix, unnest(regexp_extract_all(coalesce(text, ''), {_W})) AS form FROM documents)"
_LANES = """WITH lanes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 16 AS a0, l_suppkey % 8 + 1 AS a1, CAST(l_quantity AS BIGINT) % 16 AS b0, l_orderkey % 8 + 1 AS b1, l_partkey % 32 AS b2, l_partkey % 64 AS x, CAST(l_quantity AS BIGINT) % 64 AS y,
l_partkey % 7 + 1 AS number, l_suppkey % 15 + 1 AS case1, CAST(l_quantity AS BIGINT) % 15 + 1 AS case2, l_orderkey % 7 + 1 AS person, [l_partkey % 5, l_suppkey % 5] AS has, [CAST(l_quantity AS BIGINT) % 5] AS req, [l_orderkey % 9] AS exc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, """
_UNI = "((a0 & b0) <> 0 AND (a1 & b1) <> 0 AND b2 <> 0)"

SQL = {
    "occurrences": f"{_ALL} SELECT * FROM occ",
    "wordform_counts": f"{_ALL} SELECT form, count(*) AS occurrences, count(DISTINCT text_id) AS texts FROM occ GROUP BY form",
    "word_evidence": f"{_BASE} SELECT form, array_to_string(langs, ',') AS langs FROM checked",
    "text_statistics": f"{_BASE} SELECT text_id, CASE WHEN len(langs) > 0 THEN 'valid' ELSE 'misspelled' END AS outcome, count(*) AS occurrences, count(DISTINCT checked.form) AS wordforms FROM occ JOIN checked ON lower(occ.form) = checked.form GROUP BY GROUPING SETS ((1, 2), (2))",
    "language_statistics": f"{_BASE}, n AS (SELECT lower(form) AS form, count(*) AS n FROM occ GROUP BY 1), r AS (SELECT form, n, unnest(langs) AS lang, len(langs) > 1 AS amb FROM n JOIN checked USING (form)) SELECT lang, CAST(sum(n) AS BIGINT) AS valid_occurrences, count(DISTINCT form) AS valid_wordforms, CAST(coalesce(sum(n) FILTER (WHERE amb), 0) AS BIGINT) AS ambiguous_occurrences, count(*) FILTER (WHERE amb) AS ambiguous_wordforms FROM r GROUP BY lang",
    "language_coverage": f"{_BASE}, {_COVER} SELECT * FROM cover",
    "language_winner": f"{_BASE}, {_COVER}, {_WON} SELECT * FROM won",
    "language_proposals": f"""{_BASE}, {_COVER}, {_WON}, n AS (SELECT lower(form) AS form, count(*) AS n FROM occ GROUP BY 1),
r AS (SELECT unnest(langs) AS lang, CASE WHEN len(langs) = 1 THEN n ELSE 0 END AS di, CASE WHEN len(langs) > 1 THEN n ELSE 0 END AS sh, 0 AS ng FROM n JOIN checked USING (form) UNION ALL SELECT lang, 0, 0, n FROM n JOIN checked USING (form) JOIN won USING (form) WHERE len(langs) = 0),
t AS (SELECT lang, CAST(sum(di) AS BIGINT) AS dictionary, CAST(sum(sh) AS BIGINT) AS shared, CAST(sum(ng) AS BIGINT) AS ngram FROM r GROUP BY lang)
SELECT *, dictionary + shared + ngram AS any_evidence, dictionary + ngram AS decisive, CASE WHEN dictionary + ngram >= 5 THEN 'proposed' ELSE 'insufficient' END AS status FROM t""",
    "budgeted_occurrences": f"{_ALL} SELECT text_id, ix, form, row_number() OVER (ORDER BY text_id, ix) <= 5000 AS attempted FROM occ",
    "trigram_coverage_percent": "SELECT p_partkey, CASE WHEN length(p_name) + 2 < 4 THEN 0 ELSE CAST(len(list_filter(list_transform(generate_series(1, length(p_name)), lambda i: substring('^' || lower(p_name) || '$', i, 3)), lambda g: list_contains(['^re', 'red', 'ed ', 'sma', 'mal', 'all', ' ri', 'rin', 'ing', 'ng$'], g))) * 100 // length(p_name) AS INTEGER) END AS percent FROM part",
    "edit_distance": f"WITH {_PAIR} SELECT form, other, levenshtein(form, other) AS distance FROM a, b WHERE form <> other AND abs(length(form) - length(other)) <= 1 AND levenshtein(form, other) <= 1",
    "suggestion_class": f"WITH {_PAIR} SELECT form, other AS suggestion, CASE WHEN length(form) = 2 THEN 'hunspell_rule' WHEN levenshtein(form, other) <= 0 THEN 'edit_distance' ELSE 'ngram_fallback' END AS method FROM a, b WHERE form <> other AND levenshtein(form, other) <= 1",
    "leipzig_gloss": "WITH g AS (SELECT p_partkey, p_name, p_size % 2 AS root, p_size % 5 > 1 AS guessed, [CASE WHEN p_size % 3 > 0 THEN lower(p_brand) END, string_split(p_name, ' ')[1], 'PL'] AS l FROM part) SELECT p_partkey, array_to_string(list_transform(l, lambda g, i: CASE WHEN g IS NOT NULL THEN g WHEN guessed AND i - 1 = root THEN '*' || p_name || '*' ELSE '[?]' END), '-') AS gloss FROM g",
    "result_signature": "SELECT user_id, string_agg(event_type, ';' ORDER BY event_type) AS signature FROM events GROUP BY user_id",
    "gloss_signatures": """WITH g AS (SELECT p_brand, CASE WHEN p_size > 9 THEN 'g:"' || p_type ELSE 'm:"' || p_brand END || '"+g:"PL"|s:"' || string_split(p_name, ' ')[1] || '"' AS part FROM part) SELECT p_brand, sha256(string_agg(part, ';' ORDER BY part)) AS signature FROM g GROUP BY p_brand""",
    "occurrence_spans": f"""WITH c AS (SELECT conv_id * 1000 + turn AS text_id, coalesce(text, '') AS t FROM conversations),
w AS (SELECT text_id, regexp_extract_all(t, {_W}) AS ws, regexp_split_to_array(t, {_W}) AS gs FROM c),
e AS (SELECT text_id, ws, gs, unnest(generate_series(1, len(ws))) AS i FROM w),
o AS (SELECT text_id, CAST(i - 1 AS INTEGER) AS ix, ws[i] AS form, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) AS BIGINT) + CAST(list_sum(list_transform(ws[1:i], lambda x: length(x))) AS BIGINT) AS z, CAST(list_sum(list_transform(gs[1:i], lambda x: strlen(x))) AS BIGINT) + CAST(list_sum(list_transform(ws[1:i], lambda x: strlen(x))) AS BIGINT) AS z8 FROM e)
SELECT text_id, ix, form, z - length(form) AS start, z AS "end", z8 - strlen(form) AS utf8_start, z8 AS utf8_end FROM o""",
    "percent_change": "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax = 0 THEN 0.0 ELSE 100.0 * (l_discount / l_tax - 1) END, 6) AS change FROM lineitem",
    "feature_key": "SELECT l_orderkey, l_linenumber, l_partkey, 'noun|case=' || (l_suppkey % 15 + 1) || ',number=' || (l_partkey % 7 + 1) AS key FROM lineitem",
    "environment_key": "SELECT p_partkey, sha256(array_to_string(list_sort(string_split(p_name, ' ')), '|') || ' ' || p_brand) AS key FROM part",
    "canonical_guid": "SELECT p_partkey, p_brand || ':' || substring(md5(p_name), 1, 8) || '-' || substring(md5(p_name), 9, 4) || '-' || substring(md5(p_name), 13, 4) || '-' || substring(md5(p_name), 17, 4) || '-' || substring(md5(p_name), 21, 12) AS key FROM part",
    "lexical_date": "SELECT o_orderkey, o_orderkey % 3 > 0 AS valid FROM orders",
    "environment_tokens": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '# [C]' WHEN 1 THEN '' WHEN 2 THEN 'a' WHEN 3 THEN 'C' ELSE string_split(p_name, ' ')[1] END AS left, CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN '(b) [V] #' WHEN 2 THEN 'b' WHEN 3 THEN 'b' ELSE '' END AS right, p_partkey % 5 NOT IN (2, 3) AS ok FROM part",
    "gloss_features": "SELECT p_partkey, ['num=Pl', 'poss=P1Sg', 'poss=P3Pl', 'case=Loc', NULL, 'num=Sg', 'case=All', NULL][p_partkey % 8 + 1] AS feature FROM part",
    "incident_outcomes": "SELECT CASE WHEN l_returnflag = 'A' THEN 'valid' WHEN l_tax > 0.07 THEN 'unattempted' WHEN l_discount > 0.08 THEN 'incomplete' WHEN l_linenumber = 1 THEN 'misspelled' WHEN l_linestatus = 'O' THEN 'incomplete' ELSE 'no_analysis' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "realized_phrases": """WITH p AS (SELECT p_partkey, p_name, p_size, ['', 'in', 'from', 'to'][p_partkey % 4 + 1] AS prep, ['', 'my', 'our', 'your', 'your', 'your', 'his', 'her', 'their'][(p_partkey // 3) % 9 + 1] AS own, (p_partkey // 7) % 3 AS num FROM part)
SELECT p_partkey, array_to_string(list_filter([prep, CASE WHEN own = '' AND num = 1 THEN 'a' ELSE own END, CASE WHEN p_size = 9 THEN '*' || p_name || '*' WHEN num = 2 THEN CASE WHEN regexp_matches(p_name, '(s|x|z|ch|sh)$') THEN p_name || 'es' WHEN regexp_matches(p_name, '[^aeiou]y$') THEN substring(p_name, 1, length(p_name) - 1) || 'ies' ELSE p_name || 's' END ELSE p_name END], lambda x: x <> ''), ' ') AS phrase FROM p""",
    "bit_unify": f"{_LANES} CASE WHEN {_UNI} THEN (a0 & b0) || ',' || (a1 & b1) || ',' || b2 END AS lanes, {_UNI} AS unifiable FROM lanes",
    "bit_subsumes": f"{_LANES} ((a0 & ~b0) = 0 AND (a1 & ~b1) = 0 AND (CAST(-1 AS BIGINT) & ~b2) = 0) AS subsumes, (y & ~x) = 0 AS superset, (x & ~y & 63) <> 0 AS overlaps FROM lanes",
    "bit_algebra": f"{_LANES} x & y AS both, x | y AS either, x & ~y AS less, ~x & 63 AS rest FROM lanes",
    "mpr_gate": f"{_LANES} CASE WHEN NOT list_has_any(has, req) THEN 'required' WHEN list_has_any(has, exc) THEN 'excluded' END AS failed FROM lanes",
    "fs_unify": f"{_LANES} CASE WHEN (case1 & case2) <> 0 THEN 'case=' || (case1 & case2) || ',number=' || number || ',person=' || person END AS unified, CASE WHEN (case1 & case2) <> 0 THEN 'case=' || case2 || ',number=' || number || ',person=' || person END AS priority FROM lanes",
    "fs_subsumes": f"{_LANES} true AS general, false AS direct FROM lanes",
    "stem_names": f"{_LANES} CASE WHEN (number & ~CAST(3 AS BIGINT)) <> 0 THEN 'required' WHEN (case1 & ~CAST(7 AS BIGINT)) = 0 THEN 'excluded' END AS failed FROM lanes",
    "fs_algebra": f"{_LANES} 'case=' || (case1 | case2) AS either, CASE WHEN (case1 | case2) = 15 THEN '' ELSE 'case=' || (case1 | case2) || ',' END || 'number=' || number || ',person=' || person AS wide, CASE WHEN (case1 & ~case2) = 0 THEN '' ELSE 'case=' || (case1 & ~case2) || ',' END || 'number=' || number AS less, 'number=' || number AS bare FROM lanes",
}
