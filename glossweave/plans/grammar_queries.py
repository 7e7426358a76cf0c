"""Findings over grammar tables, patterns, projections and identities bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import facts as X
from ..operators import health as H
from ..operators import morphology as M
from ..operators import patterns as P
from ..operators import text as T
from ..sources import files
from . import adapters as A
from .facts_queries import predictions

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
CLASSES = {"V": frozenset("aeiou"), "C": frozenset("bcdfghjklmnpqrstvwxyz"), "L": frozenset("lr")}
PATTERNS = ["[C][V][C]", "[C]+[V](n)", "<[V]>[C]*e", "([C])[V]l(l)", "[L][V]*[C]+", "r[V]"]


def findings(s: SparkSession, d: str) -> DataFrame:
    """Parts stand for phonemes, suppliers for entries, lines for allomorphs, orders for circumfixes, nations for compounds."""
    t = lambda n: A.table(s, d, n)
    part, line = t("part"), t("lineitem")
    return H.report([
        H.collisions("grammar.phoneme.nfd-collision", part, ["p_name", "p_brand"]),
        H.collisions("grammar.boundary.nfd-collision", t("supplier"), ["s_nationkey"]),
        H.unresolved("grammar.phoneme.feature-unresolved", line, "l_orderkey", "l_partkey", part.where("p_size > 2"), "p_partkey"),
        H.unresolved("grammar.natclass.feature-constraint-unresolved", t("customer"), "c_custkey", "c_nationkey", t("nation").where("n_regionkey > 0"), "n_nationkey"),
        H.unresolved("grammar.compound-rule.side-pos-unresolved", t("nation"), "n_nationkey", "n_regionkey", t("region").where("r_regionkey <> 2"), "r_regionkey"),
        H.childless("grammar.msa.no-allomorphs", t("supplier"), "s_suppkey", line.where("l_quantity > 49"), "l_suppkey"),
        H.childless("grammar.msa.inflection-class-unresolved", t("customer"), "c_custkey", t("orders"), "o_custkey"),
        H.halves("grammar.circumfix.missing-half", line, "l_orderkey", "l_linestatus", ("O", "F")),
        H.unresolved("grammar.environment.unresolved", t("orders"), "o_orderkey", "o_custkey", t("customer").where("c_custkey % 10 > 0"), "c_custkey"),
        H.too_many("grammar.limit.parts-of-speech", part, None, "p_name"),
        H.too_many("grammar.limit.feature-values", line, "l_suppkey", "l_partkey"),
    ])


def references(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: A.table(s, d, n)
    e = lambda n, a, b: t(n).select(F.col(a).alias("referrer"), F.col(b).alias("target"))
    k = lambda df, c: df.select(F.col(c).alias("key"))
    return H.validated([
        ("entry.category", e("supplier", "s_suppkey", "s_nationkey"), k(t("nation").where("n_nationkey % 5 > 0"), "n_nationkey")),
        ("allomorph.environment", e("lineitem", "l_orderkey", "l_partkey").distinct(), k(t("part").where("p_size < 45"), "p_partkey")),
        ("class.feature", e("customer", "c_custkey", "c_nationkey"), k(t("supplier"), "s_nationkey")),
        ("compound.side", e("nation", "n_nationkey", "n_regionkey"), k(t("region"), "r_regionkey")),
    ])


def lineage(s: SparkSession, d: str) -> DataFrame:
    """The lines of an order as the morphemes of a word."""
    li = A.table(s, d, "lineitem")
    first = li.groupBy(F.col("l_orderkey").alias("word"), F.col("l_linenumber").alias("ix")).agg(F.min("l_partkey").alias("morpheme"))
    part = A.table(s, d, "part").select(F.col("p_partkey").alias("morpheme"), S.mixed_guid(F.md5("p_name")).alias("form"), F.when(F.col("p_size") > 10, F.lower("p_brand")).alias("analysis"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("type"))
    return H.projected(first, part.select("morpheme", "form"), part.select("morpheme", "analysis"), part.select("morpheme", "type"))


_PARENT, _CHILD, _DETAIL = ["Union", "Gate", "Compose", "Replace"], ["Gate", "Leaf", "Compose", "Replace"], ["", "LexiconFragment", "RewriteRule", "CompositeEmissionMarker"]


def plan_edges(s: SparkSession, d: str) -> DataFrame:
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    leaf = F.col("l_suppkey") % 4 == 1
    return A.table(s, d, "lineitem").select(pick(_PARENT, "l_partkey").alias("parent"), pick(_CHILD, "l_suppkey").alias("child"), F.when(leaf, pick(_DETAIL, "l_orderkey")).otherwise("").alias("detail"), F.when(F.col("l_partkey") % 4 % 3 > 0, "Static").otherwise("").alias("strategy"))


def part_words(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "part").select(F.explode(F.split("p_name", " +")).alias("word")).where("word <> ''")


def plain_forms(s: SparkSession, d: str) -> DataFrame:
    """The distinct words of all documents that are of small Latin letters."""
    return T.occurrences(A.table(s, d, "documents"), "doc_id").select(F.lower("form").alias("word")).where("word RLIKE '^[a-z]+$'").distinct()


PEELED = M.Grammar(LETTERS, (), (M.Affix("RED", copies=2), M.Affix("UM", infix=tuple("um"), after=1)))


def peeled(s: SparkSession, d: str) -> DataFrame:
    states = plain_forms(s, d).select("word", F.col("word").alias("rest"), F.array().cast("array<string>").alias("affixes"))
    return M.peeled(states, PEELED).select("word", "rest", F.array_join("affixes", "+").alias("affixes"))


def dictionary(s: SparkSession, d: str) -> DataFrame:
    """The part words as stems with flags, spelled by four rules."""
    stems = part_words(s, d).select(F.col("word").alias("stem")).distinct().withColumn("flags", F.when(F.col("stem").rlike("^[a-l]"), "SU").otherwise("S"))
    rules = [("SFX", "S", True, "", "s", "[^sxy]"), ("SFX", "S", True, "y", "ies", "y"), ("SFX", "S", True, "", "es", "[sx]"), ("PFX", "U", True, "", "un", ".")]
    return files.spelled(stems, s.createDataFrame(rules, "kind string, flag string, cross boolean, strip string, add string, condition string"))


def small_grammar(s: SparkSession, d: str) -> M.Grammar:
    """A grammar of tables: the part words are the roots, their kind by the place in the name."""
    table = lambda rows, kind: s.createDataFrame(rows, kind)
    first = A.table(s, d, "part").select(F.split("p_name", " ").alias("w"))
    roots = first.select(F.element_at("w", 1).alias("name"), F.lit("A").alias("category")).unionByName(first.select(F.element_at("w", -1).alias("name"), F.lit("N").alias("category"))).distinct()
    return M.compiled({
        "segments": table([(c,) for c in sorted(LETTERS)], "segment string"),
        "classes": table([("V", c) for c in "aeiou"], "class string, segment string"),
        "roots": roots.select("name", F.col("name").alias("shape"), "category", F.lit(False).alias("bound")),
        "affixes": table([("PL", None, "s", "N", None, "n"), ("NEG", "un", None, "A", None, None)], "name string, prefix string, suffix string, takes string, gives string, slot string"),
        "rules": table([(0, "x", "xs", "xes", None, None)], "ix int, name string, source string, target string, left string, right string"),
        "templates": table([("t", 0, "n", True)], "template string, ix int, slot string, optional boolean"),
        "compounds": table([("A", "N", "N")], "first string, second string, whole string"),
    })


def compiled_parses(s: SparkSession, d: str) -> DataFrame:
    """Adjectives, nouns, plurals and compounds of the part names, parsed with the grammar of tables."""
    p = A.table(s, d, "part").select(F.split("p_name", " ").alias("w"), (F.col("p_partkey") % 4).alias("k"))
    a, n = F.element_at("w", 1), F.element_at("w", -1)
    words = p.select(F.when(F.col("k") == 0, F.concat(F.lit("un"), a)).when(F.col("k") == 1, F.concat(n, F.lit("s"))).when(F.col("k") == 2, F.concat(a, n)).otherwise(n).alias("word"))
    return M.parse_words(words, M.reachable(small_grammar(s, d))).select("word", "status", F.size("analyses").alias("analyses"))


QUERIES = {
    "grammar_health_codes": findings,
    "snapshot_validation": references,
    "analysis_projection": lineage,
    "dictionary_forms": dictionary,
    "compiled_parses": compiled_parses,
    "partial_parses": lambda s, d: M.partial_parses(part_words(s, d).select(F.concat("word", F.lit("ss")).alias("word")), small_grammar(s, d)),
    "substrate_report": lambda s, d: X.inferred(X.undeclared(A.table(s, d, "documents"), A.table(s, d, "documents").where("lang = 'en'").select(F.explode(F.split("text", "")).alias("character")).distinct()), S.category(F.col("character"))),
    "signature_catalogue": lambda s, d: X.catalogue(predictions(s, d)),
    "interaction_coverage": lambda s, d: H.interactions(plan_edges(s, d)),
    "candidate_passes": lambda s, d: H.pass_report(A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("witness"), (F.col("l_partkey") % 3).alias("pass"), (F.col("l_returnflag") != "N").alias("rejected"))),
    "pattern_matches": lambda s, d: P.matched(plain_forms(s, d), PATTERNS, LETTERS, CLASSES),
    "pattern_shapes": lambda s, d: s.createDataFrame([(p, P.plain(P.parse(p, LETTERS, CLASSES)), P.display(P.parse(p, LETTERS, CLASSES), CLASSES)) for p in PATTERNS], "pattern string, plain string, display string"),
    "reduplication_peel": peeled,
    "letter_categories": lambda s, d: A.table(s, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).groupBy(S.category(F.col("c")).alias("category")).agg(F.count(F.lit(1)).alias("characters"), F.sum("n").alias("occurrences")),
    "entry_ids": lambda s, d: A.table(s, d, "part").select("p_partkey", S.entry_id(F.md5("p_name")).alias("entry"), S.entry_hex(S.entry_id(F.md5("p_name"))).alias("hex"), S.mixed_guid(F.md5("p_name")).alias("guid")),
    "gate_identities": lambda s, d: A.table(s, d, "part").select("p_partkey", S.gate_feature(F.lit("mpr"), F.col("p_brand"), F.split("p_name", " ")).alias("identity")),
    "canonical_digests": lambda s, d: A.table(s, d, "part").select("p_partkey", F.to_json(F.struct("p_size", "p_brand", F.struct(F.col("p_type").alias("z"), F.col("p_partkey").alias("a")).alias("inner"))).alias("j")).select("p_partkey", S.canonical_json(F.col("j")).alias("canonical"), S.projection_digest("part", F.col("j")).alias("digest")),
}

_F = lambda code, subject, rest: f"SELECT '{code}' AS code, 'error' AS severity, CAST({subject} AS VARCHAR) AS subject {rest}"
_V = lambda field, ref, target, edges, key, keys: f"""SELECT '{field}' AS field, 'missing' AS problem, CAST(r AS VARCHAR) AS referrer, CAST(t AS VARCHAR) AS target FROM (SELECT {edges}) WHERE t IS NOT NULL AND t NOT IN (SELECT {key} FROM {keys})
UNION ALL SELECT '{field}', 'repeated', NULL, CAST({key} AS VARCHAR) FROM {keys} GROUP BY {key} HAVING count(*) > 1"""  # noqa: E731
_GUID = "substring(m, 7, 2) || substring(m, 5, 2) || substring(m, 3, 2) || substring(m, 1, 2) || '-' || substring(m, 11, 2) || substring(m, 9, 2) || '-' || substring(m, 15, 2) || substring(m, 13, 2) || '-' || substring(m, 17, 4) || '-' || substring(m, 21, 12)"
_PICK = lambda values, c: f"[{', '.join(repr(v) for v in values)}][{c} % {len(values)} + 1]"
_FORMS = "forms AS (SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+')) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]+'))"
_REGEX = {p: P.display(P.parse(p, LETTERS, CLASSES), CLASSES) for p in PATTERNS}

SQL = {
    "dictionary_forms": """WITH s AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS stem FROM part), p AS (SELECT stem, stem AS form FROM s WHERE stem <> '' UNION SELECT stem, CASE WHEN stem LIKE '%y' THEN stem[:-2] || 'ies' WHEN regexp_matches(stem, '[sx]$') THEN stem || 'es' ELSE stem || 's' END FROM s WHERE stem <> '')
SELECT form, stem FROM p UNION SELECT 'un' || form, stem FROM p WHERE regexp_matches(stem, '^[a-l]')""",
    "compiled_parses": """WITH w AS (SELECT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS n, p_partkey % 4 AS k FROM part), f AS (SELECT DISTINCT CASE k WHEN 0 THEN 'un' || a WHEN 1 THEN n || 's' WHEN 2 THEN a || n ELSE n END AS word, k, n FROM w)
SELECT DISTINCT word, 'ok' AS status, CASE WHEN k = 1 AND regexp_matches(n, 'x$') THEN 0 ELSE 1 END AS analyses FROM f""",
    "substrate_report": """WITH c AS (SELECT lang, unnest(string_split(coalesce(text, ''), '')) AS character FROM documents), u AS (SELECT character, count(*) AS occurrences FROM c WHERE character <> '' AND character NOT IN (SELECT DISTINCT character FROM c WHERE lang = 'en') GROUP BY 1)
SELECT character, occurrences, CASE WHEN regexp_full_match(character, '[\\p{L}\\p{M}]') THEN 'segment' WHEN NOT regexp_full_match(character, '\\p{N}') AND character NOT IN ('''', '‘', '’', '‐', '‑', '-') AND regexp_full_match(character, '[\\p{Z}\\t\\n\\r]') THEN 'boundary' ELSE 'ambiguous' END AS status FROM u""",
    "signature_catalogue": """WITH p AS (SELECT p_brand AS candidate, p_size % 10 AS form, sum(p_partkey) % 3 > 0 AS predicted FROM part GROUP BY 1, 2), s AS (SELECT candidate, string_agg(form || CASE WHEN predicted THEN '+' ELSE '-' END, ' ' ORDER BY CAST(form AS VARCHAR)) AS signature FROM p GROUP BY candidate)
SELECT signature, count(*) AS candidates, min(candidate) AS first FROM s GROUP BY signature""",
    "grammar_health_codes": " UNION ALL ".join([
        _F("grammar.phoneme.nfd-collision", "p_name || '|' || p_brand", "FROM part GROUP BY p_name, p_brand HAVING count(*) > 1"),
        _F("grammar.boundary.nfd-collision", "s_nationkey", "FROM supplier GROUP BY s_nationkey HAVING count(*) > 1"),
        _F("grammar.phoneme.feature-unresolved", "l_orderkey", "FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)"),
        _F("grammar.natclass.feature-constraint-unresolved", "c_custkey", "FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)"),
        _F("grammar.compound-rule.side-pos-unresolved", "n_nationkey", "FROM nation WHERE n_regionkey = 2"),
        _F("grammar.msa.no-allomorphs", "s_suppkey", "FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)"),
        _F("grammar.msa.inflection-class-unresolved", "c_custkey", "FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
        _F("grammar.circumfix.missing-half", "l_orderkey", "FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_linestatus = 'O') <> bool_or(l_linestatus = 'F')"),
        _F("grammar.environment.unresolved", "o_orderkey", "FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)"),
        _F("grammar.limit.parts-of-speech", "count(DISTINCT p_name)", "FROM part HAVING count(DISTINCT p_name) > 63"),
        _F("grammar.limit.feature-values", "l_suppkey", "FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 63"),
    ]),
    "snapshot_validation": " UNION ALL ".join([
        _V("entry.category", "", "", "s_suppkey AS r, s_nationkey AS t FROM supplier", "n_nationkey", "(SELECT n_nationkey FROM nation WHERE n_nationkey % 5 > 0)"),
        _V("allomorph.environment", "", "", "DISTINCT l_orderkey AS r, l_partkey AS t FROM lineitem", "p_partkey", "(SELECT p_partkey FROM part WHERE p_size < 45)"),
        _V("class.feature", "", "", "c_custkey AS r, c_nationkey AS t FROM customer", "s_nationkey", "supplier"),
        _V("compound.side", "", "", "n_nationkey AS r, n_regionkey AS t FROM nation", "r_regionkey", "region"),
    ]),
    "analysis_projection": f"""WITH m AS (SELECT l_orderkey AS word, l_linenumber AS ix, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), x AS (SELECT word, ix, coalesce({_GUID}, '-') AS form, CASE WHEN p_size > 10 THEN lower(p_brand) ELSE '-' END AS analysis, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '-' END AS type FROM m LEFT JOIN (SELECT *, md5(p_name) AS m FROM part) ON p = p_partkey)
SELECT word, string_agg(form, ' ' ORDER BY ix) AS forms, string_agg(analysis, ' ' ORDER BY ix) AS analyses, string_agg(type, ' ' ORDER BY ix) AS types FROM x GROUP BY word""",
    "interaction_coverage": f"""WITH e AS (SELECT {_PICK(_PARENT, 'l_partkey')} AS parent, {_PICK(_CHILD, 'l_suppkey')} AS child, CASE WHEN l_suppkey % 4 = 1 THEN {_PICK(_DETAIL, 'l_orderkey')} ELSE '' END AS detail, CASE WHEN l_partkey % 4 % 3 > 0 THEN 'Static' ELSE '' END AS strategy FROM lineitem),
n AS (SELECT parent, child, detail, strategy, count(*) AS edges FROM e GROUP BY ALL), k(parent, child, detail, strategy) AS (VALUES {', '.join(str(x) for x in H.SHAPES)})
SELECT parent, child, detail, strategy, CASE WHEN k.ok IS NULL THEN 'unknown' WHEN edges IS NULL THEN 'uncovered' ELSE 'covered' END AS status, coalesce(edges, 0) AS edges FROM n FULL JOIN (SELECT *, true AS ok FROM k) k USING (parent, child, detail, strategy)""",
    "candidate_passes": """WITH w AS (SELECT l_orderkey AS candidate, l_linenumber AS witness, min(CASE WHEN l_returnflag <> 'N' THEN l_partkey % 3 END) AS p FROM lineitem GROUP BY 1, 2)
SELECT candidate, NOT bool_and(p IS NOT NULL) AS kept, bool_and(p IS NOT NULL) AS would_go, coalesce(array_to_string(list_sort(list(DISTINCT p) FILTER (WHERE p IS NOT NULL)), ','), '') AS passes FROM w GROUP BY candidate""",
    "pattern_matches": f"WITH {_FORMS} " + " UNION ALL ".join(f"""SELECT word, '{p}' AS pattern, regexp_full_match(word, '{r}') AS accepted, CAST(len(regexp_extract_all(word, '{r}')) AS BIGINT) AS matches,
CASE WHEN regexp_matches(word, '{r}') THEN CAST(length(regexp_split_to_array(word, '{r}')[1]) AS INTEGER) END AS start, CASE WHEN regexp_matches(word, '{r}') THEN CAST(length(regexp_split_to_array(word, '{r}')[1]) + length(regexp_extract(word, '{r}')) AS INTEGER) END AS "end" FROM forms""" for p, r in _REGEX.items()),
    "pattern_shapes": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{p}', '{r}')" for p, r in _REGEX.items()) + ") AS t(pattern, plain, display)",
    "reduplication_peel": f"WITH {_FORMS} SELECT word, substring(word, 3) AS rest, 'RED' AS affixes FROM forms WHERE length(word) >= 4 AND substring(word, 1, 2) = substring(word, 3, 2) UNION SELECT word, word[1] || substring(word, 4), 'UM' FROM forms WHERE length(word) >= 3 AND substring(word, 2, 2) = 'um'",
    "letter_categories": """WITH c AS (SELECT unnest(string_split(coalesce(text, ''), '')) AS c FROM documents), n AS (SELECT c, count(*) AS n FROM c WHERE c <> '' GROUP BY c)
SELECT CASE WHEN regexp_full_match(c, '\\p{L}') THEN 'letter' WHEN regexp_full_match(c, '\\p{M}') THEN 'mark' WHEN regexp_full_match(c, '\\p{N}') THEN 'number' WHEN c IN ('''', '‘', '’', '‐', '‑', '-') THEN 'dual' WHEN regexp_full_match(c, '[\\p{Z}\\t\\n\\r]') THEN 'space' ELSE 'other' END AS category, count(*) AS characters, CAST(sum(n) AS BIGINT) AS occurrences FROM n GROUP BY 1""",
    "entry_ids": f"SELECT p_partkey, 'pgl_' || substring(replace(replace(to_base64(unhex(m)), '+', '-'), '/', '_'), 1, 22) AS entry, m AS hex, {_GUID} AS guid FROM (SELECT p_partkey, md5(p_name) AS m FROM part)",
    "gate_identities": """SELECT p_partkey, '{"kind":"mpr","name":"' || p_brand || '","values":["' || array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), '","') || '"]}' AS identity FROM part""",
    "canonical_digests": """WITH c AS (SELECT p_partkey, '{"inner":{"a":' || p_partkey || ',"z":"' || p_type || '"},"p_brand":"' || p_brand || '","p_size":' || p_size || '}' AS canonical FROM part) SELECT p_partkey, canonical, sha256('part' || chr(10) || canonical) AS digest FROM c""",
}
