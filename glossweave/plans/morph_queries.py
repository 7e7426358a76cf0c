"""The parser, generation and streams bound to the driver's tables, with a small grammar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import morphology as M
from ..operators import text as T
from ..session import folder, stored
from ..streaming import jobs
from . import adapters as A

LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
VOWELS = frozenset("aeiou")


def _s(x: str) -> tuple[str, ...]:
    return tuple(x)


def grammar(longest: int = 0) -> M.Grammar:
    """Nouns and adjectives of the parts' names: plural with e-insertion after s, un-, re- and compounds.

    Roots of three letters around a vowel may be guessed, and those of any letters up to ``longest``.
    """
    roots = tuple(M.Root(w, (_s(w),), c) for w, c in (("ring", "N"), ("widget", "N"), ("bolt", "N"), ("gear", "N"), ("box", "N"), ("red", "A"), ("small", "A"), ("large", "A"), ("blue", "A"), ("green", "A")))
    affixes = (
        M.Affix("PL", suffix=_s("s"), takes=frozenset("N"), excludes=frozenset({"plural"}), adds=frozenset({"plural"})),
        M.Affix("NEG", prefix=_s("un"), takes=frozenset("A"), excludes=frozenset({"negated"}), adds=frozenset({"negated"})),
        M.Affix("NMLZ", suffix=_s("ness"), takes=frozenset("A"), gives="N"),
    )
    insert = M.Rewrite("e-insertion", _s("xs"), _s("xes"))
    return M.Grammar(LETTERS, roots, affixes, (insert,), compounds=(("A", "N", "N"), ("N", "N", "N")), patterns=((LETTERS, VOWELS, LETTERS), *((LETTERS,) * n for n in range(1, longest + 1))), most_affixes=3)


def words(s: SparkSession, d: str) -> DataFrame:
    """Inflected and joined forms of the parts' words."""
    p = A.table(s, d, "part").select(F.split("p_name", " ").alias("w"), (F.col("p_partkey") % 6).alias("k"))
    a, n = F.element_at("w", 1), F.element_at("w", -1)
    return p.select(F.when(F.col("k") == 0, a).when(F.col("k") == 1, n).when(F.col("k") == 2, F.concat(n, F.lit("s"))).when(F.col("k") == 3, F.concat(F.lit("un"), a)).when(F.col("k") == 4, F.concat(a, n)).otherwise(F.concat(F.lit("un"), a, F.lit("ness"))).alias("word"))


def stream(s: SparkSession, d: str) -> DataFrame:
    """The newest event of each user, kept by a stream that takes all there is."""
    base = folder(s, "upsert")
    # the stream reads a folder of files; a table may be a single file
    A.table(s, d, "events").repartition(4).write.parquet(f"{base}/in")
    schema = A.table(s, d, "events").schema
    rows = s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").select("user_id", "event_id", "event_type", "value")
    jobs.upsert_stream(rows, f"{base}/state", f"{base}/checkpoint", ["user_id"], "event_id", every=2).awaitTermination()
    return jobs.latest_version(s, f"{base}/state", ["user_id"], "event_id")


def forms(s: SparkSession, d: str) -> DataFrame:
    """The distinct lower-case words of all documents, and how often each is there."""
    return T.occurrences(A.table(s, d, "documents"), "doc_id").groupBy(F.lower("form").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def corpus_grammar(words: DataFrame, roots: int = 1500) -> M.Grammar:
    """A grammar of ``roots`` of the corpus's own most frequent words: inflection and derivation in slots, two rewrites.

    The number bounds the lexicon, a grammar's own size; every word of the corpus is parsed.
    """
    stems = [r.word for r in words.where("word RLIKE '^[a-z]{3,}$'").orderBy(F.desc("n"), "word").limit(roots).collect()]
    inflected, derived = [("PL", "s"), ("PST", "ed"), ("PROG", "ing")], [("AGT", "er"), ("ADV", "ly"), ("ABST", "ness"), ("ADJ", "al")]
    affixes = [M.Affix(n, suffix=_s(x), slot="inflection") for n, x in inflected] + [M.Affix(n, suffix=_s(x), slot="derivation") for n, x in derived]
    affixes += [M.Affix(n, prefix=_s(x), excludes=frozenset({n}), adds=frozenset({n})) for n, x in (("NEG", "un"), ("AGAIN", "re"))]
    rules = (M.Rewrite("e-insertion", _s("xs"), _s("xes")), M.Rewrite("y-i", _s("ys"), _s("ies")))
    return M.Grammar(LETTERS, tuple(M.Root(w, (_s(w),), "N") for w in stems), tuple(affixes), rules, templates=((("derivation", True), ("inflection", True)),), compounds=(("N", "N", "N"),), most_affixes=3)


def parsed_corpus(s: SparkSession, d: str, timed: bool = False) -> DataFrame:
    words = stored(forms(s, d), "forms")
    return M.parse_words(words, corpus_grammar(words), timed=timed)


def guessed(s: SparkSession, d: str) -> DataFrame:
    """The whole words of the parts' names, with patterns of roots up to the longest."""
    whole = A.table(s, d, "part").select(F.explode(F.split("p_name", " +")).alias("word")).where("word <> ''")
    longest = whole.agg(F.max(F.length("word"))).first()[0] or 0
    return M.parse_words(whole, grammar(longest), guess=True).select("word", "status", "signature")


QUERIES = {
    "parse_words": lambda s, d: M.parse_words(words(s, d), grammar()).select("word", "status", "signature"),
    "parse_corpus": lambda s, d: parsed_corpus(s, d).select("word", "status", "signature"),
    "parse_identities": lambda s, d: M.identities(M.parse_words(words(s, d), grammar())).select("word", F.array_join("morphemes", "+").alias("morphemes"), "category"),
    "parse_guessed": guessed,
    "generate_words": lambda s, d: M.generate_words(A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.element_at(F.split("p_name", " "), -1)).alias("roots"), F.array(F.lit("PL")).alias("affixes")), grammar()),
    "trace_events": lambda s, d: M.trace_events(words(s, d), grammar()).groupBy("type").agg(F.count(F.lit(1)).alias("events")),
    "segment_longest": lambda s, d: M.segment_words(A.table(s, d, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("word")), ["th", "ng", "ll", *LETTERS]).select("word", F.array_join("segments", " ").alias("segments"), "error_at"),
    "proposed_and_confirmed": lambda s, d: M.confirmed(M.proposed(words(s, d), grammar()), grammar()).select("word", F.array_join(F.concat("roots", "affixes"), "+").alias("morphemes"), "confirmed"),
    "phonology_steps": lambda s, d: M.phonology_steps(words(s, d).select(F.concat("word", F.lit("s")).alias("word")), grammar()),
    "stream_upsert": stream,
}

_A, _N = "('red', 'small', 'large', 'blue', 'green')", "('ring', 'widget', 'bolt', 'gear', 'box')"
_WORDS = """WITH p AS (SELECT string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS n, p_partkey % 6 AS k FROM part),
w AS (SELECT DISTINCT k, a, n, CASE k WHEN 0 THEN a WHEN 1 THEN n WHEN 2 THEN n || 's' WHEN 3 THEN 'un' || a WHEN 4 THEN a || n ELSE 'un' || a || 'ness' END AS word FROM p)"""
# what the grammar makes of each way in which the words are put together; box takes es
_PARSED = f"""{_WORDS}, s AS (SELECT DISTINCT word, CASE WHEN k = 0 AND a IN {_A} THEN a WHEN k = 1 AND n IN {_N} THEN n WHEN k = 2 AND n IN {_N} AND n <> 'box' THEN n || '+PL' WHEN k = 3 AND a IN {_A} THEN a || '+NEG'
WHEN k = 4 AND a IN {_A} AND n IN {_N} THEN a || '+' || n WHEN k = 5 AND a IN {_A} THEN a || '+NEG+NMLZ' END AS morphemes, CASE WHEN k IN (0, 3) THEN 'A' ELSE 'N' END AS category FROM w)"""

SQL = {
    "parse_words": f"{_PARSED} SELECT DISTINCT word, 'ok' AS status, coalesce(morphemes || '|' || word, '-') AS signature FROM s",
    "parse_identities": f"{_PARSED} SELECT DISTINCT word, morphemes, category FROM s WHERE morphemes IS NOT NULL",
    "generate_words": f"SELECT p_partkey AS id, CASE WHEN n IN {_N} THEN n || CASE WHEN n = 'box' THEN 'es' ELSE 's' END END AS surface, CASE WHEN n IN {_N} THEN 'ok' ELSE 'NONE' END AS status FROM (SELECT p_partkey, string_split(p_name, ' ')[-1] AS n FROM part)",
    "phonology_steps": f"{_WORDS} SELECT DISTINCT word || 's' AS word, CAST(0 AS INTEGER) AS ix, 'e-insertion' AS rule, replace(word || 's', 'xs', 'xes') AS output, contains(word || 's', 'xs') AS changed FROM w",
    "segment_longest": "SELECT DISTINCT lower(replace(p_name, ' ', '')) AS word, array_to_string(regexp_extract_all(lower(replace(p_name, ' ', '')), 'th|ng|ll|[a-z]'), ' ') AS segments, CAST(NULL AS INTEGER) AS error_at FROM part",
    "stream_upsert": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
