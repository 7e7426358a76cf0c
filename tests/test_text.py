"""Text operators against plain Python, and the guards that refuse."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossweave.functions import gloss as G
from glossweave.functions import strings as S
from glossweave.operators import assess, facts, ngrams, stats
from glossweave.operators import text as T
from glossweave.sources import files


def test_spans_in_characters_and_bytes(spark):
    rows = [(0, "Été, a𐀀b  c!"), (1, ""), (2, None), (3, " x")]
    got = {(r.text_id, r.ix): r for r in T.spans(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    for i, x in rows:
        for k, m in enumerate(re.finditer(r"\w+", x or "")):
            r = got.pop((i, k))
            assert (r.form, r.start, r.end) == (m[0], *m.span())
            assert (r.utf8_start, r.utf8_end) == (len(x[: m.start()].encode()), len(x[: m.end()].encode()))
    assert got == {}


def test_divisions_fewest_changes_first():
    found, capped = T.divisions("a-b'c")
    assert [["a-b'c"[i:j] for i, j in d] for d in found] == [["a-", "b'c"], ["a", "b'c"], ["a-b'", "c"], ["a-b", "c"], ["a-", "b'", "c"], ["a-", "b", "c"], ["a", "b'", "c"], ["a", "b", "c"]]
    assert not capped and T.divisions("-" * 30)[1] and len(T.divisions("a-b-c-d-e")[0]) == 16


def test_alternatives_offsets(spark):
    r = T.alternatives(spark.createDataFrame([("é𐀀-b",), ("plain",)], "form string")).where("ix = 1").first()
    assert (r.parts, r.start, r.utf8_start, r.utf16_start) == (["é𐀀", "b"], [0, 3], [0, 7], [0, 4])


def test_every_template_is_what_the_expression_gives(spark):
    cells = G.templates()
    assert len(cells) == 108 and cells["Loc", "P1Sg", "Pl"] == "in my {n:pl}" and cells["None", "None", "Sg"] == "a {n:sg}"
    rows = [(*k, t.replace("{n:sg}", "city gate").replace("{n:pl}", "city gates")) for k, t in cells.items()]
    df = spark.createDataFrame(rows, "c string, p string, n string, want string")
    got = df.select("want", G.realized(F.lit("city.gate"), F.col("c"), F.col("p"), F.col("n"), F.lit(False)).alias("got"))
    assert got.where("want <> got").count() == 0


@pytest.mark.parametrize(("word", "plural"), [("fly", "flies"), ("day", "days"), ("box", "boxes"), ("church", "churches"), ("child", "children"), ("sheep", "sheep"), ("naïve", None)])
def test_plurals(spark, word, plural):
    assert spark.range(1).select(G.plural(F.lit(word))).first()[0] == plural


def test_nfd_equals_unicodedata(spark):
    rows = ["é", "Å", "가", "plain", "ﬁ"]
    got = spark.createDataFrame([(x,) for x in rows], "x string").select("x", S.nfd(F.col("x")).alias("y")).collect()
    assert all(r.y == unicodedata.normalize("NFD", r.x) for r in got)


def test_suggestions_find_all_pairs_within_two_edits(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(80)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words], "form string")
    got = {(x.form, x.suggestion): x.distance for x in T.suggestions(df, df).collect()}
    assert got == {(a, b): d for a in words for b in words if a != b and (d := distance(a, b)) <= 2}


def test_budget_follows_the_order_of_texts(spark):
    rows = [(t, i, "w") for t in (5, 2000, 7, 1) for i in range(3)]
    got = T.budgeted(spark.createDataFrame(rows, "text_id long, ix int, form string"), 7).where("attempted").select("text_id", "ix").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (1, 2), (5, 0), (5, 1), (5, 2), (7, 0)]


def test_corrupted_words_differ_by_one_edit(spark):
    rows = [(w,) for w in ("a", "ab", "house", "éclair")]
    for r in ngrams.corrupted(spark.createDataFrame(rows, "word string")).select("word", "corrupted", F.levenshtein("word", "corrupted").alias("d")).collect():
        assert r.d <= 2 and abs(len(r.word) - len(r.corrupted)) <= 1


def test_splits_keep_texts_whole_and_do_not_overlap(spark):
    parts = ngrams.split(spark.range(5000).withColumnRenamed("id", "sid"), "sid")
    n = {r.part: r["count"] for r in parts.groupBy("part").count().collect()}
    assert 3800 < n["train"] < 4200 and sum(n.values()) == 5000
    assess.require_disjoint(parts.where("part = 'train'"), parts.where("part = 'test'"), "sid")
    with pytest.raises(ValueError):
        assess.require_disjoint(parts, parts, "sid")


def test_refusals(spark):
    with pytest.raises(ValueError):
        assess.require_unambiguous(spark.createDataFrame([(1, 9), (2, 9)], "new_id long, old_id long"))
    with pytest.raises(Exception, match="zero times"):
        assess.analysis_sets(spark.createDataFrame([(1, "x", 0, False)], "case_id long, identity string, count long, guessed boolean")).collect()
    fact = spark.createDataFrame([(1, 3)], "word_id long, allomorph_id int")
    word = spark.createDataFrame([(1, 2)], "word_id long, run_id int")
    runs = spark.createDataFrame([(2, 7)], "run_id int, counter_semantics int")
    with pytest.raises(ValueError):
        stats.require_provenance(fact, word, runs)
    stats.require_provenance(fact, word, runs.withColumn("counter_semantics", F.lit(stats.SEMANTICS)))


def test_supersession_moves_the_baseline(spark):
    rows = lambda *x: spark.createDataFrame(x, "case_id long, identity string")
    moved = assess.case_delta(rows((1, "a")), rows((2, "a")), spark.createDataFrame([(2, 1)], "new_id long, old_id long")).collect()
    assert [(r.case_id, r.category) for r in moved] == [(2, "unchanged")]


def test_empty_sums(spark):
    word = spark.createDataFrame([], "form string, elapsed_ns long, capped boolean, timed_out boolean, run_id int")
    assert stats.total_elapsed(word).first()[0] == 0
    toks = spark.createDataFrame([], "id long, ix int, word string, c1 string, c2 string")
    r = ngrams.retrieval(toks, spark.createDataFrame([], "context string, word string, rank int")).first()
    assert (r.tokens, r.mrr) == (0, 0.0)


def test_closure_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "node long, parent long")
    got = {(r.node, r.ancestor): r.depth for r in facts.closure(chain).collect()}
    assert got == {(a, b): a - b for a in range(40) for b in range(a)}


def test_profile_is_word_forming():
    assert files.profile("<l><exemplarCharacters type='auxiliary'>[q]</exemplarCharacters></l>") == set()


def test_synthetic_corpus_does_not_depend_on_partitions(spark):
    a = ngrams.synthetic(spark, 300, seed=3)
    b = ngrams.synthetic(spark, 300, seed=3).repartition(5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    top = a.groupBy("root").count().orderBy(F.desc("count")).first()
    assert top.root == 1 and {r["class"] for r in a.select("class").distinct().collect()} == {0, 1, 2, 3}


def test_suggestions_find_all_pairs(spark):
    from itertools import product
    from random import Random

    r = Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(120)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, left[j] + 1, left[j - 1] + (x != y))
        return row[-1]

    for most in (1, 2):
        df = spark.createDataFrame([(w,) for w in words], "form string")
        got = {(x.form, x.suggestion, x.distance) for x in T.suggestions(df, df, most).collect()}
        assert got == {(a, b, d) for a, b in product(words, words) if a != b and (d := distance(a, b)) <= most}


def test_a_circle_of_parents_is_an_error(spark):
    from glossweave.operators import facts

    with pytest.raises(ValueError, match="its own ancestor"):
        facts.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long"))
