"""Patterns against regular expressions, formats there and back, grammars from tables, identities."""

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossweave.functions import strings as S
from glossweave.operators import facts
from glossweave.operators import morphology as M
from glossweave.operators import patterns as P
from glossweave.sources import files, store

SEGMENTS = frozenset("abckl")
CLASSES = {"V": frozenset("a"), "C": frozenset("bckl")}


def test_patterns_are_regular_expressions():
    r = random.Random(1)
    for text in ["a", "[C]*[V]", "<[V]>[C]+b", "(a)(b)c", "(ab)*c", "<a*><b+>(c)", "[V]+[C](a)", "<(a)b>*", "k*", "l(kl)+"]:
        items = P.parse(text, SEGMENTS, CLASSES)
        program, like = P.compiled(items, CLASSES), re.compile(P.display(items, CLASSES))
        assert P.plain(items) == text
        for _ in range(300):
            w = "".join(r.choice("abckl") for _ in range(r.randint(0, 7)))
            assert program.accepts(tuple(w)) == (like.fullmatch(w) is not None), (text, w)
            m, found = like.search(w), program.first_match(tuple(w))
            assert (found[:2] if found else None) == (m.span() if m else None), (text, w)
    found = P.compiled(P.parse("<[V]+>k<[C]>", SEGMENTS, CLASSES), CLASSES).first_match(tuple("baakl"))
    assert found == (1, 5, ((1, 3), (4, 5)))
    assert [m[:2] for m in P.compiled(P.parse("a[C]", SEGMENTS, CLASSES), CLASSES).all_matches(tuple("abakka"))] == [(0, 2), (2, 4)]


@pytest.mark.parametrize("text", ["[X]", "(a", "a)", "*a", "<a", "[V", "a**", "z"])
def test_malformed_patterns(text):
    with pytest.raises(ValueError):
        P.parse(text, SEGMENTS, CLASSES)


def test_guessing_by_patterns():
    root = P.compiled(P.parse("[C][V]([C])", SEGMENTS, CLASSES), CLASSES)
    g = M.Grammar(SEGMENTS, (M.Root("r", (("b", "a"),), "N"),), (M.Affix("K", suffix=("k", "a")),), patterns=(root,))
    e = M.Engine(g)
    assert e.parse("ba", guess=True).signature == "r|ba" and e.parse("lac", guess=True).signature == "*lac*|lac"
    assert e.parse("cabka", guess=True).signature == "*cab*+K|cabka" and e.parse("cc", guess=True).signature == "-"


def test_affix_files(spark, tmp_path):
    (tmp_path / "a.aff").write_text("SET UTF-8\nSFX S Y 2\nSFX S y ies [^aeiou]y # note\nSFX S 0 s [aeiou]y\n\nPFX U N 1\nPFX U 0 un .\nPFX R Y 1\nPFX R 0 re/X .\n")
    rules = files.affix_rules(spark, str(tmp_path / "a.aff"))
    stems = spark.createDataFrame([("fly", "SR"), ("play", "SU"), ("zoo", ""), ("y", "S")], "stem string, flags string")
    got = {(r.form, r.stem) for r in files.spelled(stems, rules).collect()}
    assert got == {("fly", "fly"), ("flies", "fly"), ("refly", "fly"), ("reflies", "fly"), ("play", "play"), ("plays", "play"), ("unplay", "play"), ("zoo", "zoo"), ("y", "y")}
    (tmp_path / "b.aff").write_text("SFX S Y 1\nSFX T 0 s .\n")
    with pytest.raises(Exception, match="malformed"):
        files.affix_rules(spark, str(tmp_path / "b.aff")).collect()


def test_documents_there_and_back(spark, tmp_path):
    entries = spark.createDataFrame([(f"e{i}", f"stem {i}", ["a", "b"], "n", "active", i) for i in range(30)], "entry string, stem string, glosses array<string>, pos string, state string, revision long")
    files.write_lexicon(entries, str(tmp_path / "l"), parts=4)
    assert sorted(map(tuple, files.read_lexicon(spark, str(tmp_path / "l")).collect())) == sorted(map(tuple, entries.collect()))
    g = M.Grammar(SEGMENTS, (M.Root("r", (("b", "a"),), "N"),), (M.Affix("K", suffix=("k",)),))
    parsed = M.parse_words(spark.createDataFrame([("ba",), ("bak",), ("l?",)], "word string"), g)
    files.write_analyses(parsed, str(tmp_path / "p"))
    back = files.read_analyses(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.collect())) == sorted(map(str, parsed.select("word", "status", "analyses").collect()))


def test_packing_a_cache_keeps_its_rows(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    store.write_cache(rows, path, {"grammar": "g"}, "full")
    for change in (lambda: store.packed(spark, path, 300), lambda: store.unpacked(spark, path)):
        change()
        assert sorted(r.id for r in store.open_cache(spark, path, {"grammar": "g"}, "full").collect()) == list(range(1000))
    assert {p.name for p in (tmp_path / "c").iterdir()} == {"facts", "meta"}


def test_mutations_with_revisions(spark):
    rows = [(1, 1, "put", "a", 0), (1, 2, "put", "b", 0), (1, 3, "put", "c", 1), (2, 1, "put", "x", 0), (2, 2, "remove", None, 1), (3, 1, "put", "y", 4), (4, 1, "put", "z", 0), (4, 2, "clear", None, 1)]
    df = spark.createDataFrame(rows, "entry long, at long, action string, value string, expected long")
    got = {r.entry: (r.value, r.revision, r.refused) for r in facts.checked_mutations(df, "entry", "at").collect()}
    assert got == {1: ("c", 2, 1), 2: (None, 2, 0), 3: (None, 0, 1), 4: ("", 2, 0)}


def grammar_tables(spark, **other):
    kinds = {
        "segments": ([(c,) for c in "abckl"], "segment string"),
        "classes": ([("V", "a")], "class string, segment string"),
        "roots": ([("r", "ba", "N", False), ("r", "bak", "N", False), ("q", "kal", "V", False)], "name string, shape string, category string, bound boolean"),
        "affixes": ([("K", None, "k", "N", None, "1"), ("X", "l", None, "Z", None, None)], "name string, prefix string, suffix string, takes string, gives string, slot string"),
        "templates": ([("t", 0, "1", True), ("u", 0, "1", True), ("u", 1, "2", False)], "template string, ix int, slot string, optional boolean"),
        "compounds": ([("N", "V", "N"), ("Z", "N", "N")], "first string, second string, whole string"),
    } | other
    return {k: spark.createDataFrame(*v) for k, v in kinds.items()}


def test_grammars_of_tables(spark):
    g = M.compiled(grammar_tables(spark))
    assert M.Engine(g).parse("bak").signature == "r+K|bak;r|bak" and M.Engine(g).parse("bakal").signature == "r+q|bakal"
    small = M.reachable(g)
    assert [a.name for a in small.affixes] == ["K"] and small.compounds == (("N", "V", "N"),) and len(small.templates) == 1
    for w in ("bak", "bakal", "lba", "kal", "bakk"):
        assert M.Engine(small).parse(w).signature == M.Engine(g).parse(w).signature
    with pytest.raises(ValueError, match="slots"):
        M.compiled(grammar_tables(spark, templates=([("t", 0, "9", True)], "template string, ix int, slot string, optional boolean")))
    with pytest.raises(ValueError, match="unknown segments"):
        M.compiled(grammar_tables(spark, classes=([("V", "z")], "class string, segment string")))
    with pytest.raises(ValueError, match="more than"):
        M.compiled(grammar_tables(spark), most=2)


def test_partial_parses_tell_reasons(spark):
    g = M.Grammar(SEGMENTS, (M.Root("r", (("b", "a"),), "N"),), (M.Affix("K", suffix=("k",), takes=frozenset("V")),))
    got = {r.word: (r.status, r.partials) for r in M.partial_parses(spark.createDataFrame([("ba",), ("bak",), ("c",)], "word string"), g).collect()}
    assert got == {"ba": ("ok", None), "bak": ("ok", '[{"roots":["r"],"affixes":["K"],"reason":"category"}]'), "c": ("ok", "[]")}


def test_identities_of_entries(spark):
    hexed = [hashlib.md5(str(i).encode()).hexdigest() for i in range(50)] + ["xyz", "00" * 15]
    df = spark.createDataFrame([(h,) for h in hexed], "h string").select("h", S.entry_id(F.col("h")).alias("e"), S.mixed_guid(F.col("h")).alias("g")).withColumn("back", S.entry_hex(F.col("e")))
    import uuid

    for r in df.collect():
        if len(r.h) == 32:
            assert r.back == r.h and len(r.e) == 26 and r.g == str(uuid.UUID(bytes_le=bytes.fromhex(r.h)))
        else:
            assert r.e is None and r.g is None and r.back is None


def test_canonical_json_and_nfd(spark):
    rows = [('{"b": 1.0, "a": [true, null, "é\\u0041"], "\\ud83d\\ude00": 2, "\\uff21": 1e-7}', '{"a":[true,null,"éA"],"b":1,"😀":2,"Ａ":1e-7}'), ("{", None), (None, None), ("1e30", "1e+30"), ("0.5", "0.5")]
    df = spark.createDataFrame(rows, "j string, want string")
    assert all(r.got == r.want for r in df.select("want", S.canonical_json(F.col("j")).alias("got")).collect())
    words = ["é", "é", "abc", ""]
    got = {r.w: r.ok for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", S.is_nfd(F.col("w")).alias("ok")).collect()}
    assert got == {w: unicodedata.is_normalized("NFD", w) for w in words}
