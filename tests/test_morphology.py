"""The parser on small grammars with known answers, and against brute-force generation."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from glossweave.operators import morphology as M
from glossweave.plans.morph_queries import grammar

S = tuple


@pytest.mark.parametrize(
    ("word", "status", "signature"),
    [("ring", "ok", "ring|ring"), ("rings", "ok", "ring+PL|rings"), ("boxes", "ok", "box+PL|boxes"), ("boxs", "ok", "-"), ("unredness", "ok", "red+NEG+NMLZ|unredness"), ("redring", "ok", "red+ring|redring"), ("ringss", "ok", "-"), ("xyz!", "SKIPPED", "-")],
)
def test_signatures(word, status, signature):
    r = M.Engine(grammar()).parse(word)
    assert (r.status, r.signature) == (status, signature)


def test_every_generated_form_is_parsed_back():
    e = M.Engine(grammar())
    names = [a.name for a in e.g.affixes]
    for root in e.g.roots:
        for n in range(3):
            for affixes in product(names, repeat=n):
                for form in e.generate([root.name], list(affixes)):
                    assert "+".join([root.name, *affixes]) + "|" + form in e.parse(form).signature.split(";")


def test_segmentation_prefers_the_longest_and_names_the_place():
    assert M.segment("thin", frozenset({"t", "h", "th", "i", "n"})) == ("th", "i", "n")
    with pytest.raises(M.SegmentError) as e:
        M.segment("éxx!", frozenset({"é", "x"}))
    assert e.value.position == 4
    assert M.segment("a+b", frozenset("ab"), frozenset("+")) == ("a", "b")


def test_iterative_and_simultaneous_rules_differ():
    where = M.Environment(left=(frozenset("a"),))
    it, sim = M.Rewrite("i", S("b"), S("a"), where), M.Rewrite("s", S("b"), S("a"), where, simultaneous=True)
    assert "".join(it.apply(S("abbb"))) == "aaaa" and "".join(sim.apply(S("abbb"))) == "aabb"
    assert S("abbb") in it.undo(S("aaaa"), M.Work(10_000))


def test_metathesis():
    m = M.Metathesis("m", frozenset("k"), frozenset("s"))
    assert "".join(m.apply(S("aks"))) == "ask" and S("aks") in m.undo(S("ask"), M.Work(100))


@pytest.mark.parametrize(
    ("affix", "stem", "form"),
    [(M.Affix("c", prefix=S("ge"), suffix=S("t")), "lieb", "geliebt"), (M.Affix("i", infix=S("um"), after=1), "sulat", "sumulat"), (M.Affix("r", copies=2), "kata", "kakata"), (M.Affix("t", cuts=1), "abc", "ab")],
)
def test_processes(affix, stem, form):
    assert "".join(affix.apply(S(stem))) == form
    assert S(stem) in affix.undo(S(form), tuple("abcdefghijklmnopqrstuvwxyz"), M.Work(1000))


def test_templates_gates_and_prohibitions():
    g = M.Grammar(frozenset("abcd"), (M.Root("r", (S("ab"),), "V"),), (M.Affix("C", suffix=S("c"), slot="1"), M.Affix("D", suffix=S("d"), slot="2")), templates=((("1", True), ("2", False)),))
    e = M.Engine(g)
    assert e.parse("abd").signature == "r+D|abd" and e.parse("abcd").signature == "r+C+D|abcd"
    assert e.parse("abc").signature == "-" and e.parse("abdc").signature == "-"
    e = M.Engine(M.Grammar(frozenset("abcd"), g.roots, tuple(M.Affix(a.name, suffix=a.suffix) for a in g.affixes), prohibitions=(M.Cooccurrence("D", ("C",), adjacency="next_left"),)))
    assert e.parse("abdc").signature == "r+D+C|abdc" and e.parse("abcd").signature == "-"


def test_disjunctive_allomorphs_and_bound_roots():
    vowel = M.Environment(right=(frozenset("a"),))
    g = M.Grammar(frozenset("abkg"), (M.Root("r", (S("bg"), S("bk")), "N", (vowel, None)), M.Root("q", (S("ka"),), "N", bound=True)), (M.Affix("A", suffix=S("a")),))
    e = M.Engine(g)
    assert e.parse("bga").signature == "r+A|bga" and e.parse("bka").signature == "-" and e.parse("bk").signature == "r|bk"
    assert e.parse("ka").signature == "-" and e.parse("kaa").signature == "q+A|kaa"


def test_budget_guess_and_supplied_roots():
    e = M.Engine(grammar())
    assert e.parse("unrednessrings", most=5).status == "CAP"
    assert e.parse("zog").signature == "-" and e.parse("zog", guess=True).signature == "*zog*|zog"
    own = M.Engine(grammar(), (M.Root("zog", (S("zog"),), "N"),))
    assert own.parse("zogs").signature == "zog+PL|zogs"


def test_cascades():
    rules = [lambda s: [s + "a"], lambda s: [s + "b"] if "a" in s else []]
    go = lambda r, s: r(s)
    assert M.linear(rules, "", go) == ["ab"]
    assert M.permutations(rules, "", go) == ["a", "ab"]
    assert sorted(M.combinations([lambda s: [s + "a"], lambda s: [s + "b"]], "", go)) == ["a", "ab", "b", "ba"]


def test_results_do_not_depend_on_partitions(spark):
    words = spark.createDataFrame([(w,) for w in ["rings", "boxes", "x!", None, "rings", ""]], "word string")
    rows = [sorted(map(tuple, M.parse_words(words.repartition(n), grammar()).select("word", "status", "signature", "work").collect())) for n in (1, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_trace_is_a_tree(spark):
    t = M.trace_events(spark.createDataFrame([("rings",)], "word string"), grammar())
    assert t.where("parent_id IS NULL").count() == 1 and t.where(F.col("parent_id") >= F.col("node_id")).count() == 0
    assert t.where("type = 'successful'").count() == 1


def test_trace_tells_why():
    vowel = M.Environment(right=(frozenset("a"),))
    g = M.Grammar(
        frozenset("abkg"),
        (M.Root("r", (S("bg"), S("bk")), "N", (vowel, None)), M.Root("q", (S("ka"),), "N", bound=True), M.Root("v", (S("gab"),), "V", features=frozenset("f"))),
        (M.Affix("A", suffix=S("a"), takes=frozenset("N")), M.Affix("B", suffix=S("b"), excludes=frozenset("f")), M.Affix("K", suffix=S("k"), requires=frozenset("z")), M.Affix("G", prefix=S("g"), where=vowel, slot="1")),
        templates=((("1", True), ("2", False)),),
        prohibitions=(M.Cooccurrence("A", ("q",)),),
    )
    e = M.Engine(g)
    why = lambda w: {x[4] for x in e.parse(w, trace=True).trace if x[4]}
    assert "allomorph" in why("bka") and "bound_root" in why("ka") and "category" in why("gaba") and "excluded" in why("gabb") and "required" in why("gabk")
    assert "co_occurrence" in why("kaa") and why("?") == {"segment:0"} and "slots" in {r for *_, r in told(e, ("r",), ("G",))}
    assert {x[4] for x in e.parse("gabk", most=2, trace=True).trace} >= {"budget"}


def told(engine, roots, affixes):
    out = []
    engine.derive(tuple(engine.root[r] for r in roots), tuple(engine.affix[a] for a in affixes), M.Work(100), lambda kind, source, reason=None: out.append((kind, source, reason)))
    return out


def test_proposed_then_confirmed_is_what_the_parser_finds(spark):
    g = M.Grammar(frozenset("abcd"), (M.Root("r", (S("ab"),), "V"), M.Root("q", (S("b"),), "V")), (M.Affix("P", prefix=S("a")), M.Affix("Q", suffix=S("c"))))
    words = ["ab", "aab", "abc", "aabc", "ac", "b", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {}
    for r in M.confirmed(M.proposed(df, g), g).where("confirmed").collect():
        got.setdefault(r.word, set()).add("+".join([*r.roots, *r.affixes]))
    e = M.Engine(g)
    for w in words:
        want = {x.split("|")[0] for x in e.parse(w).signature.split(";") if "|" in x}
        assert got.get(w, set()) == want


RICH = M.Grammar(
    frozenset("abkgs"),
    (M.Root("r", (S("bag"), S("bak")), "N", (M.Environment(right=(frozenset("a"),)), None)), M.Root("q", (S("ka"),), "N", bound=True), M.Root("v", (S("gas"),), "V")),
    (M.Affix("PL", suffix=S("s"), excludes=frozenset({"pl"}), adds=frozenset({"pl"})), M.Affix("A", suffix=S("a")), M.Affix("RED", copies=2), M.Affix("IN", infix=S("k"), after=1, takes=frozenset("V")), M.Affix("CIRC", prefix=S("ab"), suffix=S("g"))),
    (M.Rewrite("s-a", S("ss"), S("sas")),),
    compounds=(("N", "V", "N"), ("N", "N", "N")),
    most_affixes=3,
)


def test_candidates_by_joins_are_complete(spark):
    """With rewrites undone, compounds, reduplication, an infix and a circumfix: what is proposed and confirmed is just what the parser finds."""
    e, forms = M.Engine(RICH), {"abk", "kkaa", "sss"}
    for stems in (("r",), ("q",), ("v",), ("r", "v"), ("q", "r")):
        for n in range(4):
            for affixes in product([a.name for a in RICH.affixes], repeat=n):
                forms |= set(e.generate(list(stems), list(affixes)))
    words = sorted(forms)[::3]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {}
    for r in M.confirmed(M.proposed(df, RICH), RICH).where("confirmed").collect():
        got.setdefault(r.word, set()).add("+".join([*r.roots, *r.affixes]))
    want = {w: {x.split("|")[0] for x in e.parse(w, most=10**7).signature.split(";") if "|" in x} for w in words}
    assert len(words) > 100 and {w: got.get(w, set()) for w in words} == want


def test_an_environment_is_tested_where_the_root_stands():
    after = M.Environment(left=(frozenset("c"),))
    g = M.Grammar(frozenset("acn"), (M.Root("r", (S("an"),), "N", (after,)),), (M.Affix("P", prefix=S("anc")),))
    e = M.Engine(g)
    assert e.generate(["r"], ["P"]) == ["ancan"] and e.parse("ancan").signature == "r+P|ancan" and e.parse("an").signature == "-"
    barred = M.Root("r", (S("an"),), "N", ((after, M.Environment(at_start=True)),), barred=((M.Environment(at_end=True),),))
    e = M.Engine(M.Grammar(frozenset("acn"), (barred,), (M.Affix("P", prefix=S("anc")), M.Affix("Q", suffix=S("c")))))
    assert e.parse("an").signature == "-" and e.parse("anc").signature == "r+Q|anc" and e.parse("ancanc").signature == "r+P+Q|ancanc;r+Q+P|ancanc"


def test_look_ahead_loses_nothing():
    class Blind(M.Engine):
        def possible(self, shapes):
            return list(self.g.affixes)

    slots = M.Grammar(frozenset("abcd"), (M.Root("r", (S("ab"),), "V"),), (M.Affix("C", suffix=S("c"), slot="1"), M.Affix("D", suffix=S("d"), slot="2"), M.Affix("E", prefix=S("d"))), templates=((("1", False), ("2", True)), (("2", False),)))
    for g, letters in ((slots, "abcd"), (RICH, "abkgs")):
        own, blind = M.Engine(g), Blind(g)
        for n in range(1, 6):
            for w in product(letters, repeat=n):
                a, b = own.parse("".join(w), most=10**7), blind.parse("".join(w), most=10**7)
                assert a.signature == b.signature and a.work <= b.work


def test_a_request_out_of_steps_has_a_row(spark):
    rows = spark.createDataFrame([(1, ["ring"], ["PL"]), (2, ["nothing"], [])], "id long, roots array<string>, affixes array<string>")
    assert {(r.id, r.surface, r.status) for r in M.generate_words(rows, grammar()).collect()} == {(1, "rings", "ok"), (2, None, "NONE")}
    assert {r.status for r in M.generate_words(rows.limit(1), grammar(), most=0).collect()} == {"CAP"}


def test_phonology_steps(spark):
    rows = M.phonology_steps(spark.createDataFrame([("boxs",), ("ring",), ("?",)], "word string"), grammar()).collect()
    assert {(r.word, r.output, r.changed) for r in rows} == {("boxs", "boxes", True), ("ring", "ring", False), ("?", None, None)}


def test_realized_features_unify_and_serve():
    sg, pl, one, two = ("num", 1), ("num", 2), ("pers", 1), ("pers", 2)
    g = M.Grammar(frozenset("abcd"), (M.Root("r", (S("ab"),), "N"), M.Root("p", (S("ad"),), "N", structure=(pl,))), (M.Affix("S", suffix=S("c"), realizes=(sg,)), M.Affix("P", suffix=S("d"), realizes=(pl,)), M.Affix("1", prefix=S("c"), realizes=(one, ("num", 3)))))
    e = M.Engine(g)
    assert e.parse("abc").signature == "r+S|abc" and e.parse("abcd").signature == "-" and e.parse("adc").signature == "-" and e.parse("add").signature == "p+P|add"
    assert e.parse("cabd").signature == "r+1+P|cabd;r+P+1|cabd"
    assert e.generate(["r"], ["S"], target=dict([sg, one])) == ["abc"] and e.generate(["r"], ["P"], target=dict([sg])) == []
    assert e.generate(["r"], ["S", "1"], target=dict([sg, two])) == [] and e.generate(["r"], ["S", "1"], target=dict([sg, one])) == ["cabc"]
