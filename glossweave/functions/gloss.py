"""Glosses to features to English phrases, as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prepositions of cases, possessors, irregular plurals, and the pieces of glosses that name a feature.
CASES = {"None": "", "Loc": "in", "Abl": "from", "All": "to"}
POSSESSORS = {"None": "", "P1Sg": "my", "P1Pl": "our", "P2SgM": "your", "P2SgF": "your", "P2Pl": "your", "P3SgM": "his", "P3SgF": "her", "P3Pl": "their"}
NUMBERS = ("Unspec", "Sg", "Pl")
IRREGULAR = {"man": "men", "woman": "women", "child": "children", "person": "people", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "ox": "oxen", "sheep": "sheep", "fish": "fish", "deer": "deer"}
PLURAL, SINGULAR, POSSESSIVE = ["pl", "plur", "plural"], ["sg", "sing", "singular"], ["poss", "gen"]
PERSONS = {"1sg": "P1Sg", "1pl": "P1Pl", "2sg": "P2SgM", "2pl": "P2Pl", "3sg": "P3SgM", "3pl": "P3Pl"}
CASE_NAMES = {"Loc": ["loc", "locative"], "Abl": ["abl", "ablative"], "All": ["all", "allative"]}


def _list(x) -> Column:
    return F.array(*map(F.lit, x))


def inferred(gloss: Column) -> Column:
    """The feature that an affix gloss names, as ``num=Pl``, ``poss=P1Sg`` or ``case=Loc``; number goes first, then
    possessor, then case; null if it names none."""
    parts = F.split(F.lower(gloss), r"[.\-_:]+")
    has = lambda names: F.arrays_overlap(parts, _list(names))
    person = F.lit(None).cast("string")
    for token, value in reversed(PERSONS.items()):
        person = F.when(F.array_contains(parts, token), f"poss={value}").otherwise(person)
    case = F.lit(None).cast("string")
    for value, names in reversed(CASE_NAMES.items()):
        case = F.when(has(names), f"case={value}").otherwise(case)
    return F.when(has(PLURAL), "num=Pl").when(has(SINGULAR), "num=Sg").otherwise(F.coalesce(F.when(has(POSSESSIVE), person), case))


def plural(word: Column) -> Column:
    """The English plural of a plain word, or null: irregular ones first, then -es, -ies or -s by the ending."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    regular = F.when(word.rlike("(?:s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("[^aeiouAEIOU]y$"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))
    return F.coalesce(irregular[word], F.when(word.rlike("^[A-Za-z]+$"), regular))


def templates() -> dict[tuple[str, str, str], str]:
    """A template for each case, possessor and number: preposition, possessor or article, noun."""
    out = {}
    for (case, prep), (poss, word), num in product(CASES.items(), POSSESSORS.items(), NUMBERS):
        article = "a" if not word and num == "Sg" else word
        out[case, poss, num] = " ".join(x for x in (prep, article, "{n:pl}" if num == "Pl" else "{n:sg}") if x)
    return out


def realized(concept: Column, case: Column, poss: Column, num: Column, guessed: Column) -> Column:
    """The phrase; dots in a citation form are blanks, and only its last word is inflected. A guessed concept gets
    asterisks and no inflection; a word without a plain plural stays as it is."""
    prep = F.create_map(*[F.lit(x) for kv in CASES.items() for x in kv])[case]
    owner = F.create_map(*[F.lit(x) for kv in POSSESSORS.items() for x in kv])[poss]
    article = F.when((owner == "") & (num == "Sg"), "a").otherwise(owner)
    words = F.split(F.trim(F.regexp_replace(concept, r"[.\s]+", " ")), " ")
    last = F.element_at(words, -1)
    noun = F.array_join(F.concat(F.slice(words, 1, F.size(words) - 1), F.array(F.when(num == "Pl", F.coalesce(plural(last), last)).otherwise(last))), " ")
    noun = F.when(guessed, F.concat(F.lit("*"), concept, F.lit("*"))).otherwise(noun)
    return F.array_join(F.filter(F.array(prep, article, noun), lambda x: x != ""), " ")


def gloss_signature(glosses: Column, morphemes: Column, surface: Column) -> Column:
    """One analysis's entry: glosses, or the morpheme's name where one is missing, and the surface, as JSON strings."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = F.transform(glosses, lambda g, i: F.when(g.isNotNull(), F.concat(F.lit("g:"), quoted(g))).otherwise(F.concat(F.lit("m:"), quoted(F.coalesce(F.get(morphemes, i), F.lit(""))))))
    return F.concat(F.array_join(parts, "+"), F.lit("|s:"), quoted(surface))
