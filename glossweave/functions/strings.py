"""String expressions of the text layer."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Maximal runs of word-forming characters: letters, marks and numbers."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


PART = 256


def running(x: Column) -> Column:
    """Running sums of an array of int, part by part, so that a long array is not copied for each element."""
    none = F.array().cast("array<int>")

    def one(acc: Column, c: Column) -> Column:
        start = F.struct(acc["sum"].alias("sum"), none.alias("out"))
        add = lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.array_append(a["out"], a["sum"] + v).alias("out"))
        done = F.array(F.aggregate(F.slice(x, c * PART + 1, PART), start, add))
        return F.get(F.transform(done, lambda p: F.struct(p["sum"].alias("sum"), F.concat(acc["out"], p["out"]).alias("out"))), F.lit(0))

    parts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int"))).otherwise(none)
    return F.aggregate(parts, F.struct(F.lit(0).alias("sum"), none.alias("out")), one)["out"]


def trigrams(word: Column) -> Column:
    """Sliding threes of ``^word$`` in lower case."""
    x = F.concat(F.lit("^"), F.lower(word), F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substr(x, i, F.lit(3)))


def coverage(word: Column, inventory: Column) -> Column:
    """Whole percent of the word's trigrams that ``inventory`` has; zero below four characters with the edges."""
    grams = trigrams(word)
    known = F.size(F.filter(grams, lambda g: F.array_contains(inventory, g)))
    return F.when(F.length(word) + 2 < 4, 0).otherwise(F.floor(known * 100 / F.size(grams)).cast("int"))


def suggestion_method(word: Column, suggestion: Column, by_rule: Column, most: int = 2) -> Column:
    """How a suggestion came: by the dictionary's rules, by edit distance up to ``most``, or by n-grams."""
    near = F.levenshtein(word, suggestion, most) >= 0
    return F.when(by_rule, "hunspell_rule").when(near, "edit_distance").otherwise("ngram_fallback")


def leipzig(glosses: Column, root: Column, guessed: Column, surface: Column) -> Column:
    """Glosses joined by hyphens; a missing one is ``[?]``, or the surface in asterisks at a guessed root."""
    return F.array_join(F.transform(glosses, lambda g, i: F.when(g.isNotNull(), g).when(guessed & (i == root), F.concat(F.lit("*"), surface, F.lit("*"))).otherwise("[?]")), "-")


def signature(parts: Column) -> Column:
    """Sorted, joined by semicolons, repeats kept; a hyphen if there are none."""
    return F.when(F.size(parts) > 0, F.array_join(F.sort_array(parts), ";")).otherwise("-")


def guid(x: Column) -> Column:
    """Embedded GUIDs in lower case, the rest as it is."""
    parts = F.split(x, "(?<![0-9A-Fa-f])(?=[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12})")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"), F.concat(F.lower(F.substr(p, F.lit(1), F.lit(36))), F.substr(p, F.lit(37), F.length(p)))).otherwise(p)), "")


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise(100.0 * (after / before - 1))


def feature_key(pos: Column, features: Column) -> Column:
    """``pos|k=v,...`` with the features in order."""
    return F.concat(pos, F.lit("|"), F.array_join(F.array_sort(F.transform(F.map_entries(features), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ","))


def environment_key(tokens: Column) -> Column:
    """A digest of an environment's resolved tokens; alternatives inside a token are put in order first."""
    return F.sha2(F.array_join(F.transform(tokens, lambda t: F.array_join(F.array_sort(F.split(t, r"\|")), "|")), " "), 256)


def lexical_date(x: Column) -> Column:
    """A timestamp in ISO form, or null if the text is none."""
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def environment(x: Column) -> Column:
    """(left, right, ok) of an environment ``/ L _ R``: the tokens of each side, ``#``, ``[class]``, ``(group)`` or text.

    ``ok`` is false without the slash, with another number of underscores than one, or with brackets that don't close.
    """
    sides = F.split(F.regexp_replace(F.trim(x), "^/", ""), "_")
    token = r"#|\[[^\]]*\]|\([^)]*\)|[^#\[\]()\s]+"
    tokens = lambda i: F.regexp_extract_all(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), F.lit(token), F.lit(0))
    rest = F.regexp_replace(x, token, "")
    ok = F.trim(x).startswith("/") & (F.size(sides) == 2) & ~rest.rlike(r"[\[\]()]")
    return F.struct(tokens(0).alias("left"), tokens(1).alias("right"), ok.alias("ok"))


def decomposed(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFD")


def nfd(x: Column) -> Column:
    """Canonical decomposition; Spark has no function for it, so this one runs in Arrow batches."""
    return F.pandas_udf(decomposed, "string")(x)


def is_nfd(x: Column) -> Column:
    return F.pandas_udf(lambda s: s == decomposed(s), "boolean")(x)


# A letter's category by its general category, the first that holds.
CATEGORIES = [("letter", r"^\p{L}$"), ("mark", r"^\p{M}$"), ("number", r"^\p{N}$"), ("dual", "^['‘’‐‑-]$"), ("space", r"^[\p{Z}\t\n\r]$")]


def category(character: Column) -> Column:
    """What a character is in a word: letter, mark, number, one that joins or ends words, space, or other."""
    out = F.when(character.rlike(CATEGORIES[0][1]), CATEGORIES[0][0])
    for name, pattern in CATEGORIES[1:]:
        out = out.when(character.rlike(pattern), name)
    return out.otherwise("other")


# Fixed value: what stands before an entry's own identity.
ENTRY = "pgl_"


def entry_id(hexed: Column) -> Column:
    """An entry's id from 32 hexadecimal digits: 22 letters that are safe in addresses, behind a prefix; null from others."""
    letters = F.replace(F.replace(F.substr(F.base64(F.unhex(hexed)), F.lit(1), F.lit(22)), F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))
    return F.when(hexed.rlike("^[0-9A-Fa-f]{32}$"), F.concat(F.lit(ENTRY), letters))


def entry_hex(entry: Column) -> Column:
    """The hexadecimal digits of an entry's id, null if it is none."""
    letters = F.replace(F.replace(F.substr(entry, F.lit(len(ENTRY) + 1), F.lit(22)), F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return F.when(entry.rlike(f"^{ENTRY}[A-Za-z0-9_-]{{21}}[AQgw]$"), F.lower(F.hex(F.unbase64(F.concat(letters, F.lit("=="))))))


def mixed_guid(hexed: Column) -> Column:
    """32 hexadecimal digits as a GUID whose first three fields have their bytes turned round; null from others."""
    x = F.lower(hexed)
    byte = lambda *places: F.concat(*(F.substr(x, F.lit(2 * p + 1), F.lit(2)) for p in places))
    return F.when(hexed.rlike("^[0-9A-Fa-f]{32}$"), F.concat_ws("-", byte(3, 2, 1, 0), byte(5, 4), byte(7, 6), byte(8, 9), byte(*range(10, 16))))


def gate_feature(kind: Column, name: Column, values: Column) -> Column:
    """A gate's identity as JSON with its parts and values in order, so that equal gates are equal strings."""
    return F.to_json(F.struct(kind.alias("kind"), name.alias("name"), F.array_sort(F.array_distinct(values)).alias("values")))


def _canonical(value) -> str:
    import json

    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(v)}" for k, v in sorted(value.items(), key=lambda e: e[0].encode("utf-16-be"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, float):
        mantissa, _, power = repr(value).partition("e")
        return mantissa if not power else f"{mantissa.removesuffix('.0')}e{'+' * (power[0] != '-')}{power[0] * (power[0] == '-')}{power.lstrip('+-').lstrip('0')}"
    return json.dumps(value, ensure_ascii=False)


def canonical_json(x: Column) -> Column:
    """JSON with its keys in order of UTF-16, without blanks, numbers in their shortest form; null if it is none."""

    def run(s: pd.Series) -> pd.Series:
        import json

        def one(t):
            try:
                return None if t is None else _canonical(json.loads(t))
            except ValueError:
                return None

        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(x)


def projection_digest(tag: str, json: Column) -> Column:
    """The digest of canonical JSON under the name of the projection that it is of."""
    return F.sha2(F.concat(F.lit(f"{tag}\n"), canonical_json(json)), 256)
