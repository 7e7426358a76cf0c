"""Text analytics: occurrences, evidence of several dictionaries, statistics, language detection."""

from __future__ import annotations

from itertools import combinations, product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S


def occurrences(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(text_id, ix, form) of each word, in order."""
    return texts.select(F.col(id_col).alias("text_id"), F.posexplode(S.words(F.coalesce(text_col, F.lit("")))).alias("ix", "form"))


def spans(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(text_id, ix, form, start, end, utf8_start, utf8_end): offsets in code points and in bytes, from the gaps between words.

    They are summed within a text's own row, so no word is shuffled and texts of equal ids stay apart.
    """
    x = F.coalesce(text_col, F.lit(""))
    parts = texts.select(F.col(id_col).alias("text_id"), S.words(x).alias("w"), F.split(x, S.WORD, -1).alias("g"))
    both = lambda size: F.transform("w", lambda w, i: size(w) + size(F.get(F.col("g"), i)))
    ends = parts.select("text_id", "w", S.running(both(F.length)).alias("e"), S.running(both(F.octet_length)).alias("b"))
    rows = ends.select("text_id", F.posexplode(F.arrays_zip("w", "e", "b")).alias("ix", "o"))
    form, end, end8 = F.col("o.w"), F.col("o.e"), F.col("o.b")
    return rows.select("text_id", "ix", form.alias("form"), (end - F.length(form)).cast("long").alias("start"), end.cast("long").alias("end"), (end8 - F.octet_length(form)).cast("long").alias("utf8_start"), end8.cast("long").alias("utf8_end"))


def wordforms(occ: DataFrame) -> DataFrame:
    return occ.groupBy("form").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("text_id").alias("texts"))


def word_list(texts: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, form): the distinct lower-case words of each language."""
    return texts.select(F.col(lang_col).alias("lang"), F.explode(S.words(F.lower(F.coalesce(text_col, F.lit(""))))).alias("form")).distinct()


def tallied(occ: DataFrame) -> DataFrame:
    """(text_id, form, n): how often each text has each lower-case form; what evidence and statistics are made from."""
    return occ.groupBy("text_id", F.lower("form").alias("form")).agg(F.count(F.lit(1)).alias("n"))


def evidence(forms: DataFrame, lists: DataFrame) -> DataFrame:
    """(form, langs): each distinct lower-case form with the languages that have it, in order. Forms are checked once."""
    forms = forms.select("form").distinct()
    have = forms.join(lists, "form").groupBy("form").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    return forms.join(have, "form", "left").select("form", F.coalesce("langs", F.array().cast("array<string>")).alias("langs"))


def outcome(langs: str = "langs") -> F.Column:
    """valid, or misspelled where every resource was tried without result."""
    return F.when(F.size(langs) > 0, "valid").otherwise("misspelled")


def outcome_of(valid: F.Column, unattempted: F.Column, limited: F.Column, misspelled: F.Column, undecided: F.Column) -> F.Column:
    """The outcome of an occurrence from what its checks say, by precedence; incomplete is not negative."""
    return F.when(valid, "valid").when(unattempted, "unattempted").when(limited, "incomplete").when(misspelled, "misspelled").when(undecided, "incomplete").otherwise("no_analysis")


def statistics(tally: DataFrame, checked: DataFrame) -> DataFrame:
    """(text_id, outcome, occurrences, wordforms) of each text, and with a null text_id of all texts together.

    A form is one row of a text, so a text's forms are counted; over all texts they are counted from distinct ones.
    """
    rows = tally.join(checked.select("form", outcome().alias("outcome")), "form")
    each = rows.groupBy("text_id", "outcome").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("wordforms"))
    forms = rows.groupBy("form", "outcome").agg(F.sum("n").alias("n"))
    every = forms.groupBy("outcome").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("wordforms"))
    return each.unionByName(every.select(F.lit(None).cast(each.schema["text_id"].dataType).alias("text_id"), "*"))


def language_statistics(tally: DataFrame, checked: DataFrame) -> DataFrame:
    """(lang, valid and ambiguous occurrences and wordforms): ambiguous forms are those of more languages than one."""
    small = tally.groupBy("form").agg(F.sum("n").alias("n"))
    rows = small.join(checked, "form").select("form", "n", F.explode("langs").alias("lang"), (F.size("langs") > 1).alias("ambiguous"))
    return rows.groupBy("lang").agg(
        F.sum("n").alias("valid_occurrences"), F.count_distinct("form").alias("valid_wordforms"), F.coalesce(F.sum(F.when(F.col("ambiguous"), F.col("n"))), F.lit(0)).alias("ambiguous_occurrences"), F.count_if(F.col("ambiguous")).alias("ambiguous_wordforms")
    )


def trigram_inventory(lists: DataFrame) -> DataFrame:
    return lists.select("lang", F.explode(F.array_distinct(S.trigrams(F.col("form")))).alias("gram")).distinct()


def language_coverage(forms: DataFrame, inventory: DataFrame) -> DataFrame:
    """(form, lang, coverage): whole percent of a form's trigrams that a language has, for languages that have one at least.

    The forms' trigrams are far more than the stored forms, by which Spark takes their size, so they are never broadcast.
    """
    grams = forms.where(F.length("form") >= 2).select("form", F.posexplode(S.trigrams(F.col("form"))).alias("ix", "gram"))
    n = F.length("form")
    hits = grams.hint("merge").join(inventory, "gram").groupBy("form", "lang").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select("form", "lang", F.floor(F.col("hits") * 100 / n).cast("int").alias("coverage"))


def winner(cover: DataFrame, least: int = 50, margin: int = 10) -> DataFrame:
    """(form, lang, coverage, margin) of the best language, if it is good and far enough from the next."""
    w = Window.partitionBy("form").orderBy(F.desc("coverage"), "lang")
    ranked = cover.select("form", "lang", "coverage", F.row_number().over(w).alias("r"), F.coalesce(F.lead("coverage").over(w), F.lit(0)).alias("next"))
    return ranked.where((F.col("r") == 1) & (F.col("coverage") >= least) & (F.col("coverage") - F.col("next") >= margin)).select("form", "lang", "coverage", (F.col("coverage") - F.col("next")).alias("margin"))


def proposals(tally: DataFrame, checked: DataFrame, won: DataFrame, enough: int = 5) -> DataFrame:
    """(lang, dictionary, shared, ngram, any_evidence, decisive, status): tallies of occurrences for each language.

    A form of one dictionary is decisive; one of several is shared; one of none can be won by trigrams.
    """
    rows = tally.groupBy("form").agg(F.sum("n").alias("n")).join(checked, "form")
    zero = F.lit(0).cast("long")
    listed = rows.select(F.explode("langs").alias("lang"), F.when(F.size("langs") == 1, F.col("n")).otherwise(zero).alias("dictionary"), F.when(F.size("langs") > 1, F.col("n")).otherwise(zero).alias("shared"), zero.alias("ngram"))
    grams = rows.where(F.size("langs") == 0).join(won.select("form", "lang"), "form").select("lang", zero.alias("dictionary"), zero.alias("shared"), F.col("n").alias("ngram"))
    sums = listed.unionByName(grams).groupBy("lang").agg(F.sum("dictionary").alias("dictionary"), F.sum("shared").alias("shared"), F.sum("ngram").alias("ngram"))
    decisive = F.col("dictionary") + F.col("ngram")
    full = sums.select("*", (decisive + F.col("shared")).alias("any_evidence"), decisive.alias("decisive"), F.when(decisive >= enough, "proposed").otherwise("insufficient").alias("status"))
    return full.orderBy(F.desc("any_evidence"), "lang")


def budgeted(occ: DataFrame, most: int) -> DataFrame:
    """Occurrences with ``attempted``: the first ``most`` in the order of texts and words.

    Texts' counts are dealt in ranges of texts, so what is ordered in one place is a row for each range, and no word is.
    """
    sizes = occ.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("text_id").withColumn("bin", F.spark_partition_id())
    bins = sizes.groupBy("bin").agg(F.sum("n").alias("n"))
    before = bins.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("bins_before"))
    own = F.sum("n").over(Window.partitionBy("bin").orderBy("text_id")) - F.col("n")
    start = sizes.withColumn("own", own).join(before, "bin").select("text_id", (F.col("own") + F.col("bins_before")).alias("before"))
    return occ.join(start, "text_id").select("text_id", "ix", "form", (F.col("before") + F.col("ix") < most).alias("attempted"))


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(form, suggestion, distance) of dictionary words within ``most`` edits (up to two), by deletion neighbourhoods.

    Two words within d edits share a string that deleting d letters or fewer from each gives, so a join on those
    strings finds all pairs without comparing all words. The strings are many times the stored words, by which Spark takes
    their size, so neither side is broadcast.
    """

    def shrunk(c: str) -> F.Column:
        x = F.col(c)
        drop = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s))))
        every = F.array(x)
        layer = every
        for _ in range(most):
            layer = F.array_distinct(F.flatten(F.transform(layer, drop)))
            every = F.concat(every, layer)
        return F.array_distinct(every)

    left = words.select(F.col("form"), F.explode(shrunk("form")).alias("key"))
    right = dictionary.select(F.col("form").alias("suggestion"), F.explode(shrunk("form")).alias("key"))
    pairs = left.hint("merge").join(right, "key").select("form", "suggestion").distinct()
    return pairs.select("form", "suggestion", F.levenshtein("form", "suggestion", most).alias("distance")).where((F.col("distance") >= 0) & (F.col("form") != F.col("suggestion")))


DUAL = "'\u2018\u2019-\u2010\u2011"  # characters that join words or end them


def divisions(word: str, most: int = 16, tries: int = 64) -> tuple[list[list[tuple[int, int]]], bool]:
    """Other divisions of a word at its dual characters, each kept with the left part or dropped; fewest changes first.

    Returns at most ``most`` distinct ones and whether there are more, or too many candidates to tell.
    """
    at = [i for i, c in enumerate(word) if c in DUAL]
    seen, out, budget = {((0, len(word)),)}, [], tries * (most + 1)
    for n in range(1, len(at) + 1):
        for picked in combinations(at, n):
            for drops in product((False, True), repeat=n):
                if budget == 0:
                    return out, True
                budget -= 1
                edges, start = [], 0
                for p, drop in zip(picked, drops, strict=True):
                    edges.append((start, p if drop else p + 1))
                    start = p + 1
                parts = tuple(e for e in [*edges, (start, len(word))] if e[0] < e[1])
                if parts and parts not in seen:
                    if len(out) == most:
                        return out, True
                    seen.add(parts)
                    out.append(list(parts))
    return out, False


def alternatives(words: DataFrame, word_col: str = "form", most: int = 16) -> DataFrame:
    """(form, ix, parts, start, utf8_start, utf16_start, capped): divisions of each distinct form with the parts' offsets.

    The search over divisions is per word, so it runs in Arrow batches.
    """
    distinct = words.select(F.col(word_col).alias("form")).where(F.col(word_col).rlike("[" + DUAL.replace("-", r"\-") + "]")).distinct()

    def run(batches):
        for b in batches:
            rows = []
            for w in b.column(0).to_pylist():
                found, capped = divisions(w, most)
                for i, parts in enumerate(found):
                    starts = [a for a, _ in parts]
                    rows.append((w, i, [w[a:z] for a, z in parts], starts, [len(w[:a].encode()) for a in starts], [len(w[:a].encode("utf-16-le")) // 2 for a in starts], capped))
            kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.bool_()]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["form", "ix", "parts", "start", "utf8_start", "utf16_start", "capped"])

    return distinct.mapInArrow(run, "form string, ix int, parts array<string>, start array<int>, utf8_start array<int>, utf16_start array<int>, capped boolean")


def signatures(rows: DataFrame, group: str, part: F.Column) -> DataFrame:
    """(group, signature): a group's parts in order, joined by semicolons, repeats kept; equal parts are counted before
    they move, so nothing but the signature itself is as long as the group."""
    n = rows.select(group, part.alias("part")).groupBy(group, "part").agg(F.count(F.lit(1)).cast("int").alias("n"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: F.array_join(F.array_repeat(x["part"], x["n"]), ";"))
    return n.groupBy(group).agg(F.array_join(each, ";").alias("signature"))


def analysed_first(readings: DataFrame) -> DataFrame:
    """(form, readings): a form's readings, those with an analysis first, otherwise as generated."""
    return readings.groupBy("form").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("analysed")).alias("later"), "ix", "parts"))), lambda r: r["parts"]).alias("readings"))
