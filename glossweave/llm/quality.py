"""Quality rules with risk-controlled thresholds, in DataFrame functions.

``metrics`` measures whole texts; words are stretches between ASCII white space. ``base_failed`` are fixed rules. Beyond
them each rule rejects texts whose feature exceeds a cutoff, and the cutoffs are chosen by risk control:

* The holdout are labelled good texts that the fixed rules keep. Per stratum and rule, the candidates are ``steps``
  equal cutoffs of the feature's range.
* A cutoff is admitted if the exact binomial tail says that a rule that rejects a share of ``risk`` of all good texts
  would have rejected as few of the holdout as it did with a probability of at most ``delta / m``: the Clopper-Pearson
  upper bound of its false-rejection rate is below ``risk``. m counts all rules and strata (Bonferroni), and ``risk`` is
  the allowed share of a stratum divided by the number of rules.
* The cutoffs of a rule are tested in a fixed sequence, from the loosest to the strictest, until one fails; that order is
  set before the labels are seen, so it needs no correction for the number of cutoffs. A stricter cutoff rejects what a
  looser one does and more, so the tail only grows along the sequence, and the cutoffs before the first failure are
  just those that pass.
* The smallest admitted cutoff of each rule is used. With probability 1 - ``delta``, in no stratum more than the allowed
  share of good texts is lost. A stratum with too few labels admits nothing and loses nothing.

Only counts by (stratum, rule, step) are gathered, and the cutoffs are a row per stratum.

Nulls: a null text has no words; a null stratum is one of its own; a null label or id is not in the holdout; of several
labels for an id the lowest counts. Repeated rows count each. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SPACE = r"[\x20\x09-\x0D]"


def _packed(words: Column) -> Column:
    """The hash of each window of three words, packed with its place into a number, ascending."""
    n = F.size(words)
    at = F.when(n >= 4, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(at, lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), 31).bitwiseOR(i.cast("long"))))


def _suspects(packed: Column, words: Column) -> Column:
    """The windows that share their hash with another, with their places, ascending."""
    same = lambda a, b: F.coalesce(F.shiftright(a, 31) == F.shiftright(b, 31), F.lit(False))
    at = F.transform(F.filter(packed, lambda x, i: same(x, F.get(packed, i - 1)) | same(x, F.get(packed, i + 1))), lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    return F.array_sort(F.transform(at, lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """The places of all words in windows that the text has twice or more, some more than once."""
    alike = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = F.filter(windows, lambda x, i: alike(x, F.get(windows, i - 1)) | alike(x, F.get(windows, i + 1)))
    return F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))


def metrics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_shouted, n_lines, n_dup_lines, n_repeat_words of each text.

    An array that a lambda looks back into is a column of its own, so that it is made once and not for each element.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, SPACE + "+"), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    sizes = {
        "n_words": F.size("_w"),
        "word_chars": F.length("_t") - F.regexp_count("_t", F.lit(SPACE)),
        "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")),
        "n_shouted": F.regexp_count("_t", F.lit(r"\p{Lu}")),
    }
    names = [*keep, *sizes]
    step = step.select(*keep, *(x.cast("long").alias(k) for k, x in sizes.items()), lines.alias("_l"), "_w", _packed(F.col("_w")).alias("_p"))
    step = step.select(*names, F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _suspects(F.col("_p"), F.col("_w")).alias("_s"))
    return step.select(*names, "n_lines", "n_dup_lines", F.size(F.array_distinct(_repeated(F.col("_s")))).cast("long").alias("n_repeat_words"))


def base_failed(fewest: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < fewest) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def features() -> dict[str, Column]:
    """The rules' features, each from zero to one; more is worse."""
    share = lambda a, b: F.coalesce(F.least(F.try_divide(a.cast("double"), b), F.lit(1.0)), F.lit(0.0))
    return {
        "symbols": share(F.col("n_symbols"), F.col("n_words")),
        "dup_lines": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": share(F.col("n_repeat_words"), F.col("n_words")),
        "shouting": share(F.col("n_shouted"), F.col("word_chars")),
    }


def log_choose(n: Column, k: Column) -> Column:
    """log C(n, k) by Stirling's series, shifted so that its error is below 1e-12."""

    def log_gamma(x: Column) -> Column:  # of x + 1, x >= 0
        z = x + 8
        shift = F.log((x + 1) * (x + 2) * (x + 3) * (x + 4)) + F.log((x + 5) * (x + 6) * (x + 7))
        return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - shift

    return log_gamma(n) - log_gamma(k) - log_gamma(n - k)


def binomial_tail(k: Column, n: Column, p: float, terms: int = 2000) -> Column:
    """P(X <= k) of X binomial(n, p), for k < n p: the largest terms summed, the rest bounded by a geometric series."""
    k, n = k.cast("double"), n.cast("double")
    first = log_choose(n, k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(acc: Column, j: Column) -> Column:
        i = k - j
        term = acc["term"] * (i + 1) * (1 - p) / ((n - i) * p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    last = F.least(k, F.lit(float(terms)))
    done = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>")), zero, add)
    i = k - last
    ratio = i * (1 - p) / ((n - i + 1) * p)  # of the next term to the last; ratios fall from there
    rest = F.when(i > 0, done["term"] * ratio / (1 - ratio)).otherwise(0.0)
    return F.exp(first) * (done["sum"] + rest)


def cutoffs(holdout: DataFrame, stratum: str, allowed: float, delta: float, steps: int) -> DataFrame:
    """(stratum, cutoffs map of rule to cutoff) from rows of good texts with the columns of ``metrics``."""
    rules = features()
    risk = allowed / len(rules)
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.least(F.ceil(x * steps), F.lit(steps)).cast("int").alias("step")) for r, x in rules.items()]))
    counts = holdout.select(stratum, step.alias("s")).groupBy(stratum, "s.rule", "s.step").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(stratum, "rule").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "n"))).alias("by"))  # steps + 1 entries at most
    m = totals.select(stratum).distinct().count()
    grid = totals.select(stratum, "rule", "n", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("cut"), "by")
    over = F.aggregate(F.sequence(F.col("cut") + 1, F.lit(steps)), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("by", i), F.lit(0)))
    tested = grid.select(stratum, "rule", "n", "cut", over.alias("k")).where(F.col("k") < F.col("n") * risk)
    admitted = tested.where(binomial_tail(F.col("k"), F.col("n"), risk) <= delta / max(1, m * len(rules)))
    best = admitted.groupBy(stratum, "rule").agg((F.min("cut") / F.lit(float(steps))).alias("cutoff"))
    return best.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judged(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang", label_col: str = "quality", allowed: float = 0.04, delta: float = 0.05, steps: int = 50, most_strata: int = 1000) -> DataFrame:
    """``measured`` (stored rows of ``metrics``) with base_failed and kept."""
    failed = base_failed()
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_good")).where("_good > 0")
    holdout = measured.where(~failed).join(good, measured[id_col] == good["_id"])
    chosen = shared.written(cutoffs(holdout.select(*measured.columns), stratum, allowed, delta, steps), "cutoffs")
    table = chosen.select(F.col(stratum).alias("_s"), F.col("cutoffs").alias("_c"))
    table = F.broadcast(table) if table.limit(most_strata + 1).count() <= most_strata else table
    rejected = [F.coalesce(x > F.try_element_at("_c", F.lit(r)), F.lit(False)) for r, x in features().items()]
    any_rejected = rejected[0]
    for x in rejected[1:]:
        any_rejected = any_rejected | x
    joined = measured.join(table, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    return joined.select(*measured.columns, failed.alias("base_failed"), (~failed & ~any_rejected).alias("kept"))
