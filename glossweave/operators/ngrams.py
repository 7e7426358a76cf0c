"""Word n-gram models with backed-off relative counts, and retrieval metrics of their predictions."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<s>", "</s>"
ALPHA, UNKNOWN = 0.4, 1e-6
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def tokens(sentences: DataFrame, id_col: str, text_col: str = "text", order: int = 3) -> DataFrame:
    """(id, ix, word, c1, ..., c{order-1}): each token and the end, with contexts of each length before it."""
    from ..functions.strings import words

    padded = F.concat(F.array_repeat(F.lit(START), order - 1), words(F.lower(F.coalesce(text_col, F.lit("")))), F.array(F.lit(END)))
    rows = sentences.select(F.col(id_col).alias("id"), padded.alias("w")).select("id", "w", F.explode(F.sequence(F.lit(order), F.size("w"))).alias("at"))
    contexts = [F.array_join(F.slice("w", F.col("at") - k, F.lit(k)), " ").alias(f"c{k}") for k in range(1, order)]
    return rows.select("id", (F.col("at") - order).alias("ix"), F.element_at("w", F.col("at")).alias("word"), *contexts)


def counts(toks: DataFrame, order: int = 3) -> DataFrame:
    """(n, context, word, count) for every order."""
    grams = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("n"), (F.col(f"c{k}") if k else F.lit("")).alias("context")) for k in range(order)]))
    return toks.select("word", grams.alias("g")).groupBy("g.n", "g.context", "word").agg(F.count(F.lit(1)).alias("count"))


def totals(cnt: DataFrame) -> DataFrame:
    return cnt.groupBy("n", "context").agg(F.sum("count").alias("total"))


def relative(cnt: DataFrame) -> DataFrame:
    """(n, context, word, count, p). Single words have one context, whose total is a scalar and not a join key.

    A model: store it before the functions below use it several times.
    """
    words, longer = cnt.where("n = 1"), cnt.where("n > 1")
    whole = words.crossJoin(F.broadcast(words.agg(F.sum("count").alias("total"))))  # one row
    found = longer.join(totals(longer), ["n", "context"]).select(*whole.columns).unionByName(whole)
    return found.select("n", "context", "word", "count", (F.col("count") / F.col("total")).alias("p"))


def scored(toks: DataFrame, rel: DataFrame, order: int = 3) -> DataFrame:
    """(id, ix, word, score, known): the relative count of the longest context that has the word, times ALPHA for each
    word of context given up. Scores are found once for each distinct n-gram."""
    keys = [f"c{k}" for k in range(1, order)]
    rows = toks.select("word", *keys).distinct()
    for k in range(order):
        mine = rel.where(F.col("n") == k + 1).select(F.col("context").alias(f"c{k}"), "word", F.col("p").alias(f"p{k}"))
        rows = rows.join(mine.drop("c0") if k == 0 else mine, ["word"] if k == 0 else [f"c{k}", "word"], "left")
    best = F.coalesce(*[F.col(f"p{k}") * ALPHA ** (order - 1 - k) for k in range(order - 1, -1, -1)], F.lit(UNKNOWN))
    return toks.join(rows.select("word", *keys, best.alias("score"), F.col("p0").isNotNull().alias("known")), ["word", *keys]).select("id", "ix", "word", *keys, "score", "known")


def mass(rel: DataFrame) -> DataFrame:
    """(context, mass): what the scores of all known words sum to in each context of two words, in closed form.

    The words seen in a context sum to one; the others get ALPHA times what they have in the shorter one.
    """
    one, two, three = (rel.where(F.col("n") == k) for k in (1, 2, 3))
    seen1 = two.select("context", "word").join(one.select("word", "p"), "word").groupBy("context").agg(F.sum("p").alias("s"))
    m1 = seen1.select(F.col("context").alias("short"), (1 + ALPHA * (1 - F.col("s"))).alias("m1"))
    short = F.substring_index("context", " ", -1)
    seen2 = three.select("context", "word", short.alias("short")).join(two.select(F.col("context").alias("short"), "word", "p"), ["short", "word"]).groupBy("context", "short").agg(F.sum("p").alias("s"))
    return seen2.join(m1, "short").select("context", (1 + ALPHA * (F.col("m1") - F.col("s"))).alias("mass"))


def perplexity(sc: DataFrame, masses: DataFrame, rel: DataFrame) -> DataFrame:
    """(words, perplexity) over known words, each score as a share of its context's mass; infinite without words."""
    shorter = rel.where("n = 2").join(rel.where("n = 1").select("word", F.col("p").alias("q")), "word").groupBy("context").agg(F.sum("q").alias("s"))
    m1 = shorter.select(F.col("context").alias("c1"), (1 + ALPHA * (1 - F.col("s"))).alias("m1"))
    rows = sc.where("known").join(masses.withColumnRenamed("context", "c2"), "c2", "left").join(m1, "c1", "left")
    whole = F.coalesce(F.col("mass"), ALPHA * F.coalesce(F.col("m1"), F.lit(ALPHA)))
    p = F.greatest(F.col("score") / whole, F.lit(1e-12))
    return rows.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.exp(-F.avg(F.log(p))), F.lit(float("inf"))).alias("perplexity"))


def predicted(cnt: DataFrame, k: int = 5) -> DataFrame:
    """(context, word, rank): the ``k`` most frequent successors of each word."""
    w = Window.partitionBy("context").orderBy(F.desc("count"), "word")
    return cnt.where("n = 2").select("context", "word", F.row_number().over(w).alias("rank"), "count").where(F.col("rank") <= k).drop("count")


def predict_next(contexts: DataFrame, rel: DataFrame, k: int = 5) -> DataFrame:
    """(c2, word, score, rank): the ``k`` best of the whole vocabulary after two words, by backed-off scores.

    A word's score is that of the longest context that has it; words that no context has are known by their own relative
    counts alone. What follows two words follows the second one, as in every model of ``relative``. So of the m words
    after both, at most the m + k best after the second one alone matter, and which words of the whole vocabulary come
    first beside those after the second one depends on that word only: it is found once for each. The work is that of
    the model's n-grams and k rows a context; neither successors nor the vocabulary are crossed with the contexts.
    """
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), "word")
    c = contexts.select("c1", "c2").distinct()
    after = c.select("c1").distinct()
    three = c.join(rel.where("n = 3").select(F.col("context").alias("c2"), "word", F.col("p").alias("score")), "c2").select("c2", "word", "score")
    pairs = after.join(rel.where("n = 2").select(F.col("context").alias("c1"), "word", (F.col("p") * ALPHA).alias("score")), "c1").select("c1", "word", "score")
    places = lambda m: F.explode(F.sequence(F.lit(1), F.coalesce(F.col(m).cast("int"), F.lit(0)) + k)).alias("at")

    m = three.groupBy("c2").agg(F.count(F.lit(1)).alias("m"))
    listed = pairs.withColumn("at", F.row_number().over(best("c1")))
    two = c.join(m, "c2", "left").select("c1", "c2", places("m")).join(listed, ["c1", "at"]).join(three.select("c2", "word"), ["c2", "word"], "left_anti").select("c2", "word", "score")

    words = rel.where("n = 1").select("word", (F.col("p") * ALPHA * ALPHA).alias("score"))
    own = pairs.groupBy("c1").agg(F.count(F.lit(1)).alias("own"))
    most = k + (own.agg(F.max("own")).first()[0] or 0)
    common = words.orderBy(F.desc("score"), "word").limit(most).withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), "word")))
    tried = after.join(own, "c1", "left").select("c1", places("own")).join(common, "at").join(pairs.select("c1", "word"), ["c1", "word"], "left_anti")
    first = tried.withColumn("r", F.row_number().over(best("c1"))).where(F.col("r") <= k)
    one = c.join(first, "c1").select("c2", "word", "score")

    every = three.unionByName(two).unionByName(one).withColumn("rank", F.row_number().over(best("c2"))).where(F.col("rank") <= k)
    return every.select("c2", "word", "score", "rank")


def evaluated(toks: DataFrame, rel: DataFrame, cnt: DataFrame, k: int = 5) -> DataFrame:
    """(tokens, oov_rate, perplexity, recall_at_1, recall_at_k, mrr, saved): a model on held-out sentences, in one row."""
    sc = scored(toks, rel)
    out = sc.agg(F.avg((~F.col("known")).cast("double")).alias("oov_rate"))
    single = [out, perplexity(sc, mass(rel), rel).select("perplexity"), retrieval(toks, predicted(cnt, k), k), keystrokes(toks, cnt).select("saved")]
    row = single[0]
    for one in single[1:]:
        row = row.crossJoin(one)  # a row each
    return row.select("tokens", "oov_rate", "perplexity", "recall_at_1", "recall_at_k", "mrr", "saved")


def retrieval(toks: DataFrame, pred: DataFrame, k: int = 5) -> DataFrame:
    """(tokens, recall_at_1, recall_at_k, mrr) of the truth among the predictions; zero without tokens."""
    rows = toks.groupBy("c1", "word").agg(F.count(F.lit(1)).alias("n")).join(pred.withColumnRenamed("context", "c1"), ["c1", "word"], "left")
    n = F.sum("n")
    part = lambda x: F.coalesce(F.sum(F.when(x, F.col("n")).otherwise(0)) / n, F.lit(0.0))
    return rows.agg(F.coalesce(n, F.lit(0)).alias("tokens"), part(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("recall_at_1"), part(F.coalesce(F.col("rank") <= k, F.lit(False))).alias("recall_at_k"), F.coalesce(F.sum(F.coalesce(F.col("n") / F.col("rank"), F.lit(0.0))) / n, F.lit(0.0)).alias("mrr"))


def keystrokes(toks: DataFrame, cnt: DataFrame, k: int = 3) -> DataFrame:
    """(letters, typed, saved): with a list of the ``k`` most frequent words for what is typed so far.

    A word takes its shortest prefix that lists it and a choice, at most its length; unknown words are typed in full.
    """
    vocab = cnt.where("n = 1").select("word", "count")
    prefixes = vocab.select("word", "count", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("p")).withColumn("prefix", F.substr("word", F.lit(1), F.col("p")))
    ranked = prefixes.withColumn("r", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("count"), "word"))).where(F.col("r") <= k)
    need = ranked.groupBy("word").agg(F.min("p").alias("p"))
    rows = toks.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(need, "word", "left")
    typed = F.least(F.length("word"), F.coalesce(F.col("p") + 1, F.length("word")))
    s = rows.agg(F.sum(F.col("n") * F.length("word")).alias("letters"), F.sum(F.col("n") * typed).alias("typed"))
    return s.select("letters", "typed", F.round(1 - F.col("typed") / F.col("letters"), 9).alias("saved"))


def split(sentences: DataFrame, id_col: str, parts: tuple[int, int, int] = (80, 10, 10)) -> DataFrame:
    """Whole sentences to train, validation and test by a hash of the id; not a shuffle with a seed, so it needs no order."""
    h = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(sum(parts)))
    return sentences.withColumn("part", F.when(h < parts[0], "train").when(h < parts[0] + parts[1], "validation").otherwise("test"))


def corrupted(words: DataFrame, word_col: str = "word") -> DataFrame:
    """One edit for each word, chosen by its hash: a letter deleted, substituted or inserted, or two transposed.

    Words of one letter are not shortened or transposed but get a letter. New letters are from the small alphabet.
    """
    w, h = F.col(word_col), F.crc32(word_col)
    at = (h % F.greatest(F.length(w) - 1, F.lit(1))).cast("int") + 1
    a, x, y, z = F.substr(w, F.lit(1), at - 1), F.substr(w, at, F.lit(1)), F.substr(w, at + 1, F.lit(1)), F.substr(w, at + 2, F.length(w))
    new = F.substr(F.lit(LETTERS), (F.floor(h / 256) % len(LETTERS)).cast("int") + 1, F.lit(1))
    kind = F.when(F.length(w) > 1, F.floor(h / 64) % 4).otherwise(2)
    return words.withColumn("corrupted", F.when(kind == 0, F.concat(a, y, z)).when(kind == 1, F.concat(a, new, y, z)).when(kind == 2, F.concat(a, new, x, y, z)).otherwise(F.concat(a, y, x, z)))


def uniform(*keys, salt: int) -> F.Column:
    """A number in [0, 1) from the hash of the keys: the same on any partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(salt)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def synthetic(spark, sentences: int, vocabulary: int = 1000, classes: int = 4, most: int = 12, affix_rate: float = 0.7, seed: int = 0) -> DataFrame:
    """(sentence_id, position, class, root, affixes, surface): a corpus of invented words.

    Roots follow a Zipf law by inverse of its continuous form, numbers of affixes a Poisson law by inverse of its
    cumulative sums, and the class of a word depends on that of the word before it by a fixed preference for the next
    class. Every row is a function of its place and the seed, so it can be made anywhere and again.
    """
    length = 1 + F.floor(uniform("sentence_id", salt=seed) * most).cast("int")
    rows = spark.range(sentences).withColumnRenamed("id", "sentence_id").select("sentence_id", F.explode(F.sequence(F.lit(0), length - 1)).alias("position"))
    key = ("sentence_id", "position")
    moved = F.aggregate(F.sequence(F.lit(0), F.col("position")), F.lit(0), lambda a, j: (a + F.when(F.pmod(F.xxhash64("sentence_id", j, F.lit(seed + 1)), F.lit(10)) < 6, 1).otherwise(0)) % classes)
    rank = F.floor(F.exp(uniform(*key, salt=seed + 2) * F.log(F.lit(float(vocabulary + 1))))).cast("int")
    u, cumulative, affixes = uniform(*key, salt=seed + 3), 0.0, F.lit(0)
    for k in range(6):
        cumulative += exp(-affix_rate) * affix_rate**k / factorial(k)
        affixes = affixes + F.when(u >= cumulative, 1).otherwise(0)
    rows = rows.select(*key, moved.alias("class"), rank.alias("root"), affixes.alias("affixes"))
    return rows.withColumn("surface", F.concat(F.lit("r"), F.col("root").cast("string"), F.repeat(F.concat(F.lit("-c"), F.col("class").cast("string")), F.col("affixes"))))
