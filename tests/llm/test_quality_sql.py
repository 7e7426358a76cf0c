"""op6 against its SQL where the labels suffice for cutoffs in more than one language."""

import random

import duckdb

from glossweave.llm import queries


def test_cutoffs_in_two_languages(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    docs, labels = [], []
    for i in range(2000):
        lang, bad = ["en", "de", "fr"][i % 20 // 9 if i % 20 < 18 else 2], i % 7 == 0
        words = [word() + ("#" if bad and r.random() < 0.6 else "") for _ in range(60)]
        docs.append((i, " ".join(words[:30]) + "\n" + " ".join(words[30:]), lang, "s", 0))
        labels.append((i, int(not bad), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {tuple(x) for x in queries.op6_quality(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = duck.execute(queries.SQL["op6_quality"])
    names = [c[0] for c in want.description]
    order = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got == {tuple(x[names.index(c)] for c in order) for x in want.fetchall()}
    lang = {i: x for i, _, x, *_ in docs}
    gone = {lang[x[0]] for x in got if not x[6] and not x[7]}
    assert gone == {"en", "de"} and all(x[0] % 7 == 0 for x in got if not x[7])
