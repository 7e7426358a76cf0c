"""The order of op1's model, and counts beyond a byte."""

import numpy as np

from glossweave.llm import lm, queries

from .test_operators import brute_lm


def test_two_words_back_count(spark, tmp_path):
    # the word after "x" is fixed only by the word before it, which a bigram model can't see
    rows = ["a x b", "c x d"] * 300 + ["a x d", "c x b"]
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.op1_lm(spark, str(tmp_path)).collect()}
    assert got[0] > got[600] + 1 and got[1] > got[601] + 1


def test_wide_counts(spark):
    rows = ["a x b", "c x d"] * 300 + ["a x d", "q"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model = lm.train(df, order=3)
    assert sum(map(sum, (t.wide for t in model.tables))) > 0
    want, _ = brute_lm(rows, 3)
    for r in lm.score(df, model).collect():
        assert np.isclose(r.score, want(rows[r.doc_id]), atol=1e-9)
