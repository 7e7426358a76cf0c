"""What queries do inside: rows made on the way to the result, and sides that must not be broadcast."""

from pyspark.sql import functions as F

from glossweave.operators import ngrams
from glossweave.operators import text as T


def nodes(plan):
    kind = plan.getClass().getSimpleName()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(x for p in below for x in nodes(p))]


def most_rows(df):
    """The rows of the result, and the most that a step made."""
    rows = df.collect()
    made = [n.metrics().get("numOutputRows") for n in nodes(df._jdf.queryExecution().executedPlan())]
    return rows, max(m.get().value() for m in made if m.isDefined())


def test_predictions_do_not_cross_contexts_with_successors(spark):
    n, k = 300, 3
    train = [(i, f"a{i} x b{i}") for i in range(n)] + [(n, "x b7 x b7")]
    toks = ngrams.tokens(spark.createDataFrame(train, "id long, text string"), "id")
    rel = ngrams.relative(ngrams.counts(toks)).localCheckpoint()
    held = ngrams.tokens(spark.createDataFrame([(i, f"a{i} x") for i in range(n)] + [(n, "new words")], "id long, text string"), "id").localCheckpoint()
    rows, most = most_rows(ngrams.predict_next(held, rel, k))
    assert most < 20 * n

    p = {(r.n, r.context, r.word): r.p for r in rel.collect()}
    of: dict = {}
    for (size, context, word), x in p.items():
        of.setdefault((size, context), {})[word] = x
    want = []
    for c1, c2 in {(r.c1, r.c2) for r in held.collect()}:
        scores = {w: x * ngrams.ALPHA * ngrams.ALPHA for w, x in of[1, ""].items()}
        scores |= {w: x * ngrams.ALPHA for w, x in of.get((2, c1), {}).items()}
        scores |= of.get((3, c2), {})
        want += [(c2, w, s, i + 1) for i, (w, s) in enumerate(sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:k])]
    assert sorted(map(tuple, rows)) == sorted(want)


def test_exploded_forms_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([("house",), ("horse",), ("mouse",)], "form string").write.parquet(str(tmp_path / "forms"))
    forms = spark.read.parquet(str(tmp_path / "forms"))  # Spark takes their size from the file
    inventory = T.trigram_inventory(forms.withColumn("lang", F.lit("en")))
    for df, n in ((T.suggestions(forms, forms), 6), (T.language_coverage(forms, inventory), 3)):
        assert len(df.collect()) == n
        assert not [x for x in nodes(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName().startswith("Broadcast")]
