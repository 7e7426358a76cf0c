"""Guessing on whole words of the parts' names."""

from glossweave.plans import catalog


def test_whole_words(spark, tmp_path):
    names = ["small  ring", "crimson sprockets", "unzog widget"]
    spark.createDataFrame(list(enumerate(names, 1)), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.word: r.signature for r in catalog.QUERIES["parse_guessed"](spark, str(tmp_path)).collect()}
    assert set(got) == {"small", "ring", "crimson", "sprockets", "unzog", "widget"}
    assert "*crimson*" in got["crimson"] and "*" not in got["ring"] and "*" not in got["small"]
    assert "*sprocket*" in got["sprockets"] or "*sprockets*" in got["sprockets"]
