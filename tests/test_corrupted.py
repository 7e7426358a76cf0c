"""The vocabulary that is corrupted comes from all conversations."""

from glossweave.plans import catalog


def test_all_conversations(spark, tmp_path):
    rows = [(i, 0, "user", f"common only{i}") for i in range(1, 11)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [r.word for r in catalog.QUERIES["corrupted_words"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and {f"only{i}" for i in range(1, 11)} | {"common"} <= set(got)
