"""Round trips and tolerated oddities of the formats; stored artifacts; streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from glossweave.sources import files, project_xml, store
from glossweave.streaming import jobs

XML = """<?xml version="1.0"?><languageproject version="1">
<rt class="LexEntry" guid="AAAAAAAA-0000-0000-0000-000000000001">
<Senses><objsur guid="AAAAAAAA-0000-0000-0000-000000000002" t="o" /><objsur guid="aaaaaaaa-0000-0000-0000-000000000009" t="r" /></Senses>
<Form><AUni ws="en">a &amp; b</AUni><AUni ws="fr">c</AUni></Form>
</rt>
<rt class="LexSense" guid="aaaaaaaa-0000-0000-0000-000000000002" ownerguid="aaaaaaaa-0000-0000-0000-000000000001"><Note><Uni>hi</Uni></Note></rt>
</languageproject>"""


def test_project_xml(spark, tmp_path):
    (tmp_path / "p.xml").write_text(XML)
    rows = project_xml.records(spark, str(tmp_path / "p.xml"))
    assert {(r["class"], r.owner_guid is None) for r in rows.collect()} == {("LexEntry", True), ("LexSense", False)}
    e = project_xml.edges(rows).orderBy("ordinal").collect()
    assert [(r.field, r.ordinal, r.dst_guid[-1], r.t) for r in e] == [("Senses", 0, "2", "o"), ("Senses", 1, "9", "r")]
    assert [r.dst_guid[-1] for r in project_xml.dangling(rows).collect()] == ["9"]
    assert {(r.field, r.ws, r.value) for r in project_xml.texts(rows).collect()} == {("Form", "en", "a & b"), ("Form", "fr", "c"), ("Note", None, "hi")}
    assert {r["class"]: r.occurrences for r in project_xml.census(rows).collect()} == {"LexEntry": 1, "LexSense": 1}
    assert project_xml.snapshot(rows).count() == 2 and project_xml.by_class(rows, "LexSense").count() == 1


def test_the_header_of_a_project(spark, tmp_path):
    import hashlib

    (tmp_path / "p.xml").write_text(XML)
    (r,) = project_xml.header(spark, str(tmp_path / "p.xml")).collect()
    assert r.version == "1" and r.header_sha256 == hashlib.sha256(XML[: XML.index("<rt")].encode()).hexdigest()


def test_backup(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("x/p.xml", XML)
    project_xml.backup(spark, str(tmp_path / "b.zip"), str(tmp_path / "out"))
    assert project_xml.records(spark, str(tmp_path / "out")).count() == 2


def test_batch_lines(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("0\tapu\tSTARTED\n0\tapu\t5\tCAP\t-\n0\tapu\t7\tok\tx|apu\t99\n1\tbeta\tSTARTED\n2\tc\t1\tSKIPPED\t-\n")
    rows = {r.word: (r.idx, r.elapsed_ms, r.status, r.signature) for r in files.read_batch(spark, str(tmp_path / "b.tsv")).collect()}
    assert rows == {"apu": (0, 7, "ok", "x|apu"), "c": (2, 1, "SKIPPED", "-")}
    files.write_batch(spark.createDataFrame([(0, "w", 3, "ok", "s", 8)], "idx int, word string, elapsed_ms int, status string, signature string, cost long"), str(tmp_path / "o"))
    assert files.read_batch(spark, str(tmp_path / "o"), cost=True).first().cost == 8


def test_token_lines(spark, tmp_path):
    rows = spark.createDataFrame([("b", "d", "s", 1), ("a", "d", "s", 0)], "surface string, doc_id string, sentence_id string, position int")
    files.write_tokens(rows, str(tmp_path / "t"))
    assert [r.surfaces for r in files.sentences(files.read_tokens(spark, str(tmp_path / "t"))).collect()] == [["a", "b"]]
    with pytest.raises(Exception, match="unknown token format"):
        files.read_tokens(spark, str(tmp_path / "t"), version=2).collect()


def test_an_interrupted_last_token_line_is_left_out(spark, tmp_path):
    line = '{"surface":"a","doc_id":"d","sentence_id":"s","position":0}\n'
    (tmp_path / "t.jsonl").write_text('{"format":"tokens","version":1}\n' + line + line + line[:25])
    assert files.read_tokens(spark, str(tmp_path / "t.jsonl")).count() == 2
    (tmp_path / "u.jsonl").write_text('{"format":"tokens","version":1}\n' + line + line[:25] + "\n" + line)
    with pytest.raises(Exception, match="a broken line"):
        files.read_tokens(spark, str(tmp_path / "u.jsonl")).collect()


def test_word_list_dictionary_and_profile(spark, tmp_path):
    (tmp_path / "w.txt").write_text("one\n\n  two \nthree\n")
    assert sorted(map(tuple, files.word_list(spark, str(tmp_path / "w.txt")).collect())) == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "d.dic").write_text("﻿3\ncat/S\nand\\/or/X\ndog\n")
    assert {(r.stem, r.flags) for r in files.dictionary(spark, str(tmp_path / "d.dic")).collect()} == {("cat", "S"), ("and/or", "X"), ("dog", "")}
    assert files.profile("<ldml><characters><exemplarCharacters>[a-c {dz} é]</exemplarCharacters></characters></ldml>") == set("abcdzé")


def test_snapshot(spark, tmp_path):
    files.write_snapshot(spark.createDataFrame([("p",)], "project string"), str(tmp_path / "s"))
    r = files.read_snapshot(spark, str(tmp_path / "s"), "project string").first()
    assert r.project == "p" and len(r.snapshot_sha256) == 64
    (tmp_path / "bad.json").write_text(json.dumps({"format": "other", "version": 1}))
    with pytest.raises(Exception, match="unknown snapshot"):
        files.read_snapshot(spark, str(tmp_path / "bad.json"), "project string").collect()


def test_published_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = spark.range(5)
    with pytest.raises(ValueError):
        store.publish(spark, {"a": rows}, path, {"a": ["id < 4"]})
    assert list(tmp_path.iterdir()) == []
    store.publish(spark, {"a": rows, "b": rows}, path, {"a": ["id < 5"]}, skip={"b"})
    assert spark.read.parquet(f"{path}/a").count() == 5 and not (tmp_path / "facts/b").exists()
    with pytest.raises(FileExistsError):
        store.publish(spark, {"a": rows}, path)


def test_cache_identity(spark, tmp_path):
    path, facts = str(tmp_path / "c"), spark.range(3).withColumn("run_id", F.lit(1))
    assert store.open_cache(spark, path, {"grammar": "g"}, "full") is None
    store.write_cache(facts, path, {"grammar": "g"}, "full")
    opened = store.open_cache(spark, path, {"grammar": "g"}, "full")
    assert opened.count() == 3 and store.frozen(opened, 1, 3).count() == 3
    with pytest.raises(ValueError):
        store.frozen(opened, 1, 4)
    with pytest.raises(ValueError):
        store.open_cache(spark, path, {"grammar": "g"}, "compact")
    assert store.open_cache(spark, path, {"grammar": "h"}, "full") is None and not (tmp_path / "c").exists()


def test_upsert_stream_goes_on(spark, tmp_path):
    base = f"file://{tmp_path}"
    put = lambda rows: spark.createDataFrame(rows, "k long, n long").write.mode("append").parquet(f"{base}/in")
    for rows, want in (([(1, 1), (1, 3), (2, 1)], {1: 3, 2: 1}), ([(2, 5), (1, 2)], {1: 3, 2: 5})):
        put(rows)
        source = spark.readStream.schema("k long, n long").parquet(f"{base}/in")
        jobs.upsert_stream(source, f"{base}/state", f"{base}/checkpoint", ["k"], "n").awaitTermination()
        assert {r.k: r.n for r in jobs.latest_version(spark, f"{base}/state", ["k"], "n").collect()} == want


def test_upsert_stream_merges_and_deletes(spark, tmp_path):
    base, want = f"file://{tmp_path}", {}
    for i in range(7):
        rows = [(k, 10 * i + k) for k in range(i % 3, 5)]
        want |= dict(rows)
        spark.createDataFrame(rows, "k long, n long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema("k long, n long").parquet(f"{base}/in")
        jobs.upsert_stream(source, f"{base}/state", f"{base}/checkpoint", ["k"], "n", every=2).awaitTermination()
        assert {r.k: r.n for r in jobs.latest_version(spark, f"{base}/state", ["k"], "n").collect()} == want
    assert {p.name for p in (tmp_path / "state").iterdir()} <= {"v3", "v5", "d4", "d5", "d6"}


def test_serve(spark, tmp_path):
    (tmp_path / "req").mkdir()
    (tmp_path / "req/a.jsonl").write_text('{"id": "1", "word": "x"}\nnonsense\n')
    q = jobs.serve(spark, f"file://{tmp_path}/req", f"file://{tmp_path}/res", f"file://{tmp_path}/cp", lambda df: df.select("id", F.upper("word").alias("answer")))
    q.awaitTermination()
    lines = sorted(r.value for r in spark.read.text(f"file://{tmp_path}/res").collect())
    assert [json.loads(x) for x in lines] == [{"error": "bad request"}, {"id": "1", "answer": "X"}]
