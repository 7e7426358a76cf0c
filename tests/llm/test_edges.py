"""Every registered query on nulls, empty and long texts, repeated rows, clashing columns, and on empty tables."""

import hashlib
import zlib

import pytest

from glossweave.llm import licenses, queries, simhash

LONG = " ".join(f"word{i % 977} of" for i in range(30_000))
TEXTS = [None, "", " ", "\n\n", "one", "a b c d e", LONG, LONG, "token = abcdefgh1234 and token: 'abcdefgh1234'", "Released under the MIT License.\nReleased under the MIT License.", "é" * 300, "x" * 5000, "<|endoftext|> tail", "idiot " * 40]
CLASH = {"score": 1.0, "n": 2, "fp": 3, "row": 4, "key": "k", "spans": "s", "digest": "d", "label": 1, "kept": True, "found": "f", "u": 5, "v": 6, "_t": "t", "_w": "w", "n_words": 7, "base": 1, "rank": 1, "id": 9, "payload": "p", "bytes": 1}


def tables(spark, folder, empty):
    def write(name, rows, schema):
        df = spark.createDataFrame([] if empty else rows, schema)
        from pyspark.sql import functions as F

        for k, v in CLASH.items():
            df = df.withColumn(k, F.lit(v)) if k not in df.columns else df
        df.repartition(3).write.parquet(f"{folder}/{name}.parquet")

    docs = [(i, t, ["en", "de", None][i % 3], ["s1", None, "s2"][i % 3], None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    docs += [docs[5], docs[5], (None, "no id here", "en", "s1", 10), (None, None, None, None, None)]
    docs += [(100 + i, f"some words stand here number {i} and more of them {'bad scum ' * (i % 2)}", "en", "s", 40) for i in range(60)]
    write("documents", docs, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(100 + i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (4, 0, 1), (4, 1, 0)]
    write("labels", labels, "doc_id long, quality int, toxic int")
    vectors = [(0, [0.5, 0.25], 0), (50, [0.1, -0.3], 1), (7, None, 0), (8, [None, 1.0], 0), (9, [float("nan"), 1.0], 0), (10, [], 0), (100, [float("inf"), 0.0], 0), (None, [1.0, 1.0], 0), (11, [0.5, 0.25], 0), (11, [0.5, 0.25], 0), (12, [1e18, 1e18], 0), (150, [1.0, 2.0, 3.0], 0)]
    write("embeddings", vectors, "vec_id long, embedding array<float>, label int")
    pages = [(3, "http://a", "<p>" + "x" * 200), (2, "http://b\r\nX: y", "<p>" + "x" * 200), (1, None, None), (4, "http://c", ""), (None, "u", "<p>" + "x" * 200), (5, "http://d", "short"), (6, "http://d", "short"), (3, "http://a", "<p>" + "x" * 200)]
    write("pages", pages, "page_id long, url string, html string")
    return len(docs)


@pytest.fixture(scope="module", params=["edges", "empty"])
def data(request, spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp(request.param))
    return request.param, d, tables(spark, d, request.param == "empty")


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op2_topk", "op5_warc", "op8_packing")])
def test_a_row_for_each_document(spark, data, name):
    kind, d, n = data
    rows = queries.QUERIES[name](spark, d).collect()
    assert len(rows) == (0 if kind == "empty" else n)


def test_packing_covers_each_document(spark, data):
    kind, d, n = data
    rows = queries.op8_packing(spark, d).collect()
    assert sum(r.start == 0 for r in rows) == (0 if kind == "empty" else n)
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_topk(spark, data):
    kind, d, _ = data
    rows = [(r.query_id, r["rank"], r.vec_id, r.score) for r in queries.op2_topk(spark, d).collect()]
    if kind == "empty":
        assert rows == []
        return
    of = lambda q: [(v, s) for i, _, v, s in sorted(rows) if i == q]
    assert [v for v, _ in of(0)][0] == 12 and of(0)[1:] == [(11, 20480), (11, 20480), (50, 25 * 128 - 77 * 64)]
    assert of(150) == [] and 100 not in {q for q, *_ in rows}


def test_warc(spark, data):
    kind, d, _ = data
    rows = queries.op5_warc(spark, d).collect()
    if kind == "empty":
        assert rows == []
        return
    by = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert by == sorted([("1", "response", None, 0), ("2", "response", None, 203), ("3", "revisit", 2, 203), ("3", "revisit", 2, 203), ("4", "response", None, 0), ("5", "response", None, 5), ("6", "response", None, 5), ("None", "revisit", 2, 203)])


def rows_of(spark, data, name):
    """The query's rows by id as text, repeated ones as a list; none of an empty table."""
    kind, d, _ = data
    by = {}
    for r in queries.QUERIES[name](spark, d).collect():
        by.setdefault(str(r.doc_id), []).append({k: v for k, v in r.asDict().items() if k != "doc_id"})
    return None if kind == "empty" and not by else by


def sha(x=b""):
    return hashlib.sha256(x).hexdigest()


def test_lm_values(spark, data):
    if (by := rows_of(spark, data, "op1_lm")) is None:
        return
    scores = {k: by[k][0]["score"] for k in ("0", "1", "2", "3")}
    assert len(set(scores.values())) == 1 and all(by[k][0]["n_tokens"] == 1 and by[k][0]["n_known"] == 1 for k in scores)  # null, empty, blanks
    assert {x["n_tokens"] for x in by["None"]} == {1, 4} and min(x["n_tokens"] for x in by["None"]) == 1
    assert len(by["5"]) == 3 and len({x["score"] for x in by["5"]}) == 1 and by["6"][0]["n_tokens"] == 60_001
    assert all(x["score"] < 0 and x["base_score"] < 0 for rows in by.values() for x in rows)
    assert by["0"][0]["held_out"] == (zlib.crc32(b"0") % 7 == 2) and by["None"][0]["held_out"] == (zlib.crc32(b"") % 7 == 2)


def test_bpe_values(spark, data):
    if (by := rows_of(spark, data, "op3_bpe")) is None:
        return
    nothing = {"n_tokens": 0, "ids_sha256": sha(), "decoded_sha256": sha()}
    assert by["0"] == [nothing] and by["1"] == [nothing] and nothing in by["None"]
    assert by["5"][0]["decoded_sha256"] == sha(b"a b c d e") and by["5"] == by["5"][:1] * 3
    assert by["12"][0]["decoded_sha256"] == sha(b"<|endoftext|> tail") and by["12"][0]["n_tokens"] == 2
    assert by["6"] == by["7"] and by["6"][0]["decoded_sha256"] == sha(LONG.encode())


def test_secret_values(spark, data):
    if (by := rows_of(spark, data, "op4_secrets")) is None:
        return
    nothing = {"n_assign": 0, "n_access": 0, "n_hex": 0, "base_sha256": sha(), "spans": "", "n_live": 0, "n_copied": 0, "most_repositories": 0}
    assert by["0"] == by["1"] == by["2"] == [nothing] and by["None"] == [nothing] * 2
    shown = "assign:0:20,assign:25:45"
    assert by["8"] == [nothing | {"n_assign": 2, "spans": shown, "base_sha256": sha(shown.encode()), "n_live": 2, "most_repositories": 1}]


def test_quality_values(spark, data):
    if (by := rows_of(spark, data, "op6_quality")) is None:
        return
    nothing = {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False}
    assert by["0"] == by["1"] == by["2"] == by["3"] == [nothing] and nothing in by["None"]
    assert by["5"] == [nothing | {"n_words": 5, "word_chars": 5}] * 3
    assert by["9"][0]["n_dup_lines"] == 1 and by["9"][0]["n_repeat_words"] == 10
    assert by["6"] == by["7"] and by["6"][0]["n_words"] == 60_000 and by["6"][0]["base_failed"]


def test_simhash_values(spark, data):
    if (by := rows_of(spark, data, "op7_simhash")) is None:
        return
    zero = {"fingerprint": "0" * 16, "component_id": 0}
    assert by["0"] == by["1"] == by["2"] == by["3"] == [zero] and zero in by["None"]  # nothing links to nothing, also without an id
    assert {"fingerprint": f"{simhash.fingerprint('no id here'):016x}", "component_id": None} in by["None"]
    assert by["5"] == by["5"][:1] * 3 and by["6"][0] == by["7"][0] and by["7"][0]["component_id"] == 6


def test_toxicity_values(spark, data):
    if (by := rows_of(spark, data, "op9_toxicity")) is None:
        return
    assert by["0"][0]["score"] == by["1"][0]["score"] and by["5"] == by["5"][:1] * 3 and by["6"][0]["score"] == by["7"][0]["score"]
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for rows in by.values() for x in rows)
    assert by["101"][0]["predicted"] == 1 and by["100"][0]["predicted"] == 0
    assert by["0"][0]["held_out"] == (zlib.crc32(b"0") % 5 == 0) and by["None"][0]["held_out"] == (zlib.crc32(b"") % 5 == 0)


def test_license_values(spark, data):
    if (by := rows_of(spark, data, "op10_licenses")) is None:
        return
    nothing = {"n_licenses": 0, "licenses": "", "n_passages": 0, "best_dice": None}
    assert by["0"] == by["1"] == by["6"] == [nothing] and by["None"] == [nothing] * 2
    assert by["9"] == [{"n_licenses": 1, "licenses": "MIT", "n_passages": 3, "best_dice": 1.0}]  # two lines and their paragraph


def test_license_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    found = licenses.scan(df, templates=[("a", "one two three four"), ("b", "one two three four")]).first().licenses
    assert [(h.license, h.template) for h in found] == [("a", 0)]


def test_pipeline(spark, data):
    import corpus_pipeline

    kind, d, _ = data
    rows = corpus_pipeline.run(spark, d).collect()
    assert (rows == []) if kind == "empty" else all(r.length > 0 and r.doc_tokens >= r.start + r.length for r in rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
