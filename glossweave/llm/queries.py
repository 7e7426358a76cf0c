"""The queries op1_ to op10_ and pipeline, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The order of op1's model.
LM_ORDER = 3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import KINDS, scan, shown

    hits = scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{KINDS[i][0]}") for i in range(3)]
    every = F.array_sort(F.concat("base", "added"))
    live = F.size(F.filter(every, lambda s: s["live"])).cast("long")
    most = F.coalesce(F.array_max(F.transform(every, lambda s: s["repositories"])), F.lit(0)).cast("long")
    return hits.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"), live.alias("n_live"), (F.size(every) - live).alias("n_copied"), most.alias("most_repositories"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shared, warc

    uri = shared.folder(spark, "warc")
    pages = _table(spark, sf_dir, "pages")
    warc.write(pages, uri, least=100, date=F.lit("2020-01-01T00:00:00Z"))
    kind = pages.schema["page_id"].dataType
    found = warc.parsed(warc.read(spark, uri))
    return found.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality, shared

    measured = shared.written(quality.metrics(_table(spark, sf_dir, "documents"), ["doc_id", "lang"]), "quality")
    found = quality.judged(measured, _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"), words_each=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import perplexity, score, train
    from .shared import doc_key

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(doc_key()) % 7 == 2
    model = train(docs.where(~held), order=LM_ORDER, shard_bytes=4 << 20)
    scored = score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode

    coded = encode(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), decoded=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: The limits of op8's sequences; the first line of a text stands for a prompt, whose tokens bear no loss.
PACKING = {"max_tokens": 4096, "max_segments": 12, "max_loss": 3968}


def first_line(text: str = "text") -> F.Column:
    return F.instr(text, "\n")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2, loss_after=first_line(), **PACKING)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import doc_key
    from .toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(doc_key()) % 5
    model = train(docs, _table(spark, sf_dir, "labels"), fold != 0)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_templates() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Notices with their sentences, and the full texts that come with the package."""
    from .licenses import TEMPLATES, expanded, full_texts

    return expanded(TEMPLATES), full_texts()


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    notices, full = op10_templates()
    found = scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), cutoff=0.8, templates=notices, full=full, name="found")
    names = F.array_sort(F.array_distinct(F.transform("found", lambda h: h["license"])))
    best = F.array_max(F.transform("found", lambda h: F.round(h["dice"], 6)))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.size("found").cast("long").alias("n_passages"), best.alias("best_dice"))


QUERIES = {"op1_lm": op1_lm, "op2_topk": op2_topk, "op3_bpe": op3_bpe, "op4_secrets": op4_secrets, "op5_warc": op5_warc, "op6_quality": op6_quality, "op7_simhash": op7_simhash, "op8_packing": op8_packing, "op9_toxicity": op9_toxicity, "op10_licenses": op10_licenses}


def _license_sql() -> str:
    from .licenses import bigrams

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = op10_templates()
    rows = ", ".join(f"({kind}, {i}, {quoted(name)}, [{', '.join(map(quoted, bigrams(t)))}])" for kind in (0, 1) for i, (name, t) in enumerate(kinds[kind]))
    return rf"""
WITH templates(kind, template, license, grams) AS (VALUES {rows}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents),
paragraphs AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n') AS ps FROM documents),
passages AS (
  SELECT 0 AS whole, doc_id, p FROM lines
  UNION ALL SELECT 0, doc_id, p FROM (SELECT doc_id, unnest(ps) AS p FROM paragraphs) WHERE contains(p, chr(10))
  UNION ALL SELECT 0, doc_id, s FROM (SELECT doc_id, p, unnest(string_split(regexp_replace(p, '([.!?;:])\s+', '\1' || chr(10), 'g'), chr(10))) AS s FROM lines) WHERE s <> p
  UNION ALL SELECT 1, doc_id, coalesce(text, '') FROM documents),
words AS (SELECT whole, doc_id, p, list_filter(regexp_split_to_array(lower(p), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM passages),
sets AS (SELECT row_number() OVER () AS r, whole, doc_id, p, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) > 1),
scored AS (SELECT r, doc_id, p, license, template, 2.0 * len(list_intersect(b, grams)) / (len(b) + len(grams)) AS dice FROM sets JOIN templates ON whole = templates.kind WHERE len(b) >= len(grams) * 0.66 AND len(b) <= len(grams) * 1.51),
each AS (SELECT * FROM scored WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, template) = 1),
best AS (SELECT * FROM each h WHERE NOT EXISTS (SELECT 1 FROM each g WHERE g.doc_id = h.doc_id AND contains(g.p, h.p) AND g.p <> h.p AND g.dice >= h.dice))
SELECT d.doc_id, count(DISTINCT license) AS n_licenses, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses, count(license) AS n_passages, round(max(dice), 6) AS best_dice
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id GROUP BY d.doc_id"""


def _secrets_sql() -> str:
    from .secret_scan import BASE, KINDS

    quoted = lambda x: "'" + x.replace("'", "''").replace("{32,}+", "{32,}").replace("{16,}+", "{16,}") + "'"
    each = []
    for i, (_, pattern, group, least, needs) in enumerate(KINDS):
        p, good = quoted(pattern), "".join(f" AND regexp_matches(v, {quoted(n)})" for n in needs)
        lists = f"SELECT r, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, regexp_split_to_array(t, {p}) AS ss FROM d WHERE regexp_matches(t, {p})"
        flat = f"SELECT r, ms, ss, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i FROM ({lists})"
        each.append(f"SELECT r, {i} AS kind, CAST(list_sum(list_transform(ss[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS b, length(m) AS n, sha256(v) AS h FROM ({flat}) WHERE length(v) >= {least}{good}")
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(lang, '') AS lang FROM documents),
spans AS ({' UNION ALL '.join(each)}),
own AS (SELECT h, count(DISTINCT (owner, lang)) AS places, count(DISTINCT owner) <= 2 AND places <= 3 AS live FROM spans JOIN d USING (r) GROUP BY h),
s AS (SELECT r, kind, b, {names}[kind + 1] || ':' || b || ':' || (b + n) AS shown, live, places FROM spans JOIN own USING (h) WHERE kind < {BASE} OR live),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS c, count(*) FILTER (WHERE kind = 2) AS x, string_agg(shown, ',' ORDER BY b, kind) FILTER (WHERE kind < {BASE}) AS base, string_agg(shown, ',' ORDER BY b, kind) AS every, count(*) FILTER (WHERE live) AS live, count(*) FILTER (WHERE NOT live) AS copied, max(places) AS places FROM s GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied, coalesce(places, 0) AS most_repositories FROM d LEFT JOIN g USING (r)"""


SQL: dict[str, str] = {
    "op4_secrets": _secrets_sql(),
    "op2_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op5_warc": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS bytes FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE bytes >= 100 GROUP BY digest)
SELECT p.page_id, p.bytes AS payload_bytes, p.digest AS payload_digest, CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest""",
    "op6_quality": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
tok AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, a || ' ' || lead(a, 1) OVER p || ' ' || lead(a, 2) OVER p AS g FROM tok WINDOW p AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i FROM tri WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_shouted, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
x AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(least(CAST(n_symbols AS DOUBLE) / nullif(n_words, 0), 1), 0) AS f1, coalesce(least(CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0), 1), 0) AS f2,
  coalesce(least(CAST(n_repeat_words AS DOUBLE) / nullif(n_words, 0), 1), 0) AS f3, coalesce(least(CAST(n_shouted AS DOUBLE) / nullif(word_chars, 0), 1), 0) AS f4 FROM m),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) > 0),
h AS (SELECT lang, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS rule FROM x JOIN good USING (doc_id) WHERE NOT base_failed),
steps AS (SELECT lang, rule, least(ceil(f * 50), 50) AS step, count(*) AS n FROM h GROUP BY ALL),
cuts AS (SELECT lang, rule, cut, sum(n) AS n, coalesce(sum(n) FILTER (WHERE step > cut), 0) AS k FROM steps, (SELECT unnest(generate_series(0, 49)) AS cut) GROUP BY lang, rule, cut),
tested AS (SELECT *, list_sum(list_transform(generate_series(0, CAST(k AS BIGINT)), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) AS tail FROM cuts WHERE k < n * 0.01),
best AS (SELECT lang, rule, min(cut) / CAST(50 AS DOUBLE) AS cutoff FROM tested WHERE tail <= 0.05 / (4 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM steps))) GROUP BY lang, rule),
c AS (SELECT lang, max(cutoff) FILTER (WHERE rule = 1) AS c1, max(cutoff) FILTER (WHERE rule = 2) AS c2, max(cutoff) FILTER (WHERE rule = 3) AS c3, max(cutoff) FILTER (WHERE rule = 4) AS c4 FROM best GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(f1 > c1, false) OR coalesce(f2 > c2, false) OR coalesce(f3 > c3, false) OR coalesce(f4 > c4, false)) AS kept
FROM x LEFT JOIN c ON x.lang IS NOT DISTINCT FROM c.lang""",
    "op10_licenses": _license_sql(),
}
