"""Operators against brute force, round trips and planted cases on small data."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glossweave.llm import bpe, licenses, lm, packing, quality, queries, secret_scan, simhash, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["the", "of", "And", "to", "ring", "widget", "été", "straße", "naïve", "go.", "stop,", "x1", "a"]


def texts(n, seed, most=60):
    r = random.Random(seed)
    return ["".join(r.choice(VOCAB) + r.choice([" ", " ", "\n", "  "]) for _ in range(r.randint(0, most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "en", f"s{i % 5}") for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(4)


def brute_lm(train, order):
    start = "<S>"
    tok = lambda x: x.encode().lower().split() + [b""]
    raw = Counter(w for t in train for w in tok(t))
    cnt = [None] * (order + 1)
    cnt[order] = Counter()
    for t in train:
        s = [start] * (order - 1) + tok(t)
        for i in range(order - 1, len(s)):
            cnt[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        cnt[k] = Counter()
        for g, n in cnt[k + 1].items():
            cnt[k][g[1:]] += n if g[1] == start else 1
    d, ctx = [], []
    for k in range(1, order + 1):
        of = Counter(cnt[k].values())
        d.append(lm.discounts([of[i] for i in (1, 2, 3, 4)]))
        st = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in cnt[k].items():
            st[g[:-1]][0] += c
            st[g[:-1]][min(c, 3)] += 1
        ctx.append(st)

    def p(h, w):
        pr = 1 / (len(raw) + 1)
        for k in range(1, order + 1):
            hh = tuple(h[len(h) - k + 1 :]) if k > 1 else ()
            if st := ctx[k - 1].get(hh):
                c = cnt[k].get(hh + (w,), 0)
                pr = (max(c - d[k - 1][min(c, 3)], 0) + (d[k - 1][1] * st[1] + d[k - 1][2] * st[2] + d[k - 1][3] * st[3]) * pr) / st[0]
        return pr

    def score(x):
        s = [start] * (order - 1) + tok(x)
        return sum(math.log10(p(s[max(0, i - order + 1) : i], s[i])) for i in range(order - 1, len(s)))

    assert math.isclose(sum(p((start,) * (order - 1), w) for w in raw) + p((start,) * (order - 1), b"unseen"), 1)
    base = lambda x: sum(math.log10((raw.get(w, 0) + 1) / (sum(raw.values()) + len(raw) + 1)) for w in tok(x))
    return score, base


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, order):
    train, test = texts(80, 1), texts(20, 2) + ["", "unseen words here"]
    model = lm.train(frame(spark, train), order=order)
    got = {r.doc_id: r for r in lm.score(frame(spark, test), model).collect()}
    score, base = brute_lm(train, order)
    for i, x in enumerate(test):
        assert math.isclose(got[i].score, score(x), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, base(x), rel_tol=1e-9)


def test_packed_columns_round_trip():
    r = np.random.default_rng(0)
    cols = [np.sort(r.integers(0, 1 << 60, 1000, dtype=np.uint64)), r.integers(0, 9, 1000, dtype=np.uint64)]
    assert all((a == b).all() for a, b in zip(cols, lm.unpacked(lm.packed(cols)), strict=True))


def test_topk_against_all_pairs(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(700, 20)).astype("f4")
    v[300:500] = v[7]  # a very common vector
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    got = defaultdict(list)
    for x in topk.top_k(df, F.col("vec_id") % 50 == 0, candidate_block=64, query_block=4).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    e = np.floor(256 * v.astype("f8")).astype(int)
    for q in range(0, 700, 50):
        s = e @ e[q]
        want = sorted(((int(s[i]), i) for i in range(700) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert got[q] == want


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = queries._tokenizer("byte_bpe_50k.json")
    own, lib, r = bpe.Coder(path), Tokenizer.from_file(path), random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "é", "<|endoftext|>", "1", "'s", "!!", "日本", "𐀀", "\x1c", "͸", "aaaa", "ing", "er", "\xa0"]
    samples = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["".join(r.choice("aeinrst") for _ in range(30)) for _ in range(1000)]
    for x in samples:
        want = lib.encode(x, add_special_tokens=False).ids
        got = own.encode(x)
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_bpe_automaton_allows_exactly_bpe():
    """On a tiny vocabulary every string has one path, that of merging by rank."""
    vocab = {c: i for i, c in enumerate(["a", "b", "c", "ab", "bc", "aa", "abc", "aab"])}
    merges = [("a", "b"), ("b", "c"), ("a", "a"), ("ab", "c"), ("a", "ab")]
    own, r = bpe.Automaton(vocab, merges), random.Random(1)
    rank = {m: i for i, m in enumerate(merges)}
    for _ in range(2000):
        x = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        parts = list(x)
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert own.encode(x.encode()) == [vocab[p] for p in parts], x


def test_bpe_tables_hold_the_arcs_of_the_gadgets():
    own, r = bpe.Coder(queries._tokenizer("byte_bpe_50k.json")).automaton, random.Random(3)
    tokens = sorted(own.token.values())
    removed = r.sample(sorted(own.removed), 3000)
    pairs = [(x >> bpe.BITS, x & ((1 << bpe.BITS) - 1)) for x in removed] + [(r.choice(tokens), r.choice(tokens)) for _ in range(20_000)]
    by_left = defaultdict(list)
    for t in tokens:
        by_left[own.left[t]].append(t)
    pairs += [(u, r.choice(by_left[v])) for u, v in pairs if by_left[v]]
    assert all(own.arc(u, v) == own.open(u, v) for u, v in pairs)
    assert sum(not own.open(u, v) for u, v in pairs) > 3000


def test_simhash_links(spark):
    r = np.random.default_rng(1)
    for radius, blocks in ((4, 1), (6, 2)):
        base = r.integers(0, 2**63, 200, dtype=np.uint64)
        near = [base]
        for k in range(1, 7):
            x = r.choice(base[:40], 120)
            for _ in range(k):
                x = x ^ (np.uint64(1) << r.integers(0, 64, 120).astype(np.uint64))
            near.append(x)
        f = np.unique(np.concatenate(near))
        parent = list(range(len(f)))

        def find(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for i in range(len(f)):
            for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        groups = defaultdict(list)
        for i in range(len(f)):
            groups[find(i)].append(int(f.view(np.int64)[i]))
        want = {x: min(g) for g in groups.values() for x in g}
        df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
        for chunk in (8192, 20):
            edges = simhash.links(df, len(f), radius, chunk, blocks)
            got = {x.node: x.root for x in simhash.components(edges).collect()}
            assert all(got.get(x, x) == want[x] for x in want)


def test_fingerprints():
    for x in texts(60, 9) + ["", "one", "a b c"]:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(a.encode(), 42) for a in s]
        assert simhash.fingerprint(x) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_quality_metrics(spark):
    rows = texts(150, 4, 90) + ["a b c a b c", "x\nx\n \nx", "#|# $", "A a A a A a"]
    got = {r.doc_id: r for r in quality.metrics(frame(spark, rows), ["doc_id"]).collect()}
    for i, x in enumerate(rows):
        w = WORD.findall(x)
        g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c, cov, seen, dup = Counter(g), set(), set(), 0
        for k, y in enumerate(g):
            cov |= {k, k + 1, k + 2} if c[y] > 1 else set()
        for line in x.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x), dup, len(cov))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (5, 60, 900) for p in (0.01, 0.1, 0.3) for k in range(0, int(n * p) + 1, 7)]
    for n, k, p in cases:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        for terms in (2000, 3):
            got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p, terms)).first()[0]
            assert got >= exact * (1 - 1e-9) and (terms == 3 or math.isclose(got, exact, rel_tol=1e-9))


def test_risk_control_rejects_junk_only(spark):
    rows = [(i, ("good words of a text " * 12) + str(i) if i % 4 else "bad### word$$$ " * 40 + str(i), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4000)], "doc_id long, quality int")
    measured = quality.metrics(docs, ["doc_id", "lang"]).withColumn("n_repeat_words", F.lit(0).cast("long")).cache()
    kept = {r.doc_id: r.kept for r in quality.judged(measured, labels).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in kept)


def test_secrets_base_spans_and_redaction(spark):
    r = random.Random(3)
    parts = ["token", "API_KEY", "passWD", "=", ":", " ", "'", "abc", "deadbeef0123", "0123456789abcdef0123456789abcdef", "AKIA", "ABCDEFGH12345", "é", "𐀀", "\n", ".", "ſecret", "=="]
    rows = ["".join(r.choice(parts) for _ in range(r.randint(1, 16))) for _ in range(600)] + [" ".join(f"token=abcdefgh{i:05d}" for i in range(700))]
    flex = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    base = [("assign", re.compile(rf"""({flex})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    found = secret_scan.scan(frame(spark, rows), ["doc_id"]).select("doc_id", secret_scan.shown(F.col("base")).alias("b"))
    got = {x.doc_id: x.b for x in found.collect()}
    clean = {x.doc_id: x.text for x in secret_scan.redact(frame(spark, rows)).collect()}
    for i, x in enumerate(rows):
        s = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(base) for m in p.finditer(x) if len(m[g]) >= least)
        assert got[i] == ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in s)
        assert "[secret]" in clean[i] if s else True
    assert "abcdefgh0" not in clean[len(rows) - 1]


def test_copied_examples_are_not_added(spark):
    key = "Ab3" + "x9Q" * 12
    rows = [(i, f"see {key} here", "en", f"owner{i}") for i in range(6)] + [(9, f"mine {key[::-1]} here", "en", "owner1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: len(r.added) for r in secret_scan.scan(docs, ["doc_id"]).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 1}


def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 90
    pages = spark.createDataFrame([(2, "http://b", body), (1, "http://a", body), (3, "http://c", "x")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "a"))
    records = warc.read(spark, str(tmp_path / "a"))
    got = {r.id: r for r in warc.parsed(records).collect()}
    assert got["2"].record_type == "revisit" and got["2"].refers_to == "1" and bytes(got["2"].payload).decode() == body
    assert got["1"].payload_digest == hashlib.sha256(body.encode()).hexdigest() and got["1"].url == "http://a"
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    raw = [bytes(r.record) for r in warc.records(records).collect()]
    assert sum(body.encode() in x for x in raw) == 1 and all(x.startswith(b"WARC/1.1\r\n") and x.endswith(b"\r\n\r\n") for x in raw)


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 64), (64, 8, 20)])
def test_packing_limits(limits):
    r = random.Random(2)
    most, segments, loss = limits
    packer, rows, sizes, first = packing.Packer(most, segments, loss, window=16), [], {}, {}
    for i in range(300):
        n = r.choice([1, 2, 3, 10, 50, 200])
        sizes[i], first[i] = n, r.randint(0, n) * (loss < most)
        rows += packer.add(i, np.arange(n, dtype="<u4").tobytes(), first[i])
    rows += packer.close()
    seen, by = defaultdict(int), defaultdict(list)
    for key, start, n, total, bears, seq, offset, ids in rows:
        assert bears == max(0, start + n - max(start, first[key]))
        assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n)) and total == sizes[key]
        seen[key] += n
        by[seq].append((offset, n, max(0, start + n - max(start, first[key]))))
    assert seen == sizes
    for parts in by.values():
        parts.sort()
        assert [o for o, *_ in parts] == list(np.cumsum([0] + [n for _, n, _ in parts])[:-1])
        assert sum(n for _, n, _ in parts) <= most and len(parts) <= segments and sum(x for *_, x in parts) <= loss
    if loss == most:
        full = [sum(n for _, n, _ in p) for p in by.values()]
        assert all(n & (n - 1) == 0 for n in full)


def brute_packing(texts, cap, segments, most, window):
    """The rule in plain Python: (key, start, length, sequence), texts given as (tokens, first loss-bearing token)."""
    waiting, out, seq = [], [], 0
    bears = lambda at, n, first: max(0, at + n - max(at, first))

    def fill():
        nonlocal seq
        longest = sum(sorted((w[2] for w in waiting), reverse=True)[:segments])
        size = cap
        while longest < cap and size > longest:
            size //= 2
        left, places, loss = size, segments, most
        while left and places and waiting:
            fits = [w for w in waiting if w[2] <= left and bears(w[1], w[2], w[3]) <= loss]
            if places == 1 and any(w[2] >= left for w in waiting):
                fits = [w for w in fits if w[2] == left]
            if fits:
                at = max(fits, key=lambda w: w[2] / cap * (left / cap) + places / segments**2 + bears(w[1], w[2], w[3]) / most * (loss / most))
                n = at[2]
            else:
                room = [min(left, max(0, w[3] - w[1]) + loss, w[2]) for w in waiting]
                n = max(room)
                at = waiting[room.index(n)]
            if n <= 0:
                break
            out.append((at[0], at[1], n, seq))
            left, places, loss = left - n, places - 1, loss - bears(at[1], n, at[3])
            at[1], at[2] = at[1] + n, at[2] - n
            waiting[:] = [w for w in waiting if w[2]]
        seq += 1

    for key, (n, first) in enumerate(texts):
        at = 0
        while n - at >= cap and bears(at, cap, first) <= most:
            out.append((key, at, cap, seq))
            seq, at = seq + 1, at + cap
        if at < n:
            waiting.append([key, at, n - at, first])
        if len(waiting) >= window:
            while len(waiting) > window // 2:
                fill()
    while waiting:
        fill()
    return out


def packed_rows(texts, *limits):
    packer, rows = packing.Packer(*limits), []
    for i, (n, first) in enumerate(texts):
        rows += packer.add(i, bytes(4 * n), first)
    return [(r[0], r[1], r[2], r[5]) for r in rows + packer.close()]


def test_packing_takes_the_largest_dot_product():
    r = random.Random(4)
    for limits in ((64, 5, 60, 16), (64, 64, 64, 16), (128, 4, 100, 30)):
        texts = [(n := r.choice([1, 2, 3, 7, 11, 30, 50, 200]), r.randint(0, n // 3)) for _ in range(400)]
        assert packed_rows(texts, *limits) == brute_packing(texts, *limits)


def test_each_limit_of_the_packing_query_binds(spark):
    """On the query's own parameters and table; without either extra limit the sequences are others."""
    limits = queries.PACKING
    rows = queries.op8_packing(spark, "/root/testdata/sf0.01").select("doc_id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id").collect()
    tokens, segments, loss = Counter(), Counter(), Counter()
    for x in rows:
        tokens[x.sequence_id] += x.length
        segments[x.sequence_id] += 1
        loss[x.sequence_id] += x.loss_tokens
    assert max(tokens.values()) == limits["max_tokens"] and max(segments.values()) == limits["max_segments"] and max(loss.values()) == limits["max_loss"]
    padding = sum(0 if n & (n - 1) == 0 else limits["max_tokens"] - n for n in tokens.values())
    assert padding <= 0.02 * sum(tokens.values())
    of = defaultdict(lambda: [0, 0])
    for x in rows:
        of[x.doc_id][0] += x.length
        of[x.doc_id][1] += x.loss_tokens
    texts = [(n, n - bears) for n, bears in of.values()]
    cap, most, heavy = limits["max_tokens"], limits["max_segments"], limits["max_loss"]
    whole = packed_rows(texts, cap, most, heavy, 128)
    assert whole == brute_packing(texts, cap, most, heavy, 128)
    assert whole != packed_rows(texts, cap, 10**6, heavy, 128) and whole != packed_rows(texts, cap, most, cap, 128)


def test_chunk_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path, r = queries._tokenizer("word_bpe_49k.json"), random.Random(7)
    parts = ["a", "B", "the", " ", "\n", "É", "ß", "<|endoftext|>", "<|STARTOFTEXT|>", "22", "'s", "'LL", "!!", "日本", "\x1c", "͸", "\xa0", "Σ", "İ", "é", "≠", "²", "×", ".", ","]
    own, lib = packing.ChunkEncoder(path, most=50), Tokenizer.from_file(path)
    samples = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for i in range(0, len(samples), 100):
        for x, (ids, _) in zip(samples[i : i + 100], own.encode(samples[i : i + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(x, add_special_tokens=False).ids


def test_toxicity_holds_out(spark):
    r = random.Random(6)
    rows = [" ".join(r.choice(VOCAB) for _ in range(60)) + (" you moron scum" if i % 5 == 0 else "") for i in range(800)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(800)], "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, labels, fold != 0)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model, ["doc_id"]).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 5 == 0) for i in held) >= 0.98 * len(held)


def test_license_scan(spark):
    rows = ["Some text.\nReleased under the MIT License.\nMore.", "Licensed under CC BY 4.0", "released under the license of spring", "This work is licensed under the GNU General Public License,\nversion 3.", ""]
    rows += ["We met at noon and spoke of the old house by the river for a long time. Licensed under the Apache License, Version 2.0.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]
    got = {r.doc_id: [h.license for h in r.found] for r in licenses.scan(frame(spark, rows), name="found").collect()}
    assert got == {0: ["MIT"], 1: ["CC-BY-4.0"], 2: [], 3: ["GPL-3.0"], 4: [], 5: ["Apache-2.0"], 6: ["GPL-2.0"]}


def test_license_scan_against_all_templates(spark):
    """The gate by marks and the size bounds lose nothing: parts of notices and full texts, some words left out, against every template."""
    r = random.Random(8)
    notices, full = queries.op10_templates()
    full = full or [("made up", " ".join(f"clause{i % 70} grants rights number {i % 13}" for i in range(300)))]
    rows = []
    for _ in range(300):
        name, t = r.choice(notices)
        rows.append(" ".join(w for w in t.split() if r.random() < r.choice([0.8, 0.93, 1])))
    for name, t in full:
        rows += ["\n".join(x for x in t.split("\n") if r.random() < keep) for keep in (0.5, 0.8, 1)]

    def best(x, templates):
        a = set(licenses.bigrams(x))
        scored = [(2 * len(a & set(b)) / (len(a) + len(b)), -i, name) for i, (name, t) in enumerate(templates) if (b := licenses.bigrams(t))]
        return max(scored) if a else (0, 0, "")

    got = {x.doc_id: x.found for x in licenses.scan(frame(spark, rows), templates=notices, full=full, name="found").collect()}
    for i, x in enumerate(rows):
        lines = x.split("\n")
        passages = lines + [p for p in re.split(licenses.PARAGRAPH, x) if "\n" in p] + [p for y in lines for p in re.split(licenses.SENTENCE, y) if p != y]
        hits = [(p, *best(p, notices)) for p in passages] + [(x, *best(x, full))]
        hits = [(p, score, name) for p, score, _, name in hits if score >= 0.8]
        want = [(name, score) for p, score, name in hits if not any(p in q and p != q and other >= score for q, other, _ in hits)]
        assert [h.license for h in got[i]] == [n for n, _ in want]
        assert all(math.isclose(h.dice, s) for h, (_, s) in zip(got[i], want, strict=True))


def test_packing_refuses_tokenizers_that_keep_white_space():
    with pytest.raises(ValueError, match="white space"):
        packing.ChunkEncoder(queries._tokenizer("byte_bpe_50k.json"))
