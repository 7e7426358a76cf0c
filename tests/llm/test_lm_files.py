"""A model of more shards than a process may have files open."""

import os
import resource

import numpy as np

from glossweave.llm import lm, shared

from .test_operators import brute_lm


def test_more_shards_than_open_files(tmp_path):
    bits, uri, r = 10, f"file://{tmp_path}/1", np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2) + np.uint64(1))
    counts = [r.integers(1, 400, len(keys)).astype(np.uint64) for _ in range(5)]
    at = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    wide = [lm.narrow(f"{uri}/{s}", keys[a:b], [c[a:b] for c in counts]) for s, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    table = lm.Table(uri, bits, ["<u1"] * 5, np.diff(at).tolist(), wide)
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 300, before[1]))
    try:
        place, values = table.find(keys[::-1])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)
    assert (place == np.arange(len(keys))[::-1]).all()
    assert all((v == c[::-1]).all() for v, c in zip(values, counts, strict=True))


def test_few_maps_at_once(spark, monkeypatch):
    rows = ["a x b", "c x d"] * 300 + ["a x d", "q"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model = lm.train(df, order=3)
    monkeypatch.setattr(shared, "MAPS", 2)
    import pyarrow as pa

    found = model.scores(pa.array(rows), lm.Numbers(model.vocabulary))[3]
    want, _ = brute_lm(rows, 3)
    assert np.allclose(found, [want(x) for x in rows], atol=1e-9)
    assert all(len(t._open) <= 2 for t in (model.vocabulary, *model.tables))
