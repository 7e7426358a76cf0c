"""SimHash near duplicates by bit-sliced comparison.

Fingerprints are 64-bit majority votes over the XXH64 hashes of word shingles. Those within ``radius`` bits of each
other are linked, and the classes of linked texts get the smallest id in them.

* Equal fingerprints are one row from the start, however many copies there are.
* Candidates come from the pigeonhole principle: of ``radius + e`` blocks of bits, two linked fingerprints agree in
  ``e`` at least, so one of the block combinations puts them in the same bucket. ``e`` grows with the corpus, which
  keeps buckets small; every choice finds every link.
* A bucket is compared in vertical layout: one bit plane per fingerprint bit, 64 fingerprints a machine word. Planes
  are added three at a time by carry-save adders to bitwise counters that overflow beyond the radius; a query whose
  whole block has overflowed is abandoned.
* A bucket of over ``chunk`` fingerprints is cut into pieces and every two pieces meet in a task of their own, so no
  bucket goes to one task whole. A task returns a star for each class it finds instead of all its pairs.

Nulls: a null text is an empty one; without words the fingerprint is zero, and it links like any other. A null id gets
a row, and is a class's id only if the class has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SEED = 42
SHORT = 48  # buckets up to this size are compared together; at most 63
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words_each: int = 4) -> int:
    """The fingerprint of one text; see ``fingerprints``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= words_each:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    hashed, digest = xxhash.xxh64_intdigest, SEED
    starts = [0, *[e + 1 for e in ends[: len(words) - words_each]]]
    h = np.array([hashed(joined[a:b], digest) for a, b in zip(starts, ends[words_each - 1 :], strict=True)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4) -> DataFrame:
    """(id, fp long): a bit is one if it is set in over half of the shingles' hashes, repeats included."""

    shared.bounded(docs.sparkSession)

    def run(batches):
        shared.lean()
        for b in batches:
            ids, texts = b.columns
            fp = np.fromiter((fingerprint(x.as_py(), words_each) for x in texts), np.uint64, len(texts))
            yield pa.record_batch([ids, pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(64, words): bit i of the words of plane b is bit b of fingerprint i."""
    n = len(fp)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fp, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(planes: np.ndarray, n: int, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, words) bitmap of the fingerprints at ``radius`` differing bits or fewer."""
    words, depth = planes.shape[1], max(1, radius.bit_length())
    live = np.arange(len(queries))
    valid = np.full(words, _ONES)
    if n % 64:
        valid[-1] = np.uint64((1 << (n % 64)) - 1)
    found = np.zeros((len(queries), words), np.uint64)
    start = (1 << depth) - (radius + 1)  # a counter overflows at one difference more than the radius
    count = [np.full((len(queries), words), _ONES if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    over = np.zeros((len(queries), words), np.uint64) | ~valid

    def add(x: np.ndarray, k: int) -> None:
        for j in range(k, depth):
            carry = count[j] & x
            count[j] ^= x
            x = carry
        np.bitwise_or(over, x, out=over)

    q = queries.astype(np.uint64)
    for b in range(0, 64, 3):
        x = [planes[k][None, :] ^ (np.uint64(0) - ((q >> np.uint64(k)) & np.uint64(1)))[:, None] for k in range(b, min(b + 3, 64))]
        if len(x) == 3:
            half = x[0] ^ x[1]
            add(half ^ x[2], 0)
            add((x[0] & x[1]) | (half & x[2]), 1)
        else:
            for y in x:
                add(y, 0)
        if b >= 9 and b % 6 == 3:  # abandon the queries whose whole block is out of reach
            keep = (over != _ONES).any(1)
            if not keep.any():
                return found
            if not keep.all():
                live, q, over, count = live[keep], q[keep], over[keep], [c[keep] for c in count]
    found[live] = ~over
    return found


def linked(fp: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints the smallest index of each one's class of links."""
    n = len(fp)
    label = np.arange(n)
    planes = planes_of(fp)
    step = max(1, min(n, (1 << 17) // planes.shape[1]))
    for i in range(0, n, step):
        hits = near(planes, n, fp[i : i + step], radius)
        many = np.flatnonzero(np.bitwise_count(hits).sum(1) > 1)
        for k in many:
            ours = label[np.flatnonzero(np.unpackbits(hits[k].view(np.uint8), bitorder="little")[:n])]
            low = ours.min()
            if (ours != low).any():
                label[np.isin(label, ours)] = low
    return label


def linked_runs(fp: np.ndarray, run: np.ndarray, longest: int, radius: int) -> np.ndarray:
    """``linked`` for many short buckets at once: ``run`` numbers the bucket of each fingerprint, in order.

    All buckets stand in the same planes. The planes against themselves shifted by d places compare every fingerprint
    with the d-th after it, 64 a machine word; pairs across buckets are masked.
    """
    n, label = len(fp), np.arange(len(fp))
    planes = planes_of(fp)
    later = np.concatenate([planes[:, 1:], np.zeros((64, 1), np.uint64)], axis=1)
    pairs = []
    for d in range(1, min(longest, n)):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: n - d] = run[d:] == run[:-d]
        if not same.any():
            break
        depth = max(1, radius.bit_length())
        start = (1 << depth) - (radius + 1)
        count = [np.full(planes.shape[1], _ONES if start >> k & 1 else 0, np.uint64) for k in range(depth)]
        over = ~np.packbits(same, bitorder="little").view("<u8")
        for b in range(64):
            x = planes[b] ^ (planes[b] >> np.uint64(d) | later[b] << np.uint64(64 - d))
            for c in count:
                carry = c & x
                c ^= x
                x = carry
            over |= x
            if b % 8 == 7 and (over == _ONES).all():
                break
        hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little")[: n - d])
        if len(hit):
            pairs.append((hit, hit + d))
    if pairs:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:  # at most ``longest`` rounds
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                return label
    return label


def block_masks(radius: int, e: int) -> list[int]:
    """The masks of each choice of ``e`` of ``radius + e`` blocks."""
    m = radius + e
    edge = [64 * i // m for i in range(m + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(m)]
    return [sum(block[i] for i in pick) for pick in combinations(range(m), e)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, n: int, radius: int = 4, chunk: int = 8192, blocks: int = 1) -> DataFrame:
    """(u, v) of the column ``fp`` of ``distinct``: edges with the same classes as all the links; ``blocks``: e at least."""
    e = next((e for e in range(blocks, 5) if n / 2 ** (64 * e / (radius + e)) <= 256), 4)
    masks = block_masks(radius, e)
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])).alias("b")).select("fp", "b.c", "b.k")
    sizes = keyed.groupBy("c", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "k", F.ceil(F.col("n") / chunk).cast("int").alias("pieces"))
    mine = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    met = keyed.join(sizes, ["c", "k"]).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = met.select("fp", "c", "k", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    key = ["c", "k", "a", "b"]

    def run(batches):
        held: np.ndarray | None = None  # rows of the group that the next batch may continue

        def stars(rows: np.ndarray):
            new = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(1)])
            size = np.diff(np.append(np.flatnonzero(new), len(rows)))
            size_of = np.repeat(size, size)
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def keep(g, low):
                off = np.flatnonzero(low != np.arange(len(g)))
                us.append(g[off])
                vs.append(g[low[off]])

            short = (size_of > 1) & (size_of <= SHORT)
            if short.any():
                g = np.ascontiguousarray(rows[short, 4])
                keep(g, linked_runs(g.view(np.uint64), np.cumsum(new)[short], SHORT, radius))
            long = size_of > SHORT
            if long.any():
                g = rows[long]
                for part in np.split(g[:, 4], np.flatnonzero(np.diff(np.cumsum(new)[long])) + 1):
                    keep(part, linked(np.ascontiguousarray(part).view(np.uint64), radius))
            return pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
            at = last[-1] + 1 if len(last) else 0
            held = rows[at:]
            if at:
                yield stars(rows[:at])
        if held is not None and len(held):
            yield stars(held)

    return met.select(*key, "fp").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for the nodes of (u, v) by alternating large and small stars; the root is the smallest node.

    A hub, as the root of a large class is one, does not go to one task: see ``shared.spread_join``.
    """
    turned = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    total, before = turned.count(), None
    for _ in range(most):
        both = turned.unionByName(turned.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = shared.spread_join(both, low, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = shared.spread_join(large, low, "u", 2 * total)
        turned = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        # every node now hangs under a smaller one; nothing changes any more once no node is both child and parent
        now = tuple(turned.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("u", "v"), 32))).first())
        if now == before:
            return turned.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, total = now, now[0]
    raise RuntimeError("components did not converge")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 4, radius: int = 4, chunk: int = 8192, blocks: int = 1) -> DataFrame:
    """(id, fp long, component_id): each row's fingerprint and the smallest id that its links reach, its own included."""
    with shared.tidy(docs.sparkSession):
        own, of, rows = _classes(docs, id_col, text_col, words_each, radius, chunk, blocks)
    return shared.spread_join(own, of, "fp", rows).select(id_col, "fp", "component_id")


def _classes(docs: DataFrame, id_col: str, text_col: str, words_each: int, radius: int, chunk: int, blocks: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (id, fp) and (fp, n, component_id), both stored, and how many rows there are."""
    own = shared.written(fingerprints(docs, id_col, text_col, words_each), "simhash")
    distinct = shared.written(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    count, rows = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    star = links(distinct.select("fp"), count, radius, chunk, blocks)
    roots = components(star)
    within = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lows = within.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of = shared.written(shared.spread_join(within, lows, "root", count, count="members").select("fp", "n", "component_id"), "simhash-classes")
    return own, of, rows
