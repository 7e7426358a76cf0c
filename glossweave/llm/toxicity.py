"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

1. Labelled rows in the training folds, at most ``max_train`` of them (smallest hash of the id first), are the sample.
   That bound is the only one, and it holds the fitting in a fixed size; every text is scored whole.
2. Each text's n-grams of ``orders`` characters, lower-cased, white space as one blank, are hashed to ``2**bits``
   places; presence counts, not frequency. Spark sums per place how many texts of each label have it.
3. The ``features`` places of the largest likelihood-ratio statistic stay. Each is scaled by its log-count ratio,
   log of its smoothed share among toxic texts over that among the others, and a logistic regression with an L2
   penalty is fitted to the sample's presence bits.

Inputs of a score are characters of the text only. Nulls: a null text is an empty one, and gets the score of the
intercept; rows of labels without a label or an id are left out; a null id is scored like any other; of several labels
for one id the highest counts, and of several texts that with the smallest digest, so that the model doesn't depend on
partitions. Repeated rows are scored each. Without labels of both kinds every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import shared

BLANKS = re.compile(r"\s+")


def hashed(text: str | None, orders: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """The places of the n-grams of a text, an array for each order, repeats included."""
    c = np.frombuffer(f" {BLANKS.sub(' ', (text or '').lower())} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    base, spread, top = np.uint64(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    found, h = [], c
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * base + c[n - 1 :]
        if n in orders:
            x = h + np.uint64(n)
            x ^= x >> np.uint64(29)
            found.append(((x * spread) >> top).astype(np.int64))
    return found


@dataclass
class Model:
    orders: tuple[int, ...]
    bits: int
    slot: np.ndarray  # place -> feature, or -1
    weight: np.ndarray
    intercept: float

    def present(self, text: str | None) -> np.ndarray:
        flags = np.zeros(len(self.weight) + 1, bool)
        for x in hashed(text, self.orders, self.bits):
            flags[self.slot[x]] = True  # -1 is the spare place at the end
        return flags[:-1]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weight[self.present(text)].sum(), -700, 700))))


def logistic(bits: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float, steps: int = 300, block: int = 128) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient descent on the mean log loss plus l2/2 |w|^2.

    ``bits`` has a row of packed presence bits for each text; column j of the matrix is bit j times ``scale[j]``. A step
    reads it once, ``block`` rows at a time, so the matrix itself, 32 times the bits, never stands in the driver.
    """
    n, d = len(y), len(scale)

    def read(w: np.ndarray, f) -> np.ndarray:
        """x.T @ f(x @ w, rows)."""
        found, w = np.zeros(d, np.float32), w * scale
        for i in range(0, n, block):
            rows = slice(i, min(i + block, n))
            x = np.unpackbits(bits[rows], axis=1, count=d).astype(np.float32)
            found += f(x @ w, rows) @ x
        return found * scale

    w, b = np.zeros(d, np.float32), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v = np.ones(d, np.float32)  # largest singular value, for the step
    for _ in range(20):
        v = read(v, lambda z, _: z)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (float(v @ read(v, lambda z, _: z)) / n + 1) + l2)
    wz, bz, t = w, b, 1.0
    e = np.zeros(n, np.float32)

    def off(z: np.ndarray, rows: slice) -> np.ndarray:
        e[rows] = 1 / (1 + np.exp(-np.clip(z + bz, -50, 50))) - y[rows]
        return e[rows]

    for _ in range(steps):
        w2 = wz - step * (read(wz, off) / n + l2 * wz)
        b2 = bz - step * float(e.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        wz, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def train(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", orders: tuple[int, ...] = (3, 4, 5), bits: int = 20, features: int = 2048, max_train: int = 16_000, l2: float = 1e-4) -> Model:
    """A model from the labels of rows for which ``in_training``, a column over the id, holds."""
    spark = docs.sparkSession
    shared.bounded(spark)
    wanted = labels.where(in_training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    sample = wanted.orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_train)
    ids = F.broadcast(spark.createDataFrame(sample.toPandas(), sample.schema))  # at most max_train ids
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, id_col)
    rows = texts.groupBy(id_col).agg(F.first("label").alias("label"), F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("t")).select("t.text", "label")
    held = shared.written(rows, "toxicity")

    def places(batches):
        shared.lean()
        for b in batches:
            count = np.zeros((2, 1 << bits), np.int32)
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                count[y, np.unique(np.concatenate([np.zeros(0, np.int64), *hashed(text.as_py(), orders, bits)]))] += 1
            at = np.flatnonzero(count.any(0))
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(count[0, at].astype(np.int64)), pa.array(count[1, at].astype(np.int64))], names=["place", "clean", "toxic"])

    n = {r["label"]: r["count"] for r in held.groupBy("label").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    prior = float(np.log((toxic + 1) / (clean + 1)))
    empty = Model(orders, bits, np.full(1 << bits, -1, np.int16), np.zeros(0), prior)
    if not clean or not toxic:
        return empty
    counts = held.mapInArrow(places, "place int, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    total = float(clean + toxic)

    def term(seen: Column, of: float, both: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * total / (of * both))).otherwise(0.0)

    a, b, s = F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")).cast("double")
    ratio = term(a, float(clean), s) + term(b, float(toxic), s) + term(clean - a, float(clean), total - s) + term(toxic - b, float(toxic), total - s)
    best = counts.where("a + b >= 3").withColumn("g", ratio).orderBy(F.desc("g"), "place").limit(features).toPandas()
    if not len(best):
        return empty
    slot = np.full(1 << bits, -1, np.int16)
    slot[best.place.to_numpy()] = np.arange(len(best))
    scale = np.log(((best.b + 1) / (toxic + 2)) / ((best.a + 1) / (clean + 2))).to_numpy(np.float32)
    bare = Model(orders, bits, slot, np.zeros(len(best)), 0.0)
    sent = spark.sparkContext.broadcast(bare)

    def flags(batches):
        for x in batches:
            yield pa.record_batch([pa.array([np.packbits(sent.value.present(t.as_py())).tobytes() for t in x.column(0)], pa.binary()), x.column(1)], names=["bits", "label"])

    seen = held.mapInArrow(flags, "bits binary, label int").toPandas()
    packed = np.frombuffer(b"".join(seen.bits), np.uint8).reshape(len(seen), -1)
    w, intercept = logistic(packed, scale, seen.label.to_numpy(np.float32), l2)
    return Model(orders, bits, slot, (w * scale).astype(np.float64), float(intercept))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """(the columns ``keep``, ``name`` double): the model over each whole text."""
    shared.bounded(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        shared.lean()
        for b in batches:
            scores = pa.array([sent.value.score(t.as_py()) for t in b.column(0)], pa.float64())
            yield pa.record_batch([*b.columns[1:], scores], names=[*keep, name])

    kind = StructType([*(docs.schema[c] for c in keep), StructField(name, DoubleType())])
    return docs.select(F.col(text_col).alias("_scored"), *keep).mapInArrow(run, kind)
