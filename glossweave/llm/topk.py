"""Exact top-k inner products by columnar branch and bound.

Vectors are held in vertical layout, a row of the array for each dimension. A query's scores grow block of dimensions
by block; after each one, candidates whose partial score plus the product of the remaining norms (the most that the
remaining mass can add) stays below the k-th best score so far are dropped, and the survivors are compacted. Dimensions
are taken in falling order of their mass among the candidates, so the bound tightens early.

Queries are packed into blocks in the shared folder. A task holds the candidates of its own input split and runs the
query blocks over them one after another, so its memory is one split and one block, and no row is shuffled but k rows
for each query and task. This is the stated query set against all rows, in blocks.

Vectors that are null or hold a null or a component that is not finite take no part; rows with a null id neither. Only
vectors of the query's dimension are its candidates, and a row with the query's own id is none. Scores are exact
integers; one beyond 64 bits counts in full within its task and is reported as the limit. Ties go to the smaller id; a
repeated row can be listed again. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

EXACT = float(2**53)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.select(F.col(id_col).cast("long").alias("id"), x.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def matrices(batches, scale: float, most: int):
    """(ids, matrix) of rows of one dimension each, at most ``most`` rows; components are floor(scale * x)."""
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for d in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == d)
            x = np.floor(scale * flat[(ends[at] - d)[:, None] + np.arange(d)])
            own = held.setdefault(d, ([], []))
            own[0].append(ids[at])
            own[1].append(x)
            if sum(map(len, own[0])) >= most:
                yield np.concatenate(own[0]), np.concatenate(own[1])
                held[d] = ([], [])
    for a, x in held.values():
        if a:
            yield np.concatenate(a), np.concatenate(x)


class Block:
    """Candidates in vertical layout, dimensions by falling mass."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, step: int = 8):
        self.ids, self.n, self.dim = ids, len(ids), x.shape[1]
        self.largest = float(np.abs(x).max(initial=0))
        self.by = np.argsort(-(x * x).sum(0), kind="stable")
        self.columns = np.ascontiguousarray(x[:, self.by].T)
        self.edges = [*range(0, self.dim, step), self.dim] if self.dim else [0]
        squares = np.zeros((len(self.edges), self.n))  # of the norms of the dimensions from each edge on
        for i in range(len(self.edges) - 2, -1, -1):
            part = self.columns[self.edges[i] : self.edges[i + 1]]
            squares[i] = squares[i + 1] + (part * part).sum(0)
        self.rest = np.sqrt(squares)

    def best(self, query_id: int, q: np.ndarray, k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (score, id) among ``known`` and the block's, by score, then id."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(self.dim, 1) >= EXACT:
            return self.exact(query_id, q, k, known)
        q = q[self.by]
        rest = np.sqrt(np.array([(q[e:] * q[e:]).sum() for e in self.edges]))
        alive = np.flatnonzero(self.ids != query_id)
        floor = known[k - 1][0] if len(known) >= k else None
        if floor is None and len(alive) > 8 * k:  # a first bound from a few whole scores
            some = alive[:: max(1, len(alive) // 256)]
            if len(some) >= k:
                floor = float(np.partition(q @ self.columns[:, some], -k)[-k])
        score = np.zeros(len(alive))
        for i in range(len(self.edges) - 1):
            a, b = self.edges[i], self.edges[i + 1]
            score = score + q[a:b] @ (self.columns[a:b] if len(alive) == self.n else self.columns[a:b, alive])
            if floor is not None and i + 2 < len(self.edges):
                keep = score + rest[i + 1] * self.rest[i + 1][alive] * (1 + 1e-9) + 0.5 >= floor
                if not keep.all():
                    alive, score = alive[keep], score[keep]
        if floor is not None:
            keep = score >= floor
            alive, score = alive[keep], score[keep]
        top = np.lexsort((self.ids[alive], -score))[:k]
        found = list(zip(score[top].astype(np.int64).tolist(), self.ids[alive[top]].tolist(), strict=True))
        return sorted(known + found, key=lambda r: (-r[0], r[1]))[:k]

    def exact(self, query_id: int, q: np.ndarray, k: int, known: list) -> list:
        """Without floating point, for components so large that a sum could be rounded."""
        w = [int(x) for x in q[self.by]]
        found = [(sum(a * int(c) for a, c in zip(w, self.columns[:, j], strict=True)), int(self.ids[j])) for j in range(self.n) if self.ids[j] != query_id]
        top = sorted(known + found, key=lambda r: (-r[0], r[1]))[:k]
        return top


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = 1024, candidate_block: int = 16_384) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the largest inner product for each row for which ``is_query`` holds."""
    good = usable(rows, id_col, vec_col)
    uri = shared.folder(rows.sparkSession, "topk")

    def pack(batches):
        for ids, x in matrices(batches, scale, query_block):
            name = f"{uri}/{uuid.uuid4().hex}"
            shared.save(name, [ids.astype("<i8"), x.astype("<f8").ravel()])
            yield pa.record_batch([pa.array([name]), pa.array([len(ids)], pa.int32()), pa.array([x.shape[1]], pa.int32())], names=["name", "n", "dim"])

    queries = usable(rows.where(is_query), id_col, vec_col).mapInArrow(pack, "name string, n int, dim int").collect()
    names = [(r["name"], r["n"], r["dim"]) for r in queries]

    def search(batches):
        blocks: dict[int, list[Block]] = {}
        for ids, x in matrices(batches, scale, candidate_block):
            blocks.setdefault(x.shape[1], []).append(Block(ids, x))
        for name, n, dim in names:
            if dim not in blocks:
                continue
            data = shared.read_bytes(name)
            ids, x = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<f8", offset=8 * n).reshape(n, dim)
            out: list[tuple] = []
            for query_id, q in zip(ids.tolist(), x, strict=True):
                top: list[tuple[int, int]] = []
                for block in blocks[dim]:
                    top = block.best(query_id, q, k, top)
                out += [(query_id, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for s, i in top]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

    found = good.mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
