"""Vector bin packing of token sequences for training on instruction data.

A sequence has three limits at once: tokens, segments (pieces of different texts) and loss-bearing tokens. An open
sequence takes the waiting piece whose demand vector has the largest dot product with what is left of its limits, all
as shares of the limits. When nothing fits whole, a piece is cut so that the sequence is filled to the token; texts
above a sequence's size are first cut into whole sequences. A sequence is planned at a power of two below the limit
only where the pieces at hand can't fill a whole one, so that it needs no padding either.

Packing reads no other partition: each task packs what it scans, holds at most ``window`` pieces, and ends with
sequences at powers of two. There is no shuffle, and no state that grows with the input. Sequence ids join the number
of the partition with a counter, so a task that runs again on the same input gives the same ids.

Nulls: a null text is an empty one and still has its end token; a null id is kept. Repeated rows are packed each.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SCHEMA = "start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


class ChunkEncoder:
    """Token ids of texts by a tokenizer of the ``tokenizers`` library whose pre-tokenizer drops white space.

    Such a tokenizer treats stretches between ASCII white space independently, so each distinct stretch is encoded once
    and kept: the last ``most`` distinct ones at least, and at most twice as many (some 190 MB). Where it also ends each
    word's ids with a token of its own, as ``</w>`` marks it, words of Latin letters are encoded many in one call and
    told apart by that; ending punctuation is a word.
    """

    # Lower-case letters, and other symbols, that are so in every version of Unicode.
    WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?]*)")
    ASCII = re.compile(rb"([a-z]+)([.,;:!?]*)")

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.most, self.known, self.older = most, {}, {}
        apart, a, b, blanks = self.encoded(["ab cd\n\tEf.", "ab cd", "Ef.", " \t\n\x0b\x0c\r "])
        if blanks or apart != a + b or not a:
            raise ValueError("this tokenizer does not drop white space")
        spec = json.loads(self.own.to_str())
        size = max(self.own.get_vocab().values()) + 1
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        # ASCII letters may be lower-cased before, but for texts that could hold an added token
        self.lower = "Lowercase" in json.dumps(spec["normalizer"]) and all(a["content"].startswith("<|") for a in spec["added_tokens"])
        if suffix and self.lower and self.encoded(["ab", "\u00c4B", "ab ab", "ab."]) == [self.encoded(["ab"])[0], self.encoded(["\u00e4b"])[0], self.encoded(["ab"])[0] * 2, self.encoded(["ab"])[0] + self.encoded(["."])[0]]:
            self.plain = Tokenizer.from_file(path)  # for words that need no normalizing and no splitting
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in self.own.get_vocab().items() if t.endswith(suffix)]] = True

    def encoded(self, texts: list[str], by=None) -> list[bytes]:
        encode = getattr(by or self.own, "encode_batch_fast", (by or self.own).encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(texts, add_special_tokens=False)]

    def learn(self, new: set[bytes]) -> None:
        known, rest, cores, tails = self.known, [], {}, {}
        for x in new:
            m = self.ASCII.fullmatch(x) or self.WORD.fullmatch(x) if self.ends is not None else None
            if m is None:
                rest.append(x)
            else:
                core, tail = m.groups()
                cores.setdefault(core, []).append((x, tail))
                if tail:
                    tails[tail] = b""
        for some in (rest[i : i + 4096] for i in range(0, len(rest), 4096)):
            known.update(zip(some, self.encoded([x.decode("utf-8", "replace") for x in some]), strict=True))
        if tails:
            tails = dict(zip(tails, self.encoded([t.decode() for t in tails]), strict=True))
        words = list(cores)
        for some in (words[i : i + 1000] for i in range(0, len(words), 1000)):
            ids = self.encoded([b" ".join(some).decode()], self.plain)[0]
            cut = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            each = [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)] if len(cut) == len(some) else self.encoded([w.decode() for w in some])
            for core, own in zip(some, each, strict=True):
                for x, tail in cores[core]:
                    known[x] = own + tails[tail] if tail else own

    def encode(self, texts: list[str | None], after: list[int | None] | None = None) -> list[tuple[bytes, int]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and how many of them are of stretches that
        begin before the code point ``after``."""
        parts = []
        for x in texts:
            x = (x or "").encode("utf-8", "replace")
            parts.append((x.lower() if self.lower and b"<|" not in x else x).split())
        get = self.known.get
        found = [list(map(get, p)) for p in parts]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else () for f in found]
        new = {p[i] for p, gap in zip(parts, gaps, strict=True) for i in gap}
        if new:
            if len(self.known) + len(new) > self.most:
                self.older, self.known = self.known, {}
            known, older = self.known, self.older
            known.update([(w, older[w]) for w in new if w in older])
            self.learn(new.difference(known))
            for p, f, gap in zip(parts, found, gaps, strict=True):
                for i in gap:
                    f[i] = known[p[i]]
        if after is None:
            return [(b"".join(f), 0) for f in found]
        before = [len((x or "")[:k].encode("utf-8", "replace").split()) if k and k > 0 else 0 for x, k in zip(texts, after, strict=True)]
        return [(b"".join(f), sum(map(len, f[:k])) // 4) for f, k in zip(found, before, strict=True)]


@lru_cache(1)
def chunk_encoder(path: str, most: int) -> ChunkEncoder:
    """One for each worker, as tasks meet much the same words."""
    return ChunkEncoder(path, most)


shared.caches["packing"] = chunk_encoder.cache_clear


class Packer:
    """Packs pieces as they come; ``add`` and ``close`` return rows (key, start, length, doc_tokens, loss_tokens, sequence, offset, ids)."""

    def __init__(self, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, window: int = 128):
        self.cap, self.segments, self.loss, self.window = max_tokens, max_segments, max_loss or max_tokens, window
        self.items: list[tuple] = []  # key, ids of the whole text, its tokens, index of its first loss-bearing token
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.sequence = 0

    def bearing(self, start, length, first):
        """Loss-bearing tokens of a piece: those from ``first`` on."""
        return np.maximum(0, start + length - np.maximum(start, first))

    def add(self, key, ids: bytes, first: int = 0) -> list[tuple]:
        n, rows, at = len(ids) // 4, [], 0
        while n - at >= self.cap and self.bearing(at, self.cap, first) <= self.loss:
            rows.append((key, at, self.cap, n, int(self.bearing(at, self.cap, first)), self.sequence, 0, ids[4 * at : 4 * (at + self.cap)]))
            self.sequence += 1
            at += self.cap
        if at < n:
            self.items.append((key, ids, n, first))
            self.start, self.length, self.first = np.append(self.start, at), np.append(self.length, n - at), np.append(self.first, first)
        if len(self.items) >= self.window:
            while len(self.items) > self.window // 2:
                rows += self.fill()
        return rows

    def close(self) -> list[tuple]:
        rows = []
        while self.items:
            rows += self.fill()
        return rows

    def fill(self) -> list[tuple]:
        """One sequence."""
        most = int(np.sort(self.length)[-self.segments :].sum())
        left = cap = min(self.cap, 1 << (most.bit_length() - 1)) if most < self.cap else self.cap
        segments, loss, rows = self.segments, self.loss, []
        while left and segments and self.items:
            demand = self.bearing(self.start, self.length, self.first)
            fits = (self.length <= left) & (demand <= loss)
            if segments == 1 and (self.length >= left).any():
                fits &= self.length == left
            if fits.any():
                dot = self.length / self.cap * (left / self.cap) + segments / self.segments**2 + demand / self.loss * (loss / self.loss)
                i, take = int(np.argmax(np.where(fits, dot, -1.0))), None
            else:  # cut the longest piece to what is left of both limits
                room = np.minimum(left, np.maximum(0, self.first - self.start) + loss)
                take = np.minimum(room, self.length)
                i = int(np.argmax(take))
            n = int(self.length[i] if take is None else take[i])
            if n <= 0:
                break
            key, ids, total, first = self.items[i]
            at = int(self.start[i])
            bears = int(self.bearing(at, n, first))
            rows.append((key, at, n, total, bears, self.sequence, cap - left, ids[4 * at : 4 * (at + n)]))
            left, segments, loss = left - n, segments - 1, loss - bears
            if n == self.length[i]:
                keep = np.arange(len(self.items)) != i
                self.start, self.length, self.first = self.start[keep], self.length[keep], self.first[keep]
                del self.items[i]
            else:
                self.start[i] += n
                self.length[i] -= n
        self.sequence += 1
        return rows


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", loss_after: Column | None = None, max_tokens: int = 4096, max_segments: int = 256, max_loss: int | None = None, window: int = 128, kept: int = 700_000) -> DataFrame:
    """Rows (id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids): pieces of the texts' ids, ``end_id``
    after each text.

    ``loss_after``: how many code points of a text, as a prompt before a response, bear no loss (null, below one, or not
    given: none); a stretch that it cuts bears none, the end token always does. ``ids`` is binary, little-endian unsigned 32-bit integers. ``kept`` bounds the encoded stretches that
    a worker keeps: memory against time, not results.
    """
    end = np.array([end_id], "<u4").tobytes()
    cols = [F.col(id_col), F.col(text_col), *([] if loss_after is None else [loss_after.cast("long").alias("_after")])]
    prompts, kind = loss_after is not None, docs.schema[id_col].dataType.simpleString()
    types = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def packed(batches):
        encoder, packer = chunk_encoder(tokenizer, kept), Packer(max_tokens, max_segments, max_loss, window)
        base = TaskContext.get().partitionId() << 40

        def batch(rows, like):
            key, *rest = zip(*rows, strict=True)
            rest[4] = [base + s for s in rest[4]]
            return pa.record_batch([pa.array(key, like), *(pa.array(x, f.type) for x, f in zip(rest, types, strict=True))], names=[id_col, *types.names])

        like, rows = None, []
        for b in batches:
            like = b.column(0).type
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                coded = encoder.encode(part.column(1).to_pylist(), part.column(2).to_pylist() if prompts else None)
                for key, (ids, first) in zip(part.column(0).to_pylist(), coded, strict=True):
                    rows += packer.add(key, ids + end, first)
                if len(rows) >= 1000:
                    yield batch(rows, like)
                    rows = []
        rows += packer.close()
        if rows:
            yield batch(rows, like)

    shared.bounded(docs.sparkSession)

    def run(batches):
        shared.lean("packing")
        gc.disable()  # what is kept has no cycles, and looking for them takes long
        try:
            yield from packed(batches)
        finally:
            gc.enable()

    return docs.select(*cols).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
