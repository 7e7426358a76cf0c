"""Interpolated modified Kneser-Ney n-gram scores.

Counting is a Spark job; the model is a folder of sorted hash arrays that workers map into memory.

* Words are ASCII-lower-cased stretches between ASCII white space; a text ends with an end token.
* The vocabulary: the sorted 64-bit hashes of all training tokens with their counts, in shards by the leading bits. A
  word's number is its place by falling count in its shard, times the shards, plus the shard: frequent words have small
  numbers, which compress well. Shards grow in number with the input, so each stays small.
* N-grams of numbers are counted in each task, dealt by hash to shards, summed there, and written as sorted arrays of
  64-bit keys with counts of a byte; counts of 255 or more stand whole before them. From each shard's distinct n-grams go partial sums for their prefixes (total and numbers of
  successors seen once, twice, more often) and suffixes (number of predecessors, or the count after the start of a
  text) to the shards of the next lower order; no context, however common, is gathered in one place as rows.
* What moves between tasks are compressed columns: from counting, a row for each task and shard; from an order to the
  next lower one, a file for each shard in the shared folder, from which each shard below reads its part. These files
  are removed once the lower order is summed.
* Scoring finds the sorted distinct n-grams of a batch of texts in the mapped arrays. Probabilities are
  p_k(w|h) = max(c - D(c), 0)/T(h) + g(h) p_{k-1}(w|h'), below the unigrams 1/(V + 1), which leaves an unseen word its
  share; D are the closed-form discounts of counts one, two, and three or more.

Folds are chosen by the caller with a column. Nulls: a null text is an empty one, which is an end token alone; a null id
is scored like any other. An empty training set gives the uniform model. Repeated rows count each.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UNSEEN, START = 0xFFFFFFFF, 0xFFFFFFFE
HELD = 3_000_000  # tokens that a task counts before it sends
U8 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    x = (x ^ (x >> U8(30))) * U8(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U8(27))) * U8(0x94D049BB133111EB)
    return x ^ (x >> U8(31))


def key_of(cols: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams held two numbers a word; for one and two numbers it is exact."""
    return reduce(lambda h, c: mix(h ^ mix(c + U8(0x9E3779B97F4A7C15))), cols[1:], mix(cols[0]))


def joined(ids: list[np.ndarray]) -> list[np.ndarray]:
    """N-grams, given as a column of numbers for each place, two numbers a 64-bit word."""
    ids = [x.astype(U8) for x in ids]
    return [ids[i] << U8(32) | ids[i + 1] if i + 1 < len(ids) else ids[i] for i in range(0, len(ids), 2)]


def parted(cols: list[np.ndarray], n: int) -> list[np.ndarray]:
    out = []
    for i, c in enumerate(cols):
        out += [c >> U8(32), c & U8(0xFFFFFFFF)] if 2 * i + 1 < n else [c]
    return out


def packed(arrays: list[np.ndarray], level: int = 1) -> bytes:
    """Columns of unsigned words, the first one ascending, as compressed byte planes."""
    n = len(arrays[0])
    first = np.diff(arrays[0], prepend=U8(0))
    press = zstandard.ZstdCompressor(level=level).compress
    parts = [press(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(n, 8).T).data) for a in (first, *arrays[1:])]
    return b"".join([np.array([n, len(parts), *map(len, parts)], "<u8").tobytes(), *parts])


def unpacked(blob: bytes) -> list[np.ndarray]:
    n, k = np.frombuffer(blob, "<u8", 2).tolist()
    expand = zstandard.ZstdDecompressor().decompress
    sizes, at, out = np.frombuffer(blob, "<u8", k, 16).tolist(), 16 + 8 * k, []
    for s in sizes:
        planes = np.frombuffer(expand(blob[at : at + s]), np.uint8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += s
    return [np.cumsum(out[0], dtype=U8), *out[1:]]


def ordered(cols: list[np.ndarray]) -> np.ndarray:
    """The order of the rows of ``cols``: each column is sorted as one word with the rank of the columns before it."""
    order = np.argsort(cols[0])
    for c in cols[1:]:  # of less than 32 bits, as only the last one holds a single number
        first = cols[0][order]
        rank = np.cumsum(np.concatenate([[False], first[1:] != first[:-1]])).astype(U8)
        if len(cols) > 2 or c.max() >> U8(32):
            return np.lexsort(cols[::-1])
        order = order[np.argsort(rank << U8(32) | c[order])]
    return order


def summed(cols: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct rows of ``cols``, ascending, with the sums of ``values``."""
    if not len(cols[0]):
        return cols, values
    order = ordered(cols)
    cols = [c[order] for c in cols]
    at = runs(cols)
    return [c[at] for c in cols], [np.add.reduceat(v[order], at) for v in values]


def runs(cols: list[np.ndarray]) -> np.ndarray:
    """Where rows of ``cols`` begin that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]))


def grams(s: np.ndarray, order: int) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """For each length k: the distinct runs of k numbers of ``s``, a column for each place, and which one ends at each
    place of ``s`` from the k-th on."""
    word, at = np.unique(s, return_inverse=True)
    found = [([word], at)]
    for k in range(1, order):
        cols, before = found[-1]
        pair, here = np.unique(before[:-1].astype(U8) << U8(32) | at[k:].astype(U8), return_inverse=True)
        first = (pair >> U8(32)).astype(np.int64)
        found.append(([*(c[first] for c in cols), word[(pair & U8(0xFFFFFFFF)).astype(np.int64)]], here))
    return found


def dealt(cols: list[np.ndarray], values: list[np.ndarray], bits: int, by: np.ndarray | None = None, level: int = 1):
    """(shard, packed rows) of distinct ascending rows."""
    shard = ((key_of(cols) if by is None else by) >> U8(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    for s in range(1 << bits):
        if edge[s] < edge[s + 1]:
            mine = order[edge[s] : edge[s + 1]]
            yield s, packed([x[mine] for x in (*cols, *values)], level)


def rows_of(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.record_batch([pa.array([s for s, _ in pairs], pa.int32()), pa.array([b for _, b in pairs], pa.binary())], names=["shard", "blob"])


def save_parts(uri: str, sent: dict[int, list[bytes]], shards: int) -> None:
    """One file of the two blobs for each shard, behind a table of where they begin."""
    blobs = [x for s in range(shards) for x in sent.get(s, (b"", b""))]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in blobs])]).astype("<u8")
    shared.save(uri, [starts + U8(8 * len(starts)), *(np.frombuffer(x, np.uint8) for x in blobs if x)])


def load_part(uri: str, shard: int, shards: int) -> tuple[bytes, bytes]:
    a, b, c = np.frombuffer(shared.read_part(uri, 16 * shard, 24), "<u8").tolist()
    both = shared.read_part(uri, a, c - a) if c > a else b""
    return both[: b - a], both[b - a :]


WIDE = 255  # in a column of bytes: the value stands whole before the columns


def narrow(uri: str, key: np.ndarray, values: list[np.ndarray]) -> int:
    """Write a shard with columns of bytes, before them (column x rows + row) and value of those that do not fit; how many these are."""
    wide = [np.flatnonzero(v >= WIDE) for v in values]
    place = np.concatenate([w + i * len(key) for i, w in enumerate(wide)]).astype("<u8")
    whole = np.concatenate([v[w] for v, w in zip(values, wide, strict=True)]).astype("<u8")
    shared.save(uri, [place, whole, key, *(np.minimum(v, U8(WIDE)).astype("<u1") for v in values)])
    return len(place)


@dataclass
class Table:
    """Sorted keys with columns of values, in shards by the keys' leading bits; ``wide``: how many values of each shard stand whole, if any can.

    A shard is one file. Of the files, those used last stay mapped, ``shared.MAPS`` at most.
    """

    uri: str
    bits: int
    dtypes: list[str]
    sizes: list[int]
    wide: list[int] | None = None
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def shard(self, s: int) -> list[np.ndarray]:
        """Places and values that stand whole, keys, columns."""
        found = self._open.pop(s, None)
        if found is None:
            while len(self._open) >= shared.MAPS:
                self._open.pop(next(iter(self._open)))
            wide = self.wide[s] if self.wide is not None else 0
            found = shared.mapped(f"{self.uri}/{s}", ["<u8", "<u8", "<u8", *self.dtypes], [wide, wide, *[self.sizes[s]] * (1 + len(self.dtypes))])
        self._open[s] = found
        return found

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For keys in any order: each one's place or -1, and its values or zeros."""
        order = np.argsort(keys)
        keys = keys[order]
        edge = np.searchsorted(keys, np.arange(1 << self.bits, dtype=U8) << U8(64 - self.bits))
        edge, starts = np.append(edge, len(keys)), self.starts
        place, values = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.int64) for _ in self.dtypes]
        for s in np.flatnonzero(np.diff(edge)):
            mine = slice(edge[s], edge[s + 1])
            places, whole, have, *more = self.shard(int(s))
            if not len(have):
                continue
            at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
            hit = have[at] == keys[mine]
            place[order[mine]] = np.where(hit, at + starts[s], -1)
            for i, (v, m) in enumerate(zip(values, more, strict=True)):
                got = np.where(hit, m[at], 0).astype(np.int64)
                if self.wide is not None and len(wide := np.flatnonzero(got == WIDE)):
                    got[wide] = whole[np.searchsorted(places, (i * len(have) + at[wide]).astype(U8))]
                v[order[mine]] = got
        return place, values


class Numbers:
    """Places of words in a list that grows with the words met, and each one's number in a vocabulary and its count."""

    def __init__(self, vocabulary: Table, most: int = 600_000):
        self.vocabulary, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        """Forget all words but the start, which is place 0, and the end, which is place 1."""
        fresh = self.fresh = []

        class Known(dict):
            def __missing__(self, word):
                fresh.append(word)
                i = self[word] = len(self) + 1
                return i

        self.known = Known()
        self.number, self.count = np.array([START], U8), np.zeros(1, np.int64)
        self.places([b""])

    @property
    def crowded(self) -> bool:
        return len(self.known) > self.most

    def places(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.known.__getitem__, words), np.uint32, len(words))
        if self.fresh:
            hashed = np.fromiter(map(xxhash.xxh64_intdigest, self.fresh), U8, len(self.fresh))
            place, (count, rank) = self.vocabulary.find(hashed)
            bits = self.vocabulary.bits
            number = rank.astype(U8) << U8(bits) | hashed >> U8(64 - bits)
            self.number = np.concatenate([self.number, np.where(place < 0, U8(UNSEEN), number)])
            self.count = np.concatenate([self.count, count])
            self.fresh.clear()
        return out

    def stream(self, texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts' places, each with its end token, and ``order - 1`` starts before it (one at least); and how many
        tokens each has."""
        pad = max(1, order - 1)
        words, n = tokens(texts)
        own = words.dictionary_encode()
        out = np.zeros(len(words) + (pad + 1) * len(n), np.uint32)
        ends = np.cumsum(n + pad + 1) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        for j in range(pad):
            inside[ends - n - 1 - j] = False
        if len(words):
            out[inside] = self.places(own.dictionary.to_pylist())[own.indices.to_numpy()]
        out[ends] = 1
        return out, n + 1


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy(zero_copy_only=False)]))
    return words.filter(real).cast(pa.binary()), np.diff(upto[ends])


def slices(batch: pa.RecordBatch, col: int, size: int = 4 << 20):
    """(first row, texts) of parts of a batch with about ``size`` bytes."""
    texts = batch.column(col)
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield a, texts.slice(a, b - a)


def joined_batches(batches, size: int = 4 << 20):
    """The rows in batches of about ``size`` bytes, as Spark's may be small; a larger one stays."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


@dataclass
class Model:
    order: int
    vocabulary: Table
    tables: list[Table]  # of the orders from one on
    discounts: list[list[float]]  # for counts from zero to three or more
    successors: list[int]  # of the empty context: total, and distinct with counts one, two, more
    tokens: int
    types: int

    def scores(self, texts: pa.Array, numbers: Numbers) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, score."""
        s, n = numbers.stream(texts, self.order)
        at = np.flatnonzero(s)
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        count = numbers.count[s[at]]
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        p = np.full(len(at), 1 / (self.types + 1))
        total, *seen = self.successors
        for k, (cols, which) in enumerate(grams(s, self.order), 1):
            _, (c, *more) = self.tables[k - 1].find(key_of(joined([numbers.number[x] for x in cols])))
            c = c[which[at - k + 1]]
            d = np.array(self.discounts[k - 1])
            own = np.maximum(c - d[np.minimum(c, 3)], 0)
            rest = d[1] * seen[0] + d[2] * seen[1] + d[3] * seen[2]
            p = np.where(np.equal(total, 0), p, (own + rest * p) / np.maximum(total, 1))
            if k < self.order:  # what ends before a token is the context of the next order
                before = which[at - k]
                total, *seen = (v[before] for v in more)
        return n, np.add.reduceat((count > 0).astype(np.int64), begin), np.add.reduceat(base, begin), np.add.reduceat(np.log10(p), begin)


def discounts(n: list[int]) -> list[float]:
    """From the numbers of n-grams with counts one to four; where these give none between zero and the count, half of it."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    d = [i - (i + 1) * y * n[i] / max(n[i - 1], 1) for i in (1, 2, 3)]
    return [0.0, *(x if 0 < x < i else i / 2 for i, x in enumerate(d, 1))]


def _reduce(blobs: DataFrame, merge, schema: str) -> DataFrame:
    """``merge`` of (shard, blobs) for each shard."""

    def run(key, table):
        return merge(key[0].as_py(), [unpacked(b.as_py()) for b in table.column("blob")])

    return blobs.groupBy("shard").applyInArrow(run, schema)


def vocabulary(docs: DataFrame, text_col: str, uri: str, bits: int) -> tuple[Table, int]:
    """The table of the words' hashes, counts and places by count in their shard, and the number of tokens."""

    def count(batches):
        shared.lean()
        held, n, ends = [], 0, 0

        def send():
            of = pa.chunked_array(held, pa.binary()).value_counts()
            h = np.fromiter(map(xxhash.xxh64_intdigest, [b"", *of.field(0).to_pylist()]), U8, len(of) + 1)
            (h,), (c,) = summed([h], [np.concatenate([[ends], of.field(1).to_numpy()]).astype(U8)])
            return rows_of(dealt([h], [c], bits, by=h))

        for b in batches:
            for _, texts in slices(b, 0):
                held.append(tokens(texts)[0])
                n, ends = n + len(held[-1]), ends + len(texts)
                if n >= HELD:
                    yield send()
                    held, n, ends = [], 0, 0
        if ends:
            yield send()

    def merge(shard, parts):
        (h,), (c,) = summed([np.concatenate([p[0] for p in parts])], [np.concatenate([p[1] for p in parts])])
        rank = np.empty(len(h), "<u4")
        rank[np.lexsort([h, -c.astype(np.int64)])] = np.arange(len(h), dtype="<u4")
        shared.save(f"{uri}/{shard}", [h, c, rank])
        return pa.table({"shard": [shard], "n": [len(h)], "total": [int(c.sum())]})

    found = _reduce(docs.select(text_col).mapInArrow(count, "shard int, blob binary"), merge, "shard long, n long, total long").collect()
    sizes = [0] * (1 << bits)
    for r in found:
        sizes[r["shard"]] = r["n"]
    return Table(uri, bits, ["<u8", "<u4"], sizes), sum(r["total"] for r in found)


def train(docs: DataFrame, text_col: str = "text", order: int = 3, shard_bytes: int = 8 << 20, shard_tokens: int = 1_000_000) -> Model:
    """The model of the texts of ``docs``, its arrays in the shared folder: shards of about ``shard_bytes`` of input for the
    vocabulary, and of ``shard_tokens`` tokens for the n-grams."""
    shared.bounded(docs.sparkSession)
    with shared.tidy(docs.sparkSession):
        return _trained(docs, text_col, order, shard_bytes, shard_tokens)


INFO = "shard long, n long, wide long, total long, n1 long, n2 long, n3 long, n4 long, more long"


def _trained(docs: DataFrame, text_col: str, order: int, shard_bytes: int, shard_tokens: int) -> Model:
    spark = docs.sparkSession
    uri = shared.folder(spark, "lm")
    bits = min(16, max(6, (shared.input_bytes(docs) // shard_bytes).bit_length()))
    words, total = vocabulary(docs, text_col, f"{uri}/words", bits)
    types = sum(words.sizes)
    if max(words.sizes, default=0) << words.bits >= START:
        raise ValueError("more distinct words than numbers of 32 bits")
    bits = min(18, max(4, (total // shard_tokens).bit_length()))

    def count(batches):
        shared.lean()
        numbers, held, n = Numbers(words), [], 0

        def send():
            cols, which = grams(np.concatenate(held), order)[-1]
            whole = cols[-1] > 0  # others end in the padding
            times = np.bincount(which, minlength=len(whole))[whole]
            cols = joined([numbers.number[c[whole]] for c in cols])
            by = np.argsort(cols[0])
            return rows_of(dealt([c[by] for c in cols], [times[by].astype(U8)], bits))

        for b in batches:
            for _, texts in slices(b, 0):
                held.append(numbers.stream(texts, order)[0])
                n += len(held[-1])
                if n >= HELD:
                    yield send()
                    held, n = [], 0
                    if numbers.crowded:
                        numbers.clear()
        if n:
            yield send()

    def level(k: int, shard: int, cols: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        """Sum a shard of the order ``k``, write it, and write what goes down from it, packed by the shard it goes to."""
        cols, values = summed(cols, values)
        key = key_of(cols)
        by_key = np.argsort(key)
        wide = narrow(f"{uri}/{k}/{shard}", key[by_key], [v[by_key] for v in values])
        seen = values[0] > 0
        c, cols = values[0][seen], [x[seen] for x in cols]
        times = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)
        if k > 1:
            ids = parted(cols, k)
            one = np.ones(len(c), U8)
            before = one if k == 2 else np.where(ids[1] == U8(START), c, one)
            prefix = summed(joined(ids[:-1]), [c, (c == 1).astype(U8), (c == 2).astype(U8), (c >= 3).astype(U8)])
            suffix = summed(joined(ids[1:]), [before])
            sent: dict[int, list[bytes]] = {}
            for i, rows in enumerate((prefix, suffix)):
                for s, blob in dealt(*rows, bits, level=3):
                    sent.setdefault(s, [b"", b""])[i] = blob
            save_parts(f"{uri}/down-{k}/{shard}", sent, 1 << bits)
        info = [shard, len(key), wide, int(c.sum()), *times[1:5].tolist(), int((c >= 3).sum())]
        return pa.record_batch([pa.array([x], pa.int64()) for x in info], names=[x.split(" ")[0] for x in INFO.split(", ")])

    def counted(key, table):
        shared.lean()
        width = (order + 1) // 2
        parts = [unpacked(b.as_py()) for b in table.column("blob")]
        whole = [np.concatenate(x) for x in zip(*parts, strict=True)]
        del parts
        values = whole[width:] if order == 1 else [whole[width]]
        if order == 1:
            values += [np.zeros(len(whole[0]), U8)] * 4
        return pa.Table.from_batches([level(order, key[0].as_py(), whole[:width], values)])

    def gathered(k: int, sources: list[int]):
        """The shards of the order ``k`` from what the shards of the next higher order sent down."""

        def run(batches):
            shared.lean()
            width = (k + 1) // 2
            for b in batches:
                for shard in b.column(0).to_pylist():
                    sent = [load_part(f"{uri}/down-{k + 1}/{s}", shard, 1 << bits) for s in sources]
                    prefix, suffix = ([unpacked(x[i]) for x in sent if x[i]] for i in (0, 1))
                    if not prefix and not suffix:
                        continue
                    rows = [[*p[:width], np.zeros(len(p[0]), U8), *p[width:]] for p in prefix] + [[*x, *[np.zeros(len(x[0]), U8)] * 4] for x in suffix]
                    whole = [np.concatenate(x) for x in zip(*rows, strict=True)]
                    del sent, prefix, suffix, rows
                    yield level(k, shard, whole[:width], whole[width:])

        parts = min(1 << bits, max(spark.sparkContext.defaultParallelism, total // shard_tokens + 1))
        return spark.range(0, 1 << bits, 1, parts).mapInArrow(run, INFO)

    tables, all_discounts, successors, info = [], [], [0, 0, 0, 0], {}
    for k in range(order, 0, -1):
        if k == order:
            blobs = docs.select(text_col).mapInArrow(count, "shard int, blob binary")
            step = blobs.groupBy("shard").applyInArrow(counted, INFO)
        else:
            step = gathered(k, sorted(info))
        info = {r["shard"]: r for r in step.collect()}
        if k < order:
            shared.removed(spark, f"{uri}/down-{k + 1}")
        of = lambda name: [info[s][name] if s in info else 0 for s in range(1 << bits)]  # noqa: B023, E731
        tables.append(Table(f"{uri}/{k}", bits, ["<u1"] * (1 if k == order > 1 else 5), of("n"), of("wide")))
        n = {name: sum(of(name)) for name in ("total", "n1", "n2", "n3", "n4", "more")}
        all_discounts.append(discounts([n["n1"], n["n2"], n["n3"], n["n4"]]))
        successors = [n["total"], n["n1"], n["n2"], n["more"]]
    return Model(order, words, tables[::-1], all_discounts[::-1], successors, total, types)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): log10 probabilities of the whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        shared.lean()
        own = sent.value
        numbers = Numbers(own.vocabulary)
        for b in joined_batches(batches):
            for first, texts in slices(b, 1):
                if numbers.crowded:
                    numbers.clear()
                found = own.scores(texts, numbers)
                yield pa.record_batch([b.column(0).slice(first, len(texts)), *(pa.array(x) for x in found)], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    shared.bounded(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, base_score double, score double")


def perplexity(score_col: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_col / n_tokens)
