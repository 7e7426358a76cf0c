"""Byte-level BPE by a tokenization automaton.

The automaton runs over tokens. It starts with one state on which every byte loops. Each merge of u and v into w is
one gadget: the arcs of u are led to a new state, a copy of their target without the arc of v; wherever u can go, w
may go too, to where v went. What paths remain are the tokenizations that BPE gives, so a text has one path, and so
has each of its prefixes.

A gadget changes the target of a single token, so a token has one state that it leads to; tokens share a state until a
gadget copies it. The finished automaton is compiled, once for a file, to tables of whole numbers:

* Tokens are numbered so that those that begin with v, by merges after a time, stand in a row. A state's missing arcs are
  then a few runs of these numbers, and its transitions are the sorted ends of the runs: a token has an arc if an even
  number of them lies at or below its own.
* The bytes go through the matching automaton of all labels (arcs by byte, links to the longest proper suffix), whose
  nodes name the longest token that ends there; each token names the next shorter one.

A pre-split word is encoded by table lookups: for each end the token is found that ends there and that the state at its
start has an arc for. Decoding emits the labels of the arcs.

The files are those of the ``tokenizers`` library: byte-level pre-splitting, added tokens matched first. Nulls: a null
text is an empty one. Repeated rows are encoded each; an empty table gives an empty result. Ids are little-endian unsigned
32-bit integers.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# The pre-splitting pattern of byte-level BPE files, and the characters on which Unicode versions agree.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSETTLED = re.compile("[^\x00-\x1b\x20-ԯḀ-῿‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]")

BITS = 20
END = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable Latin-1 itself, then from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        letter = byte_letters()
        if len(vocab) >= 1 << BITS:
            raise ValueError("the vocabulary is too large for the table's keys")
        self.label = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        n = max(vocab.values()) + 1
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.removed: dict[int, int] = {}  # token u and token v: the merge that took the arc of v from where u leads
        copies: list[tuple[int, int, int]] = [(-1, -1, -1)]  # states: copied from, without the arc of, by the merge
        target = [0] * n
        made: set[int] = set()
        for k, (a, b) in enumerate(merges):
            u, v = vocab[a], vocab[b]
            w = vocab[a + b]
            if w in made or self.born[w] >= 0 or len(self.label[w]) < 2:
                raise ValueError(f"two merges make {a + b!r}")
            made.add(w)
            if self.open(u, v):  # else the gadget finds no arc to split
                self.born[w], self.left[w], self.right[w] = k, u, v
                self.removed[u << BITS | v] = k
                target[w] = target[v]
                copies.append((target[u], v, k))
                target[u] = len(copies) - 1
        single = {i for i, b in self.label.items() if len(b) == 1}
        self.token = {b: i for i, b in self.label.items() if i in single or self.born[i] >= 0}
        self.compile(copies, target)
        self.match()

    def open(self, x: int, t: int) -> bool:
        """While the automaton is built: has the state that token ``x`` leads to an arc for ``t``, after the gadgets so far?

        The state's removals are those at x since it was made, those at x's right part before, and so on. The arc is
        there if that of t's left part was when t was made, and it was not removed since; and so on.
        """
        while_t = END
        while True:
            a, until = x, END
            while True:
                k = self.removed.get(a << BITS | t)
                if k is not None and k < until and k <= while_t:
                    return False
                if self.born[a] < 0:
                    break
                a, until = self.right[a], self.born[a]
            if self.born[t] < 0:
                return True
            t, while_t = self.left[t], self.born[t]

    def compile(self, copies: list[tuple[int, int, int]], target: list[int]) -> None:
        """The tables of the states that tokens lead to at the end: ``state``, ``place``, ``first``, ``bounds``."""
        children: dict[int, list[int]] = {}
        for t in sorted(self.token.values(), key=lambda t: -self.born[t]):  # the youngest first
            if self.born[t] >= 0:
                children.setdefault(self.left[t], []).append(t)
        n = len(self.born)
        self.place, upto, count = [0] * n, [0] * n, 0
        stack = [t for t in self.token.values() if self.born[t] < 0]
        while stack:
            t = stack.pop()
            if t < 0:
                upto[~t] = count
                continue
            self.place[t] = count
            count += 1
            stack.append(~t)
            stack += reversed(children.get(t, ()))
        run: list[tuple[int, int]] = [(0, 0)]  # of each copied state: the places whose arcs it lost
        for _, v, k in copies[1:]:
            older = [c for c in children.get(v, ()) if self.born[c] >= k]
            run.append((self.place[v], upto[older[-1]] if older else self.place[v] + 1))
        number: dict[int, int] = {}
        self.state, self.first, self.bounds = [0] * n, array("q", [0]), array("q")
        for t in self.token.values():
            s = target[t]
            if s not in number:
                number[s] = len(number)
                runs = []
                while s:
                    runs.append(run[s])
                    s = copies[s][0]
                end = -1
                for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):  # runs lie in each other or apart
                    if b > end:
                        if a == end:
                            self.bounds[-1] = b
                        else:
                            self.bounds.extend((a, b))
                        end = b
                self.first.append(len(self.bounds))
            self.state[t] = number[target[t]]

    def match(self) -> None:
        """The matching automaton of the labels: ``step``, ``fail``, ``longest``, ``shorter``, ``size``."""
        self.step, labels = {}, [b""]
        for b in sorted(self.token):
            node = 0
            for i, x in enumerate(b):
                key = node << 8 | x
                node = self.step.setdefault(key, len(labels))
                if node == len(labels):
                    labels.append(b[: i + 1])
        self.fail, self.longest = [0] * len(labels), [-1] * len(labels)
        self.shorter, self.size = [-1] * len(self.born), [0] * len(self.born)
        place = {b: i for i, b in enumerate(labels)}
        for b in sorted(labels[1:], key=len):
            node = place[b]
            if len(b) > 1:
                self.fail[node] = self.after(self.fail[place[b[:-1]]], b[-1])
            below = self.longest[self.fail[node]]
            t = self.token.get(b)
            if t is None:
                self.longest[node] = below
            else:
                self.longest[node], self.shorter[t], self.size[t] = t, below, len(b)

    def after(self, node: int, x: int) -> int:
        step, fail = self.step, self.fail
        while (more := step.get(node << 8 | x)) is None:
            if not node:
                return 0
            node = fail[node]
        return more

    def arc(self, x: int, t: int) -> bool:
        """Has the state that token ``x`` leads to an arc for ``t``?"""
        s = self.state[x]
        a = self.first[s]
        return not (bisect_right(self.bounds, self.place[t], a, self.first[s + 1]) - a) & 1

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        if (t := self.token.get(word)) is not None:
            return [t]  # the start state has an arc for each token
        step, fail, longest, shorter, size = self.step, self.fail, self.longest, self.shorter, self.size
        state, place, first, bounds = self.state, self.place, self.first, self.bounds
        last, node = [-1], 0
        for j, x in enumerate(word, 1):
            while (more := step.get(node << 8 | x)) is None and node:
                node = fail[node]
            node = more or 0
            t = longest[node]
            while i := j - size[t]:
                s = state[last[i]]
                a = first[s]
                if not (bisect_right(bounds, place[t], a, first[s + 1]) - a) & 1:
                    break
                t = shorter[t]
            last.append(t)
        out, j = [], len(word)
        while j:
            out.append(last[j])
            j -= size[last[j]]
        return out[::-1]


class Coder:
    """Encodes and decodes texts; keeps the ids of up to ``most`` pre-split words."""

    def __init__(self, path: str, most: int = 500_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model.get("ignore_merges"):
            raise ValueError("this is not a plain byte-level BPE file")
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with options are not known here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton({t: i for t, i in model["vocab"].items() if t not in added}, merges)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(PATTERN)
        self.slow = None
        labels = self.automaton.label | {i: t.encode() for t, i in added.items()}
        self.labels = [labels.get(i, b"") for i in range(max(labels) + 1)]
        encode = self.automaton.encode

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= most:
                    self.clear()
                ids = self[word] = np.array(encode(word.encode()), "<u4").tobytes()
                return ids

        self.known = Known()

    def words(self, text: str) -> list[str]:
        if UNSETTLED.search(text) is None:
            return self.split.findall(text)
        if self.slow is None:
            from tokenizers import pre_tokenizers

            self.slow = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self.slow.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> bytes:
        get = self.known.__getitem__
        if self.cut is None or self.cut.search(text or "") is None:
            return b"".join(map(get, self.words(text or "")))
        return b"".join(self.added[x] if i % 2 else b"".join(map(get, self.words(x))) for i, x in enumerate(self.cut.split(text)) if x)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def coder(path: str) -> Coder:
    """One for each file and worker."""
    return Coder(path)


shared.caches["bpe"] = coder.cache_clear


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids binary), and with ``decoded`` the text that decoding the ids gives."""
    kind = docs.schema[id_col].dataType.simpleString()

    shared.bounded(docs.sparkSession)

    def run(batches):
        shared.lean("bpe")
        own = coder(path)
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                ids = [own.encode(x.as_py()) for x in b.column(1)]
                more = [pa.array([own.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), *more], names=[id_col, "ids", *["decoded"] * decoded])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string) of binary ids; null ids are no ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        own = coder(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([own.decode(x.as_py() or b"") for x in b.column(1)], pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded string")
