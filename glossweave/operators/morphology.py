"""Morphological parsing and generation of single words, and its operators over DataFrames.

A grammar is a frozen object that is built once and broadcast; a word is parsed within a budget of steps and always
gives a row. Analysis undoes phonological rules, then affixes and compounds, and looks the rest up; each candidate is
confirmed by deriving it forward and comparing the surface. The search is inherently recursive and per word, so it runs
in Python over Arrow batches; everything before and after is columns.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field, replace
from itertools import product
from time import perf_counter_ns

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Shape = tuple[str, ...]
GUESSED = "*"


class Budget(Exception):
    """The word's steps are used up."""


@dataclass
class Work:
    most: int
    used: int = 0

    def step(self, n: int = 1) -> None:
        self.used += n
        if self.used > self.most:
            raise Budget


def nfd(x: str) -> str:
    return unicodedata.normalize("NFD", x)


class SegmentError(ValueError):
    def __init__(self, position: int):
        super().__init__(f"no segment at {position}")
        self.position = position


def segment(word: str, segments: frozenset[str], boundaries: frozenset[str] = frozenset()) -> Shape:
    """Greedy longest match over the NFD form; boundaries are dropped. The error's position is in the text as given."""
    text, out, i = nfd(word), [], 0
    longest = max(map(len, segments | boundaries), default=1)
    while i < len(text):
        for n in range(min(longest, len(text) - i), 0, -1):
            part = text[i : i + n]
            if part in segments or part in boundaries:
                if part in segments:
                    out.append(part)
                i += n
                break
        else:
            raise SegmentError(next(k for k in range(len(word) + 1) if len(nfd(word[: k + 1])) > i))
    return tuple(out)


@dataclass(frozen=True)
class Environment:
    """What must stand next to a span: one set of segments for each place, and word edges."""

    left: tuple[frozenset[str], ...] = ()
    right: tuple[frozenset[str], ...] = ()
    at_start: bool = False
    at_end: bool = False

    def holds(self, shape: Shape, start: int, end: int) -> bool:
        n, m = len(self.left), len(self.right)
        if start < n or len(shape) - end < m or self.at_start and start != n or self.at_end and len(shape) - end != m:
            return False
        return all(s in c for s, c in zip(shape[start - n : start], self.left, strict=True)) and all(s in c for s, c in zip(shape[end : end + m], self.right, strict=True))


ANYWHERE = Environment()


@dataclass(frozen=True)
class Rewrite:
    """``source`` becomes ``target`` in the environment. Iterative rules see what they have changed; simultaneous ones
    match everything on the input first."""

    name: str
    source: Shape
    target: Shape
    where: Environment = ANYWHERE
    simultaneous: bool = False
    leftward: bool = False
    most_inserted: int = 256

    def apply(self, shape: Shape) -> Shape:
        n = len(self.source)
        fits = lambda s, i: s[i : i + n] == self.source and self.where.holds(s, i, i + n)
        if self.simultaneous:
            out, i = [], 0
            while i <= len(shape):
                if fits(shape, i):
                    out += self.target
                    if n == 0 and i < len(shape):
                        out.append(shape[i])
                    i += max(n, 1)
                elif i < len(shape):
                    out.append(shape[i])
                    i += 1
                else:
                    break
            return tuple(out)
        i, grown = (len(shape) - n if self.leftward else 0), 0
        while 0 <= i <= len(shape) - n:
            if fits(shape, i) and grown <= self.most_inserted:
                shape = shape[:i] + self.target + shape[i + n :]
                grown += max(0, len(self.target) - n)
                i += -1 if self.leftward else max(len(self.target), 1) + (n == 0)
            else:
                i += -1 if self.leftward else 1
        return shape

    def undo(self, shape: Shape, work: Work) -> set[Shape]:
        """All inputs that could have given ``shape``: at each place where the target stands it may be the source's."""
        places = [i for i in range(len(shape) - len(self.target) + 1) if shape[i : i + len(self.target)] == self.target] if self.target else list(range(len(shape) + 1))
        found = {shape}
        for i in reversed(places):
            for s in list(found):
                work.step()
                if s[i : i + len(self.target)] == self.target:
                    found.add(s[:i] + self.source + s[i + len(self.target) :])
        return {s for s in found if self.apply(s) == shape}


@dataclass(frozen=True)
class Metathesis:
    """Segments of ``first`` and ``second`` next to each other change places."""

    name: str
    first: frozenset[str]
    second: frozenset[str]

    def apply(self, shape: Shape) -> Shape:
        out, i = list(shape), 0
        while i + 1 < len(out):
            if out[i] in self.first and out[i + 1] in self.second:
                out[i], out[i + 1] = out[i + 1], out[i]
                i += 1
            i += 1
        return tuple(out)

    def undo(self, shape: Shape, work: Work) -> set[Shape]:
        found = {shape}
        for i in range(len(shape) - 1):
            for s in list(found):
                work.step()
                if s[i] in self.second and s[i + 1] in self.first:
                    found.add(s[:i] + (s[i + 1], s[i]) + s[i + 2 :])
        return {s for s in found if self.apply(s) == shape}


@dataclass(frozen=True)
class Affix:
    """A morpheme that attaches: prefix, suffix, circumfix (both parts), infix after ``after`` segments, reduplication of
    the first ``copies`` segments, truncation of the last ``cuts``."""

    name: str
    prefix: Shape = ()
    suffix: Shape = ()
    infix: Shape = ()
    after: int = 0
    copies: int = 0
    cuts: int = 0
    where: Environment | None = None  # of the stem's edge at which it attaches
    takes: frozenset[str] = frozenset()  # categories; none is any
    gives: str | None = None
    requires: frozenset[str] = frozenset()
    excludes: frozenset[str] = frozenset()
    adds: frozenset[str] = frozenset()
    slot: str | None = None
    realizes: tuple[tuple[str, int], ...] = ()  # features and the bits of the symbols that they may have

    def unified(self, features: dict[str, int]) -> dict[str, int] | None:
        """The word's features with those that this realizes, or None if they contradict each other."""
        both = {**features, **{f: features.get(f, b) & b for f, b in self.realizes}}
        return both if all(both[f] for f, _ in self.realizes) else None

    def serves(self, target: dict[str, int]) -> bool:
        """Whether all that this realizes is asked for: it subsumes the target."""
        return all(f in target and target[f] & ~b == 0 for f, b in self.realizes)

    def fits(self, stem: Shape, category: str, features: frozenset[str]) -> str | None:
        """Why it does not attach, or None."""
        if self.takes and category not in self.takes:
            return "category"
        if not self.requires <= features:
            return "required"
        if self.excludes & features:
            return "excluded"
        at = len(stem) if self.suffix or self.cuts else 0
        return "environment" if self.where and not self.where.holds(stem, at, at) else None

    def apply(self, stem: Shape) -> Shape | None:
        if len(stem) < max(self.after, self.copies, self.cuts + 1):
            return None
        core = stem[: len(stem) - self.cuts] if self.cuts else stem
        if self.infix:
            core = core[: self.after] + self.infix + core[self.after :]
        return self.prefix + core[: self.copies] + core + self.suffix

    def moved(self, start: int, end: int) -> tuple[int, int]:
        """Where a span of the stem stands after this; one that an infix splits is as long as its parts reach."""
        by, n = len(self.prefix) + self.copies, len(self.infix)
        return start + by + n * (n > 0 and start >= self.after), end + by + n * (n > 0 and end > self.after)

    def undo(self, shape: Shape, segments: tuple[str, ...], work: Work) -> set[Shape]:
        p, s, r = len(self.prefix), len(self.suffix), self.copies
        if len(shape) < p + s + 1 or shape[:p] != self.prefix or shape[len(shape) - s :] != self.suffix:
            return set()
        core = shape[p : len(shape) - s]
        if r:
            if core[:r] != core[r : 2 * r]:
                return set()
            core = core[r:]
        if self.infix:
            end = self.after + len(self.infix)
            if core[self.after : end] != self.infix:
                return set()
            core = core[: self.after] + core[end:]
        if not self.cuts:
            return {core}
        found = set()
        for tail in product(segments, repeat=self.cuts):
            work.step()
            found.add(core + tail)
        return found


@dataclass(frozen=True)
class Root:
    name: str
    shapes: tuple[Shape, ...]  # allomorphs; an earlier one that fits excludes later ones
    category: str
    where: tuple[Environment | tuple[Environment, ...] | None, ...] = ()  # of several, one must hold
    features: frozenset[str] = frozenset()
    bound: bool = False
    barred: tuple[tuple[Environment, ...] | None, ...] = ()  # of each allomorph: none may hold
    structure: tuple[tuple[str, int], ...] = ()  # its own features and the bits of their symbols

    def stands(self, k: int, shape: Shape, start: int, end: int) -> bool:
        """Whether the k-th allomorph may stand there."""
        where, barred = self.where[k] if k < len(self.where) else None, self.barred[k] if k < len(self.barred) else None
        some = (where,) if isinstance(where, Environment) else where or ()
        return (not some or any(e.holds(shape, start, end) for e in some)) and not any(e.holds(shape, start, end) for e in barred or ())

    def conditioned(self, k: int) -> bool:
        return bool(k < len(self.where) and self.where[k])


@dataclass(frozen=True)
class Cooccurrence:
    """``primary`` requires, or excludes, all of ``others`` in the word, anywhere or next to it."""

    primary: str
    others: tuple[str, ...]
    excludes: bool = True
    adjacency: str = "anywhere"  # left, right: somewhere there; next_left, next_right: at once there

    def holds(self, morphs: tuple[str, ...]) -> bool:
        def found(i: int, o: str) -> bool:
            if self.adjacency == "anywhere":
                return o in morphs
            if self.adjacency == "left":
                return o in morphs[:i]
            if self.adjacency == "right":
                return o in morphs[i + 1 :]
            j = i - 1 if self.adjacency == "next_left" else i + 1
            return 0 <= j < len(morphs) and morphs[j] == o

        return all(all(found(i, o) for o in self.others) != self.excludes for i, m in enumerate(morphs) if m == self.primary)


@dataclass(frozen=True)
class Grammar:
    segments: frozenset[str]
    roots: tuple[Root, ...]
    affixes: tuple[Affix, ...] = ()
    phonology: tuple = ()  # in order of synthesis
    templates: tuple[tuple[tuple[str, bool], ...], ...] = ()  # slots from the inside out, optional or not
    compounds: tuple[tuple[str, str, str], ...] = ()  # categories of the two parts and of the whole
    prohibitions: tuple[Cooccurrence, ...] = ()
    patterns: tuple = ()  # of roots that may be guessed: a set of segments for each place, or what ``accepts`` shapes
    boundaries: frozenset[str] = frozenset()
    most_affixes: int = 5
    most_stems: int = 2


@dataclass(frozen=True)
class Analysis:
    roots: tuple[str, ...]
    affixes: tuple[str, ...]  # in the order in which they attach
    category: str
    surface: str
    guessed: bool = False

    @property
    def signature(self) -> str:
        return "+".join([*self.roots, *self.affixes]) + "|" + self.surface


@dataclass
class Result:
    status: str
    analyses: list[Analysis]
    work: int
    trace: list[tuple[int, int | None, str, str, str | None]] = field(default_factory=list)
    partials: list[tuple] = field(default_factory=list)

    @property
    def signature(self) -> str:
        return ";".join(sorted(a.signature for a in self.analyses)) or "-"


class Engine:
    """A grammar with its indexes; roots that are supplied later lie over it."""

    def __init__(self, grammar: Grammar, supplied: tuple[Root, ...] = ()):
        given = {r.name for r in supplied}
        self.g = replace(grammar, roots=tuple(r for r in grammar.roots if r.name not in given) + supplied)
        self.by_shape: dict[Shape, list[Root]] = {}
        for r in self.g.roots:
            for s in r.shapes:
                self.by_shape.setdefault(s, []).append(r)
        self.affix = {a.name: a for a in self.g.affixes}
        self.root = {r.name: r for r in self.g.roots}
        self.sorted = tuple(sorted(self.g.segments))

    def surface(self, shape: Shape) -> Shape:
        for rule in self.g.phonology:
            shape = rule.apply(shape)
        return shape

    def stems(self, roots: tuple[Root, ...]) -> list[tuple[Shape, str, frozenset[str], tuple]]:
        """Concatenations of the roots' allomorphs with category, features and each root's (allomorph, start, end)."""
        found = [((), None, frozenset(), ())]
        for r in roots:
            more = []
            for shape, category, features, spans in found:
                whole = r.category if category is None else next((w for a, b, w in self.g.compounds if a == category and b == r.category), None)
                if whole is not None:
                    more += [(shape + s, whole, features | r.features, (*spans, (k, len(shape), len(shape) + len(s)))) for k, s in enumerate(r.shapes)]
            found = more
        return found

    def derive(self, roots: tuple[Root, ...], affixes: tuple[Affix, ...], work: Work, tell=lambda kind, source, reason=None: None, target: dict[str, int] | None = None) -> list[tuple[Shape, str]]:
        """Surface shapes of the morphemes, with the category; rejected derivations are left out. ``tell`` hears each step and
        why a derivation ends. What affixes realize must unify with the word's features, and with a ``target`` be asked
        for by it."""
        whole = "+".join([*(r.name for r in roots), *(a.name for a in affixes)])
        if any(a.slot for a in affixes):
            ok = self.slots_ok(affixes)
            tell("template_synthesis", whole, None if ok else "slots")
            if not ok:
                return []
        if any(r.bound for r in roots) and not affixes and len(roots) == 1:
            tell("failed", whole, "bound_root")
            return []
        names = tuple(r.name for r in roots) + tuple(a.name for a in affixes)
        if not all(p.holds(names) for p in self.g.prohibitions):
            tell("failed", whole, "co_occurrence")
            return []
        out, stems = [], self.stems(roots)
        if len(roots) > 1:
            tell("compounding_rule_synthesis", whole, None if stems else "category")
        for shape, category, features, spans in stems:
            work.step()
            structure = dict(x for r in roots for x in r.structure)
            for a in affixes:
                why = a.fits(shape, category, features)
                if why is None and a.realizes:
                    structure = a.unified(structure)
                    why = "features" if structure is None else None if target is None or a.serves(target) else "not_asked_for"
                if why is None and (shape := a.apply(shape)) is None:
                    why = "too_short"
                tell("morphological_rule_synthesis", a.name, why)
                if why is not None:
                    break
                category, features = a.gives or category, features | a.adds
                spans = tuple((k, *a.moved(b, e)) for k, b, e in spans)
            else:
                if all(self.allomorph_ok(r, k, shape, b, min(e, len(shape))) for r, (k, b, e) in zip(roots, spans, strict=True)):
                    surface = self.surface(shape)
                    if self.g.phonology:
                        tell("phonological_rule_synthesis", "".join(surface), None if surface != shape else "unchanged")
                    out.append((surface, category))
                else:
                    tell("failed", whole, "allomorph")
        return out

    def allomorph_ok(self, root: Root, k: int, whole: Shape, start: int, end: int) -> bool:
        """The chosen allomorph may stand at its span of the whole, and no earlier one that has conditions may."""
        return root.stands(k, whole, start, end) and not any(root.conditioned(j) and root.stands(j, whole, start, end) for j in range(k))

    def slots_ok(self, affixes: tuple[Affix, ...]) -> bool:
        """Affixes of slots stand in the order of one template, none twice, and required slots are filled."""
        slots = [a.slot for a in affixes if a.slot]
        if not self.g.templates:
            return True
        if not slots:
            return True
        for t in self.g.templates:
            names = [n for n, _ in t]
            if all(s in names for s in slots) and [names.index(s) for s in slots] == sorted({names.index(s) for s in slots}) and all(o or n in slots for n, o in t):
                return True
        return False

    def parse(self, word: str, most: int = 100_000, guess: bool = False, trace: bool = False, partials: int = 0) -> Result:
        """The word's analyses; ``partials``: how many of the first candidates that failed are told, with the reason."""
        work, events, failed = Work(most), [], []

        def tell(parent, kind, source, reason=None):
            if trace:
                events.append((len(events), parent, kind, source, reason))
            return len(events) - 1

        top = tell(None, "word_analysis", word)
        try:
            shape = segment(word, self.g.segments, self.g.boundaries)
        except SegmentError as e:
            tell(top, "failed", word, f"segment:{e.position}")
            return Result("SKIPPED", [], 0, events)
        found: set[Analysis] = set()
        try:
            deep = {shape}
            for rule in reversed(self.g.phonology):
                deep = {s for x in deep for s in rule.undo(x, work)}
                tell(top, "phonological_rule_analysis", rule.name)
            tried: set[tuple] = set()
            states: set[tuple] = set()
            possible = self.possible(deep)
            stack = [(s, (), top) for s in sorted(deep)]
            while stack:
                now, trail, node = stack.pop()
                work.step()
                state = (now, tuple(a.name for a in trail))
                if state in states:  # other ways led here already
                    continue
                states.add(state)
                for roots in self.lookup(now, work, guess and not found):
                    key = (tuple(r.name for r in roots), tuple(a.name for a in trail))
                    if key in tried:
                        continue
                    tried.add(key)
                    here = tell(node, "lexical_lookup", "+".join(key[0]))
                    reasons = []

                    def hear(kind, source, reason=None, here=here, reasons=reasons):
                        tell(here, kind, source, reason)
                        if reason not in (None, "unchanged"):
                            reasons.append(reason)

                    made = self.derive(roots, trail, work, hear) if trace or partials else self.derive(roots, trail, work)
                    results = [c for s, c in made if s == shape]
                    why = None if results else "surface_mismatch" if made else reasons[-1] if reasons else "category"
                    if not results and len(failed) < partials:
                        failed.append((*key, why))
                    tell(here, "successful" if results else "failed", "+".join(key[0] + key[1]), why)
                    found |= {Analysis(*key, category=c, surface=word, guessed=roots[0].name.startswith(GUESSED)) for c in results}
                if len(trail) < self.g.most_affixes:
                    for a in possible:
                        for s in sorted(a.undo(now, self.sorted, work)):
                            work.step()
                            stack.append((s, (a, *trail), tell(node, "morphological_rule_analysis", a.name)))
        except Budget:
            tell(top, "failed", word, "budget")
            return Result("CAP", sorted(found, key=lambda a: a.signature), work.used, events, failed)
        if any(not a.guessed for a in found):
            found = {a for a in found if not a.guessed}
        return Result("ok", sorted(found, key=lambda a: (a.signature, a.category)), work.used, events, failed)

    def possible(self, shapes: set[Shape]) -> list[Affix]:
        """The affixes that a word with one of these underlying shapes can have: all that an affix inserts must be in it,
        and where slots are required, each must have such an affix in one of the templates that its own slot is in."""
        here = [frozenset(s) for s in shapes]
        cut = any(a.cuts for a in self.g.affixes)  # then what one affix inserts another may take away
        some = [a for a in self.g.affixes if cut or any(i.issuperset(a.prefix + a.infix + a.suffix) for i in here)]
        if not self.g.templates:
            return some
        filled = {a.slot for a in some if a.slot}
        open_ = {n for t in self.g.templates if all(o or n in filled for n, o in t) for n, _ in t}
        return [a for a in some if not a.slot or a.slot in open_]

    def lookup(self, shape: Shape, work: Work, guess: bool) -> list[tuple[Root, ...]]:
        found = [(r,) for r in self.by_shape.get(shape, [])]
        if self.g.compounds:
            for i in range(1, len(shape)):
                work.step()
                found += [(a, *rest) for a in self.by_shape.get(shape[:i], []) for rest in self.parts(shape[i:], self.g.most_stems - 1, work)]
        if guess and not found and any(p.accepts(shape) if hasattr(p, "accepts") else len(p) == len(shape) and all(s in c for s, c in zip(shape, p, strict=True)) for p in self.g.patterns):
            found.append((Root(f"{GUESSED}{''.join(shape)}{GUESSED}", (shape,), "?"),))
        return found

    def parts(self, shape: Shape, most: int, work: Work) -> list[tuple[Root, ...]]:
        found = [(r,) for r in self.by_shape.get(shape, [])]
        if most > 1:
            for i in range(1, len(shape)):
                work.step()
                found += [(a, *rest) for a in self.by_shape.get(shape[:i], []) for rest in self.parts(shape[i:], most - 1, work)]
        return found

    def generate(self, roots: list[str], affixes: list[str], most: int = 100_000, target: dict[str, int] | None = None) -> list[str]:
        """Surface forms of morphemes; none if one is unknown or they do not combine, or realize what ``target`` does not ask for."""
        if not all(r in self.root for r in roots) or not all(a in self.affix for a in affixes):
            return []
        derived = self.derive(tuple(self.root[r] for r in roots), tuple(self.affix[a] for a in affixes), Work(most), target=target)
        return sorted({"".join(s) for s, _ in derived})


def linear(rules: list, start, apply) -> list:
    """Leaves of a cascade in which each state takes the first rules that apply, in order, deeper each time."""
    out = []

    def go(state, i):
        for k in range(i, len(rules)):
            if more := apply(rules[k], state):
                for s in more:
                    go(s, k + 1)
                return
        out.append(state)

    go(start, 0)
    return out


def permutations(rules: list, start, apply) -> list:
    """Every state that some subset of the rules, in order, leads to; the start is not one."""
    out = []

    def go(state, i):
        for k in range(i, len(rules)):
            for s in apply(rules[k], state):
                out.append(s)
                go(s, k + 1)

    go(start, 0)
    return out


def combinations(rules: list, start, apply) -> list:
    """Every state that rules in any order, each once, lead to; equal states are followed once."""
    out, seen = [], set()

    def go(state, left):
        for r in sorted(left):
            for s in apply(rules[r], state):
                if (s, left - {r}) not in seen:
                    seen.add((s, left - {r}))
                    out.append(s)
                    go(s, left - {r})

    go(start, frozenset(range(len(rules))))
    return list(dict.fromkeys(out))


ANALYSES = "array<struct<roots:array<string>,affixes:array<string>,category:string,guessed:boolean>>"


def parse_words(words: DataFrame, grammar: Grammar, word_col: str = "word", most: int = 100_000, guess: bool = False, supplied: tuple[Root, ...] = (), timed: bool = False) -> DataFrame:
    """(word, status, signature, work, analyses) of each distinct word: ok, CAP where the budget ended, SKIPPED where it
    is not of the grammar's segments. Words are dealt over all tasks, and each task takes its longest, which cost most,
    first. ``timed`` adds elapsed_ns."""
    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct().sortWithinPartitions(F.desc(F.length("word")), "word")
    sent = words.sparkSession.sparkContext.broadcast((grammar, supplied))

    def run(batches):
        engine = Engine(*sent.value)
        for b in batches:
            rows, took = [], []
            for w in b.column(0).to_pylist():
                begun = perf_counter_ns()
                rows.append(engine.parse(w, most, guess))
                took.append(perf_counter_ns() - begun)
            lists = [[{"roots": list(a.roots), "affixes": list(a.affixes), "category": a.category, "guessed": a.guessed} for a in r.analyses] for r in rows]
            kind = pa.list_(pa.struct([("roots", pa.list_(pa.string())), ("affixes", pa.list_(pa.string())), ("category", pa.string()), ("guessed", pa.bool_())]))
            yield pa.record_batch([b.column(0), pa.array([r.status for r in rows]), pa.array([r.signature for r in rows]), pa.array([r.work for r in rows], pa.int64()), pa.array(lists, kind), *([pa.array(took, pa.int64())] if timed else [])], names=["word", "status", "signature", "work", "analyses", *["elapsed_ns"] * timed])

    return distinct.mapInArrow(run, f"word string, status string, signature string, work long, analyses {ANALYSES}" + ", elapsed_ns long" * timed)


def partial_parses(words: DataFrame, grammar: Grammar, word_col: str = "word", most: int = 100_000, told: int = 5) -> DataFrame:
    """(word, status, partials): for each distinct word without an analysis JSON of the first ``told`` candidates that
    failed, with the reason; null where there is an analysis."""
    sent = words.sparkSession.sparkContext.broadcast(grammar)
    kind = pa.list_(pa.struct([("roots", pa.list_(pa.string())), ("affixes", pa.list_(pa.string())), ("reason", pa.string())]))

    def run(batches):
        engine = Engine(sent.value)
        for b in batches:
            rows = [engine.parse(w, most, partials=told) for w in b.column(0).to_pylist()]
            lists = [None if r.analyses else [{"roots": list(a), "affixes": list(x), "reason": why} for a, x, why in r.partials] for r in rows]
            yield pa.record_batch([b.column(0), pa.array([r.status for r in rows]), pa.array(lists, kind)], names=["word", "status", "partials"])

    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    found = distinct.mapInArrow(run, "word string, status string, partials array<struct<roots:array<string>,affixes:array<string>,reason:string>>")
    return found.select("word", "status", F.to_json("partials").alias("partials"))


def compiled(tables: dict[str, DataFrame], most: int = 200_000) -> Grammar:
    """A grammar from its tables: segments (segment), classes (class, segment), roots (name, shape, category, bound), affixes
    (name, prefix, suffix, takes, gives, slot), rules (ix, name, source, target, left, right: names of classes), templates
    (template, ix, slot, optional), compounds (first, second, whole).

    A grammar is one object that each worker holds, so its tables are read to the driver; ``most`` bounds each of them. A
    name that is not there, or a shape outside the segments, is an error.
    """

    def rows(name: str) -> list:
        if name not in tables:
            return []
        found = tables[name].limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"more than {most} rows of {name}")
        return found

    segments = frozenset(nfd(r["segment"]) for r in rows("segments"))
    classes: dict[str, set[str]] = {}
    for r in rows("classes"):
        classes.setdefault(r["class"], set()).add(nfd(r["segment"]))
    if bad := sorted(c for c, s in classes.items() if not s <= segments):
        raise ValueError(f"classes with unknown segments: {bad}")

    def shape(text: str | None) -> Shape:
        return segment(text, segments) if text else ()

    def side(name: str | None) -> tuple[frozenset[str], ...]:
        if name and name not in classes:
            raise ValueError(f"no class {name}")
        return (frozenset(classes[name]),) if name else ()

    by_name: dict[str, list] = {}
    for r in sorted(rows("roots"), key=lambda r: (r["name"], r["shape"])):
        by_name.setdefault(r["name"], []).append(r)
    roots = tuple(Root(n, tuple(shape(r["shape"]) for r in rs), rs[0]["category"], bound=any(r["bound"] for r in rs)) for n, rs in by_name.items())
    affixes = tuple(Affix(r["name"], prefix=shape(r["prefix"]), suffix=shape(r["suffix"]), takes=frozenset([r["takes"]] if r["takes"] else []), gives=r["gives"], slot=r["slot"]) for r in sorted(rows("affixes"), key=lambda r: r["name"]))
    rules = tuple(Rewrite(r["name"], shape(r["source"]), shape(r["target"]), Environment(side(r["left"]), side(r["right"]))) for r in sorted(rows("rules"), key=lambda r: r["ix"]))
    slots: dict[str, list] = {}
    for r in sorted(rows("templates"), key=lambda r: (r["template"], r["ix"])):
        slots.setdefault(r["template"], []).append((r["slot"], bool(r["optional"])))
    used = {a.slot for a in affixes if a.slot}
    if slots and (bad := sorted(used - {n for t in slots.values() for n, _ in t})):
        raise ValueError(f"slots that no template has: {bad}")
    return Grammar(segments, roots, affixes, rules, tuple(map(tuple, slots.values())), tuple(sorted((r["first"], r["second"], r["whole"]) for r in rows("compounds"))))


def reachable(grammar: Grammar) -> Grammar:
    """The grammar without affixes, templates and compounds that no word can use: what takes a category that no root has
    and no affix or compound gives, and slots of templates of which a required slot has no affix."""
    affixes, compounds = grammar.affixes, grammar.compounds
    while True:
        open_ = tuple(t for t in grammar.templates if all(o or any(a.slot == n for a in affixes) for n, o in t))
        there = {r.category for r in grammar.roots} | {a.gives for a in affixes if a.gives} | {c[2] for c in compounds}
        slots = {n for t in open_ for n, _ in t}
        a = tuple(x for x in affixes if (not x.takes or x.takes & there) and (not x.slot or not grammar.templates or x.slot in slots))
        c = tuple(x for x in compounds if x[0] in there and x[1] in there)
        if (a, c) == (affixes, compounds):
            return replace(grammar, affixes=a, compounds=c, templates=open_)
        affixes, compounds = a, c


def identities(parsed: DataFrame) -> DataFrame:
    """(word, morphemes, root_index, category, guessed): identities that do not depend on a grammar's numbering."""
    a = parsed.select("word", F.explode("analyses").alias("a"))
    names = F.concat(F.transform("a.roots", lambda r: F.when(~F.col("a.guessed"), r)), F.col("a.affixes"))
    return a.select("word", names.alias("morphemes"), F.lit(0).alias("root_index"), F.nullif(F.col("a.category"), F.lit("?")).alias("category"), F.col("a.guessed").alias("guessed"))


def generate_words(requests: DataFrame, grammar: Grammar, most: int = 100_000) -> DataFrame:
    """(id, surface, status) for rows (id, roots, affixes): ok with each surface, NONE without one, CAP where the steps ended."""
    sent = requests.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        engine = Engine(sent.value)
        for b in batches:
            rows = []
            for i, r, a in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    made = engine.generate(r or [], a or [], most)
                    rows += [(i, s, "ok") for s in made] or [(i, None, "NONE")]
                except Budget:
                    rows.append((i, None, "CAP"))
            yield pa.record_batch([pa.array([r[0] for r in rows], b.column(0).type), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names=["id", "surface", "status"])

    return requests.select("id", "roots", "affixes").mapInArrow(run, f"id {requests.schema['id'].dataType.simpleString()}, surface string, status string")


def trace_events(words: DataFrame, grammar: Grammar, word_col: str = "word", most: int = 20_000) -> DataFrame:
    """(word, node_id, parent_id, type, source, reason): the search as an edge table."""
    sent = words.sparkSession.sparkContext.broadcast(grammar)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        engine = Engine(sent.value)
        for b in batches:
            rows = [(w, *e) for w in b.column(0).to_pylist() for e in engine.parse(w, most, trace=True).trace]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "node_id", "parent_id", "type", "source", "reason"])

    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "word string, node_id int, parent_id int, type string, source string, reason string")


def segment_words(words: DataFrame, segments: list[str], word_col: str = "word", boundaries: list[str] = ()) -> DataFrame:
    """(word, segments, error_at): greedy longest segmentation; the first place that no segment covers."""
    known, edges = frozenset(map(nfd, segments)), frozenset(map(nfd, boundaries))

    def run(batches):
        for b in batches:
            out, bad = [], []
            for w in b.column(0).to_pylist():
                try:
                    out.append(list(segment(w, known, edges)))
                    bad.append(None)
                except SegmentError as e:
                    out.append(None)
                    bad.append(e.position)
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.string())), pa.array(bad, pa.int32())], names=["word", "segments", "error_at"])

    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "word string, segments array<string>, error_at int")


def confirmed(candidates: DataFrame, grammar: Grammar, most: int = 100_000) -> DataFrame:
    """(word, roots, affixes, confirmed, work): whether exactly these morphemes derive the word. A candidate that is not
    of the grammar, or runs out of steps, is not confirmed.

    What morphemes derive does not depend on the word, so each combination of roots and rules is derived once, and its
    surfaces meet the words that it was proposed for.
    """
    sent = candidates.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        engine = Engine(sent.value)
        for b in batches:
            rows = []
            for roots, affixes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                work, made = Work(most), []
                if roots and all(r in engine.root for r in roots) and all(a in engine.affix for a in affixes):
                    try:
                        made = ["".join(s) for s, _ in engine.derive(tuple(engine.root[r] for r in roots), tuple(engine.affix[a] for a in affixes), work)]
                    except Budget:
                        pass
                rows.append((roots, affixes, made, work.used))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.list_(pa.string())] * 3 + [pa.int64()])], names=["roots", "affixes", "made", "work"])

    own = candidates.where("word IS NOT NULL").select("word", "roots", F.coalesce("affixes", F.array().cast("array<string>")).alias("affixes"))
    derived = own.select("roots", "affixes").distinct().mapInArrow(run, "roots array<string>, affixes array<string>, made array<string>, work long")
    shown = segment_words(own, [*grammar.segments], boundaries=[*grammar.boundaries]).select("word", F.array_join("segments", "").alias("shown"))
    both = own.join(derived.withColumnsRenamed({"roots": "r", "affixes": "a"}), F.col("roots").eqNullSafe(F.col("r")) & (F.col("affixes") == F.col("a")))
    return both.join(shown, "word").select("word", "roots", "affixes", F.coalesce(F.array_contains("made", F.col("shown")), F.lit(False)).alias("confirmed"), "work")


def underlying(words: DataFrame, grammar: Grammar, word_col: str = "word", most: int = 100_000) -> DataFrame:
    """(word, rest): the shapes, as strings, that phonological rules may have made each word from; itself, if none did."""
    sent = words.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        g = sent.value
        for b in batches:
            rows = []
            for w in b.column(0).to_pylist():
                try:
                    work, deep = Work(most), {segment(w, g.segments, g.boundaries)}
                    for rule in reversed(g.phonology):
                        deep = {s for x in deep for s in rule.undo(x, work)}
                except (SegmentError, Budget):
                    continue
                rows += [(w, "".join(s)) for s in sorted(deep)]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["word", "rest"])

    return words.select(F.col(word_col).alias("word")).where("word <> ''").distinct().mapInArrow(run, "word string, rest string")


def peeled(states: DataFrame, grammar: Grammar, most: int = 100_000) -> DataFrame:
    """(word, rest, affixes) after one more affix that is not just added at the edges is taken off: reduplication, an
    infix, cut segments, or a stretch with any of them."""
    sent = states.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        g = sent.value
        odd, letters = [a for a in g.affixes if a.infix or a.copies or a.cuts], tuple(sorted(g.segments))
        for b in batches:
            rows = []
            for word, rest, affixes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                shape = segment(rest, g.segments, g.boundaries)
                for a in odd:
                    try:
                        rows += [(word, "".join(s), [a.name, *affixes]) for s in a.undo(shape, letters, Work(most))]
                    except Budget:
                        pass
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.string(), pa.string(), pa.list_(pa.string())])], names=["word", "rest", "affixes"])

    return states.select("word", "rest", "affixes").mapInArrow(run, "word string, rest string, affixes array<string>")


def proposed(words: DataFrame, grammar: Grammar, word_col: str = "word") -> DataFrame:
    """(word, roots, affixes): all candidates, by joins; ``confirmed`` drops what does not derive.

    Phonological rules are undone first. Then up to the grammar's number of affixes are taken off, the outermost first:
    those at the edges by a join on the edges' strings, the others by ``peeled``. What is left meets the roots, whole or,
    for compounds, in two parts. Equal candidates that several ways led to are one.
    """
    spark = words.sparkSession
    plain = [a for a in grammar.affixes if not (a.infix or a.copies or a.cuts)]
    odd = len(plain) < len(grammar.affixes)
    edges = spark.createDataFrame([("".join(a.prefix), "".join(a.suffix), a.name) for a in plain], "before string, after string, affix string")
    sizes = sorted({(len("".join(a.prefix)), len("".join(a.suffix))) for a in plain})
    rest, n = F.col("rest"), F.length("rest")
    states = underlying(words, grammar, word_col).withColumn("affixes", F.array().cast("array<string>"))
    every = [states]
    for _ in range(grammar.most_affixes):
        fit = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in sizes]), lambda x: x["p"] + x["s"] < n)).alias("x")
        ends = states.select("word", "rest", "affixes", fit) if sizes else states.limit(0).withColumn("x", F.struct(F.lit(0).alias("p"), F.lit(0).alias("s")))
        p, s = F.col("x.p"), F.col("x.s")
        ends = ends.select("word", "affixes", F.substr(rest, F.lit(1), p).alias("before"), F.substr(rest, n - s + 1, s).alias("after"), F.substr(rest, p + 1, n - p - s).alias("rest"))
        more = ends.join(edges, ["before", "after"]).select("word", "rest", F.concat(F.array("affix"), "affixes").alias("affixes"))
        states = (more.unionByName(peeled(states, grammar)) if odd else more).distinct()
        every.append(states)
    left = every[0]
    for x in every[1:]:
        left = left.unionByName(x)
    shapes = spark.createDataFrame([("".join(s), r.name, r.category) for r in grammar.roots for s in r.shapes], "rest string, root string, category string").distinct()
    found = left.join(shapes, "rest").select("word", F.array("root").alias("roots"), "affixes")
    if grammar.compounds and grammar.most_stems > 1:
        cut = left.select("word", "affixes", rest.alias("whole"), F.explode(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))).alias("i"))
        cut = cut.select("word", "affixes", F.substr("whole", F.lit(1), F.col("i")).alias("rest"), F.substr(F.col("whole"), F.col("i") + 1, F.length("whole")).alias("other"))
        second = shapes.select(F.col("rest").alias("other"), F.col("root").alias("root2"), F.col("category").alias("category2"))
        pairs = spark.createDataFrame([c[:2] for c in grammar.compounds], "category string, category2 string").distinct()
        found = found.unionByName(cut.join(shapes, "rest").join(second, "other").join(pairs, ["category", "category2"]).select("word", F.array("root", "root2").alias("roots"), "affixes"))
    return found.distinct()


def phonology_steps(shapes: DataFrame, grammar: Grammar, word_col: str = "word") -> DataFrame:
    """(word, ix, rule, output, changed): the ordered phonological rules on explicit forms, one row for each rule; a word
    that is not of the grammar's segments has one row without a rule."""
    sent = shapes.sparkSession.sparkContext.broadcast(grammar)
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]

    def run(batches):
        g = sent.value
        for b in batches:
            rows = []
            for w in b.column(0).to_pylist():
                try:
                    shape = segment(w, g.segments, g.boundaries)
                except SegmentError:
                    rows.append((w, None, None, None, None))
                    continue
                for i, rule in enumerate(g.phonology):
                    new = rule.apply(shape)
                    rows.append((w, i, rule.name, "".join(new), new != shape))
                    shape = new
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["word", "ix", "rule", "output", "changed"])

    return shapes.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct().mapInArrow(run, "word string, ix int, rule string, output string, changed boolean")
