"""Normalised grammar facts: closures, reference index, resolved states, censuses, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def closure(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a forest given as (node, parent), null parents being roots.

    Depths double with each step, so a forest of depth n takes log n joins; the node itself is not its ancestor. A node
    that is its own ancestor is an error, found as soon as its circle is closed.
    """
    exact = parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("ancestor"))
    closed, depth = exact.select("node", "ancestor", F.lit(1).alias("depth")), 1
    while True:
        closed, exact = stored(closed, "closure"), stored(exact, "closure-exact")
        if (circle := closed.where("node = ancestor").select("node").first()) is not None:
            raise ValueError(f"{circle['node']} is its own ancestor")
        if exact.isEmpty():
            return closed
        up = exact.select("node", F.col("ancestor").alias("mid"))
        more = up.join(closed.select(F.col("node").alias("mid"), "ancestor", "depth"), "mid").select("node", "ancestor", (F.col("depth") + depth).alias("depth"))
        exact = up.join(exact.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor")
        closed, depth = closed.unionByName(more), depth * 2


def reference_index(edges: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(target_kind, target, referrer_kind, referrer) of every (referrer kind, target kind, rows of referrer and target)."""
    parts = [e.where("target IS NOT NULL").select(F.lit(t).alias("target_kind"), F.col("target").cast("long").alias("target"), F.lit(r).alias("referrer_kind"), F.col("referrer").cast("long").alias("referrer")) for r, t, e in edges]
    return reduce(DataFrame.unionByName, parts).distinct()


def dangling(edges: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """References whose target is not there."""
    return edges.join(targets.select(F.col(key).alias("target")), "target", "left_anti")


def object_state(rows: DataFrame) -> DataFrame:
    """(subject, final_stage, loaded, dispositions, primary_reason): what the rows of the highest stage say.

    ``loaded`` is null where they disagree; the reason is that of the smallest decision.
    """
    keep = F.struct("decision", "loaded", "disposition", "reason")
    stages = rows.groupBy("subject", "stage").agg(F.collect_set("disposition").alias("d"), F.bool_and("loaded").alias("every"), F.bool_or("loaded").alias("some"), F.min(keep).alias("first"))
    last = stages.groupBy("subject").agg(F.max_by(F.struct("stage", "d", "every", "some", "first"), "stage").alias("x")).select("subject", "x.*")
    return last.select("subject", F.col("stage").alias("final_stage"), F.when(F.col("every") == F.col("some"), F.col("every")).alias("loaded"), F.array_join(F.array_sort("d"), ",").alias("dispositions"), F.col("first.reason").alias("primary_reason"))


def effective_members(classes: DataFrame, phonemes: DataFrame, most: int = 10_000) -> DataFrame:
    """(class_id, member, basis): phonemes whose features a class's features subsume.

    Phonemes with the same lanes are one row while they are compared: there are as many as a grammar tells apart, however
    many members there are. Classes are copied only up to ``most``; beyond it, each set of lanes is compared once and
    the classes stay where they are.
    """
    ok = F.forall(F.zip_with("features", "lanes", lambda c, p: (p.bitwiseAND(F.bitwise_not(c)) == 0)), lambda x: x)
    kinds = phonemes.select("lanes").distinct()
    few = classes.limit(most + 1).count() <= most
    found = kinds.join(F.broadcast(classes) if few else classes, ok)
    return phonemes.join(found, "lanes").select("class_id", "member", F.when(F.forall("features", lambda c: c == -1), "unrestricted").otherwise("features").alias("basis"))


def census(rows: DataFrame, group: str, handled: Column) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(~handled).alias("unhandled"))


def admission(findings: DataFrame, group: str, severities: list[str]) -> DataFrame:
    """The worst severity of each group, and over all (null group)."""
    rank = F.array_position(F.array(*map(F.lit, severities)), F.col("severity"))
    worst = findings.select(group, rank.alias("r")).groupingSets([[F.col(group)], []], F.col(group)).agg(F.max("r").alias("r"))
    return worst.select(group, F.get(F.array(*map(F.lit, severities)), F.col("r").cast("int") - 1).alias("worst"))


def search(lexicon: DataFrame, query: str | None = None, pos: str | None = None, state: str | None = None) -> DataFrame:
    """Entries whose stem or gloss contains the query, with equal part of speech and state where given."""
    if query:
        lexicon = lexicon.where(F.col("stem").contains(query) | F.exists("glosses", lambda g: g.contains(query)))
    if pos is not None:
        lexicon = lexicon.where(F.col("pos") == pos)
    return lexicon.where(F.col("state") == state) if state is not None else lexicon


def remaining(predictions: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates that no yes or no answer contradicts; unknown ones say nothing."""
    said = answers.where("answer IS NOT NULL")
    wrong = predictions.join(said, "form").where(F.col("predicted") != F.col("answer"))
    return predictions.select("candidate").distinct().join(wrong, "candidate", "left_anti")


def informative(predictions: DataFrame, left: DataFrame, answers: DataFrame) -> DataFrame:
    """(form, yes, total) of unanswered forms that some, not all, remaining candidates predict."""
    rows = predictions.join(left, "candidate").join(answers.where("answer IS NOT NULL"), "form", "left_anti")
    return rows.groupBy("form").agg(F.count_if("predicted").alias("yes"), F.count(F.lit(1)).alias("total")).where("yes > 0 AND yes < total")


def next_form(forms: DataFrame) -> DataFrame:
    """The form that splits the candidates best; ties to the smallest."""
    score = F.least(F.col("yes"), F.col("total") - F.col("yes"))
    return forms.withColumn("score", score).orderBy(F.desc("score"), "form").limit(1)


def latest(mutations: DataFrame, key: str, order: str) -> DataFrame:
    """The state after all mutations: the last of each entry, removed ones gone."""
    last = mutations.groupBy(key).agg(F.max_by(F.struct("action", "value"), order).alias("m"))
    return last.where("m.action <> 'remove'").select(key, F.col("m.value").alias("value"))


def reconciled(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    both = ours.select(key, F.col("value").alias("a"), F.lit(1).alias("l")).join(theirs.select(key, F.col("value").alias("b"), F.lit(1).alias("r")), key, "full_outer")
    return both.select(key, F.when(F.col("l").isNull(), "theirs_only").when(F.col("r").isNull(), "ours_only").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("conflict").alias("state"))


def merged(rows: DataFrame, identity: list[str], key: str) -> DataFrame:
    """Each row's representative: the smallest key among equal rows."""
    first = rows.groupBy(*identity).agg(F.min(key).alias("representative"))
    return rows.join(first, identity).select(key, "representative")


def passed_candidates(witnesses: DataFrame, enforce: bool = True) -> DataFrame:
    """(candidate, kept, rejected): a candidate goes only if all its witnesses are rejected; without ``enforce`` it is only told."""
    all_rejected = F.bool_and("rejected")
    return witnesses.groupBy("candidate").agg(all_rejected.alias("rejected")).select("candidate", (~F.col("rejected") | F.lit(not enforce)).alias("kept"), "rejected")


def uncovered(required: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    return required.select(*keys).distinct().join(observed, keys, "left_anti")


def coverage_join(curated: DataFrame, measured: DataFrame, key: str) -> DataFrame:
    both = curated.join(measured, key, "full_outer")
    c, m = F.col("curated"), F.col("measured")
    return both.select(key, F.when(c.isNull(), "uncurated").when(m.isNull(), "unmeasured").when(c == m, "agrees").when(c > m, "overclaimed").otherwise("underclaimed").alias("verdict"))


def scoreboard(cells: DataFrame, most: int = 200) -> DataFrame:
    """(fixture, backend, words, exact, outcome), of at most ``most`` words each, in order."""
    ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy("fixture", "backend").orderBy("word"))).where(F.col("r") <= most)
    s = ranked.groupBy("fixture", "backend").agg(F.count(F.lit(1)).alias("words"), F.count_if("exact").alias("exact"))
    return s.withColumn("outcome", F.when(F.col("exact") == F.col("words"), "exact").when(F.col("exact") > 0, "partial").otherwise("none"))


def dead_branches(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(nodes, dead_nodes, work, dead_work): a branch is dead if neither it nor anything below it succeeds."""
    alive = closed.join(nodes.where("success").select("node"), "node").select(F.col("ancestor").alias("node")).unionByName(nodes.where("success").select("node")).distinct().withColumn("alive", F.lit(True))
    rows = nodes.join(alive, "node", "left")
    dead = F.col("alive").isNull()
    return rows.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(dead).alias("dead_nodes"), F.sum("work").alias("work"), F.coalesce(F.sum(F.when(dead, F.col("work"))), F.lit(0)).alias("dead_work"))


def degrees(edges: DataFrame) -> DataFrame:
    """How many states have how many arcs."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("arcs")).groupBy("arcs").agg(F.count(F.lit(1)).alias("states"))


def stored_without_parse(stored: DataFrame, parsed: DataFrame, attempted: DataFrame) -> DataFrame:
    """Stored analyses, of words that were attempted in full, that no parse gives."""
    return stored.join(attempted.select("word"), "word", "left_semi").join(parsed, ["word", "identity"], "left_anti")


def undeclared(texts: DataFrame, declared: DataFrame, text_col: str = "text") -> DataFrame:
    """(character, occurrences) of characters that no segment declares."""
    chars = texts.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count(F.lit(1)).alias("occurrences"))
    return chars.join(declared, "character", "left_anti")


def evenly(rows: DataFrame, key: str, step: int) -> DataFrame:
    """Every ``step``-th row by key: ranges of the key are counted first, so no row is ordered in one place."""
    ranged = rows.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id())
    own = ranged.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    sizes = own.groupBy("part").agg(F.max("i").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), "part").where((F.col("before") + F.col("i") - 1) % step == 0).select(*rows.columns)  # a row per partition


def lineage(sources: DataFrame, outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, role, output) of source objects and what was compiled from them, many to many; sources without an output stay."""
    m = mapping.join(outputs.select("output"), "output", "left_semi")
    return sources.join(m, "source", "left").select("source", F.coalesce("role", F.lit("not_compiled")).alias("role"), "output")


def occurrence_identities(rows: DataFrame) -> DataFrame:
    """(occurrence, identities, raw, collapsed, any_guessed): distinct identities of each occurrence, and the paths that fell together."""
    one = rows.groupBy("occurrence", "identity").agg(F.count(F.lit(1)).alias("n"), F.bool_or("guessed").alias("g"))
    return one.groupBy("occurrence").agg(F.count(F.lit(1)).alias("identities"), F.sum("n").alias("raw"), (F.sum("n") - F.count(F.lit(1))).alias("collapsed"), F.bool_or("g").alias("any_guessed"))


def health(findings: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(code, severity, subject) of (code, severity, rows with a subject): one query of the grammar's tables for each code."""
    parts = [df.select(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.col("subject").cast("string").alias("subject")) for c, s, df in findings]
    return reduce(DataFrame.unionByName, parts)


def checked_mutations(mutations: DataFrame, key: str, order: str) -> DataFrame:
    """(key, value, revision, refused) after mutations (action, value, expected) in order: one that expects another revision
    than the entry has is refused; ``remove`` leaves no value, ``clear`` an empty one.

    Whether a mutation holds depends on all before it, so an entry's are read one after another; they come sorted, and
    nothing is kept of them but the entry's state.
    """
    kind = mutations.schema[key].dataType.simpleString()
    rows = mutations.select(key, order, "action", "value", "expected").repartition(key).sortWithinPartitions(key, order).drop(order)

    def run(batches):
        import pyarrow as pa

        nothing = object()
        now, value, revision, refused, like = nothing, None, 0, 0, None
        out = []

        def rows_of(done):
            return pa.record_batch([pa.array([r[0] for r in done], like), pa.array([r[1] for r in done], pa.string()), *(pa.array([r[i] for r in done], pa.int64()) for i in (2, 3))], names=[key, "value", "revision", "refused"])

        for b in batches:
            like = b.column(0).type
            for k, action, new, expected in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now:
                    if now is not nothing:
                        out.append((now, value, revision, refused))
                    now, value, revision, refused = k, None, 0, 0
                if expected == revision:
                    value, revision = None if action == "remove" else "" if action == "clear" else new, revision + 1
                else:
                    refused += 1
            if len(out) >= 1000:
                yield rows_of(out)
                out = []
        if now is not nothing:
            out.append((now, value, revision, refused))
        if out:
            yield rows_of(out)

    return rows.mapInArrow(run, f"`{key}` {kind}, value string, revision long, refused long")


def catalogue(predictions: DataFrame) -> DataFrame:
    """(signature, candidates, first): candidates whose predictions for all forms agree can't be told apart by any answer."""
    own = F.array_join(F.array_sort(F.collect_list(F.concat(F.col("form").cast("string"), F.when(F.col("predicted"), "+").otherwise("-")))), " ")
    return predictions.groupBy("candidate").agg(own.alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("candidates"), F.min("candidate").alias("first"))


def inferred(undeclared: DataFrame, category: Column) -> DataFrame:
    """(character, occurrences, status): what an undeclared character is taken for: a segment, a boundary, or ambiguous."""
    status = F.when(category.isin("letter", "mark"), "segment").when(category.isin("space"), "boundary").otherwise("ambiguous")
    return undeclared.select("character", "occurrences", status.alias("status"))
