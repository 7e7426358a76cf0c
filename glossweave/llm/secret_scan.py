"""Secret scans with corpus-wide ownership frequency, in DataFrame functions.

Patterns find spans of whole texts: assignments, access keys and hex keys (the base), and signed tokens, keys with a
vendor's prefix and long mixed-case strings (candidates only). The digest of each found value is counted over the whole
corpus by distinct owners and distinct repositories. A value is a widely copied example if it has more than
``most_owners`` owners, or stands in more than ``most_repositories`` repositories, as one that a single owner pastes
everywhere does; what is left is owner-specific and taken for live. Base spans are always reported; candidates only if
they are live.

A text is tried against one joint pattern first. Start and end count code points, the end excluded; they come from
the lengths of the pieces between the matches. Only digests, owners and spans move between tasks: equal digests of an
owner's repository are one row before they are counted, and the counts of a hot digest are broadcast to its rows.

Nulls: a null text is an empty one; a null owner or repository is an owner or repository named by the empty string; null
ids are kept. Repeated rows are scanned each, and count once as owners. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# Kind, pattern, group of the value, least length of the value, and what else the value must hold.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, []),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, []),
    ("hex", r"[0-9a-f]{32,}+", 0, 32, []),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, []),
    ("vendor", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_)[A-Za-z0-9_-]{16,}+", 0, 20, []),
    ("mixed", r"[A-Za-z0-9+/_-]{32,}+", 0, 32, ["[A-Z]", "[a-z]", "[0-9]"]),
]
JOINT = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=])|AKIA[A-Z0-9]{12}|[A-Za-z0-9+/_-]{32}|eyJ[A-Za-z0-9_-]{8,}\.|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_"""
BASE = 3
PART = 256


def running(x: Column) -> Column:
    """Running sums of an array of int, part by part, so that long arrays are not copied for each element."""
    none = F.array().cast("array<int>")

    def outer(acc: Column, c: Column) -> Column:
        start = F.struct(acc["base"].alias("base"), none.alias("out"))
        part = F.aggregate(F.slice(x, c * PART + 1, PART), start, lambda a, v: F.struct((a["base"] + v).alias("base"), F.array_append(a["out"], a["base"] + v).alias("out")))
        return F.transform(F.array(part), lambda p: F.struct(p["base"].alias("base"), F.concat(acc["out"], p["out"]).alias("out")))[0]

    parts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int"))).otherwise(none)
    return F.aggregate(parts, F.struct(F.lit(0).alias("base"), none.alias("out")), outer)["out"]


def found(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """``keep`` and ``spans``: array of (start, kind, end, from, digest) of the texts; ``from`` is where the value starts."""
    step = docs.select(*keep, text.alias("_t"))
    names = step.columns[:-1]
    step = step.withColumn("_x", F.col("_t").rlike(JOINT))
    none = F.array().cast("array<string>")
    on = lambda x: F.when(F.col("_x"), x).otherwise(none)
    step = step.select(*names, *(c for i, (_, p, g, *_) in enumerate(KINDS) for c in (on(F.regexp_extract_all("_t", F.lit(p), F.lit(0))).alias(f"_m{i}"), on(F.regexp_extract_all("_t", F.lit(p), F.lit(g))).alias(f"_v{i}"), on(F.split("_t", p, -1)).alias(f"_s{i}"))))
    lengths = lambda i: F.transform(F.col(f"_m{i}"), lambda m, j: F.length(m) + F.length(F.get(F.col(f"_s{i}"), j)))
    step = step.select(*names, *(c for i in range(len(KINDS)) for c in (f"_m{i}", f"_v{i}", lengths(i).alias(f"_l{i}"))))
    step = step.select(*names, *(c for i in range(len(KINDS)) for c in (f"_m{i}", f"_v{i}", running(F.col(f"_l{i}")).alias(f"_e{i}"))))

    def spans(i: int) -> Column:
        _, _, _, least, needs = KINDS[i]
        value, end = F.col(f"_v{i}"), F.col(f"_e{i}")
        all_of = F.transform(F.col(f"_m{i}"), lambda m, j: F.struct((F.get(end, j) - F.length(m)).alias("start"), F.lit(i).alias("kind"), F.get(end, j).alias("end"), (F.get(end, j) - F.length(F.get(value, j))).alias("from"), F.get(value, j).alias("value")))

        def good(s: Column) -> Column:
            ok = F.length(s["value"]) >= least
            for n in needs:
                ok = ok & s["value"].rlike(n)
            return ok

        return F.filter(all_of, good)

    every = F.concat(*map(spans, range(len(KINDS))))
    return step.select(*names, F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["from"].alias("from"), F.sha2(s["value"], 256).alias("digest"))).alias("spans"))


def _scanned(docs: DataFrame, keep: list[str], text_col: str, owner_col: str, repository_cols: tuple[str, ...], most_owners: int, most_repositories: int) -> tuple[DataFrame, DataFrame]:
    """``keep``, ``_row`` and ``spans``, stored; and (_row, base, added) of the rows that have spans."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    places = [name(owner_col).alias("_owner"), F.to_json(F.array(*map(name, repository_cols))).alias("_repository")]
    rows = found(docs, [*map(F.col, keep), *places], shared.text_of(text_col))
    rows = shared.written(rows.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("spans") > 0).select("_row", "_owner", "_repository", F.inline("spans"))
    seen = each.groupBy("digest", "_owner", "_repository").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("digest").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repository").alias("repositories"), F.sum("n").alias("n"))
    seen = shared.written(seen, "secrets-seen")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    live = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)
    span = F.struct("start", "kind", "end", "from", "owners", "repositories", live.alias("live"))
    judged = shared.spread_join(each, seen, "digest", total).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("every"))
    base = F.filter("every", lambda s: s["kind"] < BASE).alias("base")
    return rows, judged.select("_row", base, F.filter("every", lambda s: (s["kind"] >= BASE) & s["live"]).alias("added"))


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 2, most_repositories: int = 3) -> DataFrame:
    """``keep``, ``base`` and ``added``: arrays of (start, kind, end, from, owners, repositories, live), ascending."""
    rows, judged = _scanned(docs, keep, text_col, owner_col, repository_cols, most_owners, most_repositories)
    none = F.array().cast(judged.schema["base"].dataType)
    joined = rows.select(*keep, "_row").join(judged, "_row", "left")
    return joined.select(*keep, F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def shown(spans: Column) -> Column:
    """kind:start:end of ascending spans, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), most_owners: int = 2, most_repositories: int = 3, mark: str = "[secret]") -> DataFrame:
    """``docs`` with the values of all base and added spans replaced; a null text stays null. Texts are scanned once, and
    only those with spans are joined."""
    rows, judged = _scanned(docs, docs.columns, text_col, owner_col, repository_cols, most_owners, most_repositories)
    cuts = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["from"].alias("from"), s["end"].alias("end"))))
    joined = rows.where(F.size("spans") > 0).join(judged.select("_row", cuts.alias("_cuts")), "_row")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), acc["at"] + 1, F.greatest(s["from"] - acc["at"], F.lit(0)))
        new = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], F.concat(gap, F.when(s["from"] >= acc["at"], mark).otherwise(""))).alias("out"))
        return new

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.col("_cuts"), start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    plain = rows.where(F.size("spans") == 0).select(*docs.columns)
    return plain.unionByName(joined.withColumn(text_col, done).select(*docs.columns))
