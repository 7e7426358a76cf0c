"""Flat feature structures: maps of a feature to the bit set of its allowed symbols. A missing feature allows all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _filled(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != 0))


def unifiable(a: Column, b: Column) -> Column:
    return F.forall(F.map_values(F.map_zip_with(a, b, lambda k, x, y: x.isNull() | y.isNull() | (x.bitwiseAND(y) != 0))), lambda z: z)


def unify(a: Column, b: Column) -> Column:
    """Both structures' demands, or null if they contradict each other, which leaves a feature without a symbol.

    The maps are met once; a structure has no empty bit sets of its own.
    """
    both = F.array(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.bitwiseAND(y), x, y)))
    return F.get(F.filter(both, lambda m: ~F.array_contains(F.map_values(m), F.lit(0).cast("long"))), F.lit(0))


def subsumes(general: Column, special: Column) -> Column:
    """All that ``general`` demands, ``special`` does; the empty structure subsumes all."""
    return F.forall(F.map_entries(general), lambda e: F.coalesce(special[e["key"]].bitwiseAND(F.bitwise_not(e["value"])) == 0, F.lit(False)))


def priority_union(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def unify_priority(a: Column, b: Column) -> Column:
    """``priority_union`` where the two unify, else null; both come from one meeting of the maps."""
    pair = lambda k, x, y: F.struct(F.coalesce(x.bitwiseAND(y), x, y).alias("both"), F.coalesce(y, x).alias("last"))
    met = F.filter(F.array(F.map_zip_with(a, b, pair)), lambda m: ~F.exists(F.map_values(m), lambda v: v["both"] == 0))
    return F.transform_values(F.get(met, F.lit(0)), lambda k, v: v["last"])


def union(a: Column, b: Column) -> Column:
    """What either allows: only features that both restrict stay."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: x.bitwiseOR(y)), lambda k, v: v.isNotNull())


def add(a: Column, b: Column, full: Column) -> Column:
    """``a`` widened by ``b``; a feature all of whose symbols (in ``full``) are allowed goes."""
    wide = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.bitwiseOR(y), x, y))
    return F.map_filter(wide, lambda k, v: ~v.eqNullSafe(full[k]))


def subtract(a: Column, b: Column) -> Column:
    return _filled(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x.bitwiseAND(F.bitwise_not(y)), x)))


def without(a: Column, keys: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.array_contains(keys, k))


def stem_name(regions: Column, unshared: Column, features: Column) -> Column:
    """'required' if no region of the allomorph's own stem name subsumes the features, 'excluded' if a region that only
    another stem name has does; null if the allomorph may stand. Without regions nothing is required."""
    own = F.exists(regions, lambda r: subsumes(r, features))
    other = F.exists(unshared, lambda r: subsumes(r, features))
    return F.when((F.size(regions) > 0) & ~own, "required").when(other, "excluded")
