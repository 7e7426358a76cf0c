"""Bit sets in 64-bit integers and arrays of them (lanes); a missing lane allows everything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL = -1


def lane(lanes: Column, i: Column | int) -> Column:
    return F.coalesce(F.get(lanes, i if isinstance(i, Column) else F.lit(i)), F.lit(ALL).cast("long"))


def _pairs(a: Column, b: Column, f) -> Column:
    n = F.greatest(F.size(a), F.size(b))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: f(lane(a, i), lane(b, i)))


def unify(a: Column, b: Column) -> Column:
    """Lane-wise intersection; null if a lane is left empty."""
    both = _pairs(a, b, lambda x, y: x.bitwiseAND(y))
    return F.when(F.forall(both, lambda x: x != 0), both)


def unifiable(a: Column, b: Column) -> Column:
    return F.forall(_pairs(a, b, lambda x, y: x.bitwiseAND(y) != 0), lambda z: z)


def subsumes(general: Column, special: Column) -> Column:
    """Each lane of ``special`` is within that of ``general``."""
    return F.forall(_pairs(special, general, lambda s, g: s.bitwiseAND(F.bitwise_not(g)) == 0), lambda z: z)


def superset(a: Column, b: Column, negate_a: bool = False, negate_b: bool = False, mask: int = ALL) -> Column:
    x, y = (F.bitwise_not(a) if negate_a else a), (F.bitwise_not(b) if negate_b else b)
    return y.bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(mask)) == 0


def overlaps(a: Column, b: Column, negate_a: bool = False, negate_b: bool = False, mask: int = ALL) -> Column:
    x, y = (F.bitwise_not(a) if negate_a else a), (F.bitwise_not(b) if negate_b else b)
    return x.bitwiseAND(y).bitwiseAND(F.lit(mask)) != 0


def except_(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def complement(a: Column, mask: int) -> Column:
    return F.bitwise_not(a).bitwiseAND(F.lit(mask))


def gate(has: Column, required: Column, excluded: Column, any_of: bool = True) -> Column:
    """'required' if a requirement fails, 'excluded' if an exclusion holds, else null; in that order.

    A group of requirements is met by any member, or by all with ``any_of`` off; an empty one is met.
    """
    met = F.arrays_overlap(has, required) if any_of else F.size(F.array_except(required, has)) == 0
    return F.when((F.size(required) > 0) & ~met, "required").when(F.arrays_overlap(has, excluded), "excluded")
