"""Scalar Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgrain.schema import BOUNDARY_RANK, GRANULARITY_RANK


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def lookup(mapping: Mapping[str, float | int | str], key: Column, default=None) -> Column:
    """Literal map lookup for a fixed, small vocabulary."""
    entries = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def granularity_rank(c: Column) -> Column:
    return lookup(GRANULARITY_RANK, c)


def boundary_rank(c: Column) -> Column:
    """Lower is safer."""
    return lookup(BOUNDARY_RANK, c)


def auc_to_risk(auc: Column) -> Column:
    """0 at AUC 0.5, 1 at AUC 1.0, linear between."""
    return clamp01(2.0 * (auc - 0.5))


def mean_over(array: Column, value) -> Column:
    """Mean of ``value(x)`` over an array column; 0 for an empty array."""
    total = F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))
    return total / F.greatest(F.lit(1), F.size(array))


def stable_round(c: Column, digits: int = 6) -> Column:
    """Half-up rounding that other engines reproduce bit for bit.

    A nudge of 1e-4 of the last digit keeps short decimals such as 0.0000005 off the rounding edge.
    """
    scale = float(10**digits)
    shifted = c * F.lit(scale) + F.lit(0.5001)
    # beyond 2 ** 53 a double has no fraction left, and floor() would saturate at the largest long
    return F.when(F.abs(shifted) < 2.0**53, F.floor(shifted).cast("double")).otherwise(shifted) / F.lit(scale)


def canonical_json(columns: Mapping[str, Column]) -> Column:
    """JSON object with sorted keys and no blanks; null members are dropped."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))


def sorted_map(m: Column) -> Column:
    """The same map with its entries in key order, so that its JSON form is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def fingerprint(columns: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(columns), 256)
