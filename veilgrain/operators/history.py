"""Versioned history: latest rows, active versions, drift between runs and between windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.operators.bounding import keep_first


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key."""
    return keep_first(df, keys, [F.col(order).desc()], 1)


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert or replace by key: the row of the highest version wins, an update before a row on record."""
    both = existing.withColumn("_update", F.lit(0)).unionByName(updates.withColumn("_update", F.lit(1)))
    return keep_first(both, keys, [F.col(version).desc(), F.col("_update").desc()], 1).drop("_update")


def with_active_flag(contracts: DataFrame, keys: Sequence[str] = ("feature_id",), version: str = "contract_version") -> DataFrame:
    """``active`` is true on the highest version only. An aggregate joined back, so no window over a feature's versions."""
    top = contracts.groupBy(*keys).agg(F.max(version).alias("_top"))
    return contracts.join(top, list(keys)).withColumn("active", F.col(version) == F.col("_top")).drop("_top")


def qualify_min(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows that reach their group's minimum; ties stay. Meant for option rows, of which a group has at most nine."""
    low = F.min(value).over(W.partitionBy(*keys))
    return df.withColumn("_low", low).filter(F.col(value) == F.col("_low")).drop("_low")


def with_previous(history: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Add prev_<c>: the value of the run before. A feature has one row per run, so windows stay small."""
    w = W.partitionBy(*keys).orderBy(order)
    return history.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns})


def _moved(c: str) -> Column:
    """Distance to the run before, rounded so that the order of additions cannot flip a threshold."""
    return F.round(F.abs(F.col(c) - F.col(f"prev_{c}")), 12)


def band(score: Column, mid: float, high: float) -> Column:
    return F.when(score >= high, 2).when(score >= mid, 1).otherwise(0)


def score_drift(history: DataFrame, total: str, tau: float, order: str = "computed_at") -> DataFrame:
    """Runs whose total moved by more than ``tau`` since the run before."""
    pairs = with_previous(history, ["feature_id"], order, [total])
    return pairs.withColumn("drift", _moved(total)).filter(F.col("drift") > tau)


def subscore_drift(history: DataFrame, taus: Mapping[str, float], total: str, mid: float = 0.40, high: float = 0.75,
                   order: str = "computed_at") -> DataFrame:
    """Runs in which a sub-score moved beyond its tau, or the total crossed a band; ``alerts`` names them."""
    pairs = with_previous(history, ["feature_id"], order, [*taus, total])
    moved = [F.when(_moved(c) > t, F.lit(f"DRIFT:{c}")) for c, t in taus.items()]
    crossed = F.when(band(F.col(total), mid, high) != band(F.col(f"prev_{total}"), mid, high), F.lit("BAND_CROSSED"))
    known = pairs.filter(F.col(f"prev_{total}").isNotNull())
    return known.withColumn("alerts", F.array_compact(F.array(*moved, crossed))).filter(F.size("alerts") > 0)


def spikes(history: DataFrame, value: str, jump: float, order: str) -> DataFrame:
    """Versions whose value jumped by more than ``jump`` over the version before."""
    pairs = with_previous(history, ["feature_id"], order, [value])
    return pairs.filter(F.col(value) - F.col(f"prev_{value}") > jump)


def changes(history: DataFrame, value: str, order: str) -> DataFrame:
    pairs = with_previous(history, ["feature_id"], order, [value])
    return pairs.filter(F.col(value) != F.col(f"prev_{value}"))


def side_by_side(stats: DataFrame, keys: Sequence[str], columns: Sequence[str], current: str = "W1", previous: str = "W0") -> DataFrame:
    """Statistics of two windows in one row, suffixed _w1 and _w0."""
    aggs = []
    for window, suffix in ((current, "w1"), (previous, "w0")):
        for c in columns:
            aggs.append(F.max(F.when(F.col("window_id") == window, F.col(c))).alias(f"{c}_{suffix}"))
    return stats.groupBy(*keys).agg(*aggs)


def relative_change(w1: Column, w0: Column) -> Column:
    return F.abs(w1 - w0) / F.greatest(F.lit(1e-12), F.abs(w0))


def tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
