"""BoundingPlan: dedupe, contribution caps, cell caps and pre-aggregation to staging.

Caps are ranking windows followed directly by ``rank <= n``. Spark turns that pair into a group limit that
already runs before the shuffle, so a contributor holding a third of all rows sends at most ``n`` rows per
cell and map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.functions.noise import keyed_uniform
from veilgrain.functions.scalar import clamp
from veilgrain.operators.transforms import roll_up


def keep_first(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """At most ``n`` rows per key group, in a deterministic order.

    Spark infers the group limit for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); raise that
    setting for larger caps.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def dedupe(df: DataFrame, key: str = "event_id", order: Sequence[Column | str] = ("ts",)) -> DataFrame:
    """First row per key; rows that agree in ``order`` are told apart by a hash of all columns that can be hashed."""
    rest = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    return keep_first(df, [key], [*order, rest], 1)


def contribution_cap(
    df: DataFrame,
    cap: int,
    keys: Sequence[Column | str] = ("contributor", "window_id", "level", "cell"),
    order: Sequence[str] = ("ts", "event_id"),
) -> DataFrame:
    """At most ``cap`` rows per contributor, window and cell; the overflow is truncated."""
    return keep_first(df, keys, list(order), cap)


def contributor_partials(df: DataFrame, lo: float, hi: float, extra: Sequence[str] = ()) -> DataFrame:
    """One row per contributor and cell with its count, clipped sum and sum of squares.

    Runs on the partitioning the cap left behind, without another shuffle.
    """
    v = clamp(F.col("value"), lo, hi)
    return df.groupBy(*extra, "contributor", "window_id", "level", "lvl", "cell").agg(
        F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )


def count_partials(df: DataFrame, item: Column, cluster: Column, cap: int, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Capped row counts per contributor and cell at every level, without ranking rows.

    Keeping at most ``cap`` rows of a contributor in a cell leaves min(cap, n) of them. Counts add up along the ladder,
    so events are counted once per contributor and item, map-side first, and only those counts are repeated per level.
    """
    items = df.groupBy(*keys, "contributor", item.alias("_item"), cluster.alias("_cluster")).agg(F.count("*").alias("n"))
    return roll_up(items, [*keys, "contributor"], ["n"]).withColumn("n", F.least(F.lit(cap), F.col("n")))


def scaled_to_cap(partials: DataFrame, cap: int, n: str, sums: Sequence[str]) -> DataFrame:
    """Contributors with more than ``cap`` rows in a cell weigh ``cap`` rows; their sums shrink in proportion.

    Bounds means without ranking rows: of outcomes in [0, 1], one contributor moves a sum by at most ``cap``.
    """
    kept = F.least(F.lit(cap), F.col(n))
    scaled = {s: F.col(s) * kept / F.greatest(F.lit(1), F.col(n)) for s in sums}
    return partials.withColumns({**scaled, n: kept})


def l0_cell_cap(partials: DataFrame, max_cells: int, secret: str, extra: Sequence[str] = (), digest: str = "md5") -> DataFrame:
    """At most ``max_cells`` cells per contributor, window and level, chosen by a keyed hash."""
    names = [F.col(x) for x in ("contributor", "window_id", "level", "cell")]
    order = keyed_uniform(secret, *names, digest=digest)
    return keep_first(partials, [*extra, "contributor", "window_id", "level"], [order, F.col("cell")], max_cells)


def stage(partials: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Staging rows per window and cell. The contributor leaves the data here."""
    sums = [F.sum("n").alias("event_count"), F.count("*").alias("contributors_count")]
    if "s" in partials.columns:
        sums += [F.sum("s").alias("value_sum"), F.sum("ss").alias("value_sumsq")]
    return partials.groupBy(*extra, "window_id", "level", "lvl", "cell").agg(*sums)


def frequency_cap(df: DataFrame, per_window: int, per_cell: int, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Per device: at most ``per_cell`` reports per cell and ``per_window`` per window."""
    capped = keep_first(df, ["contributor", "window_id", "cell"], list(order), per_cell)
    return keep_first(capped, ["contributor", "window_id"], list(order), per_window)


def balanced_sample(df: DataFrame, label: str, id_col: str, k: int, seed: str, slices: int = 65536) -> DataFrame:
    """Exactly the first ``k`` rows per class (or all of a smaller one) in keyed-hash order.

    The seed names feature, version and window. The hash range is cut into slices; only slices up to the one in which
    the k-th row falls are kept, and rows are ranked inside their slice, so a class of any size is never ranked as one.
    """
    u = keyed_uniform(seed, F.col(id_col))
    tagged = df.withColumn("_u", u).withColumn("_slice", F.floor(F.col("_u") * slices).cast("int"))
    before = F.sum("_n").over(W.partitionBy(label).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    edges = (
        tagged.groupBy(label, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(before, F.lit(0)))
        .filter(F.col("_before") < k)
    )
    rank = F.row_number().over(W.partitionBy(label, "_slice").orderBy("_u", id_col))
    near = tagged.join(edges, [label, "_slice"]).withColumn("_rn", rank)
    return near.filter(F.col("_before") + F.col("_rn") <= k).select(*df.columns)
