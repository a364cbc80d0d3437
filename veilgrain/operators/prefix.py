"""Running totals without a window over a whole group.

A plain running sum needs all rows of a group in one task. ``range_totals`` deals rows over ranges of the order and adds to every range
the totals of the ranges before it. ``running_totals`` cuts whole-number keys into blocks of ``radix`` consecutive ones, with block
totals accumulated first (recursively), and needs keys that lie close together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.operators.ranking import BLOCK_SHIFT
from veilgrain.session import store


def range_totals(df: DataFrame, group: Sequence[str], key: str, values: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over smaller keys of the group.

    ``df`` has one row per (group, key). The sums run over all groups in order; a group then takes off what came before its
    first row. Ranges come from a sample of the order, so they are even for dense numbers and for hashes alike. The dealt rows are
    stored once, so that the ranges stay what they are.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*group, key]
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = store(ranged.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_SHIFT)), "ranges")
    totals = placed.groupBy("_block").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_block", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values])
    inside = W.partitionBy("_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    everywhere = summed.join(F.broadcast(offsets), "_block").select(  # a row per range
        *df.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values]
    )
    if not group:
        return everywhere
    starts = everywhere.groupBy(*group).agg(*[F.min_by(f"before_{v}", key).alias(f"_start_{v}") for v in values])
    met = everywhere.join(starts.withColumnsRenamed({g: f"_g_{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    return met.select(*df.columns, *[(F.col(f"before_{v}") - F.col(f"_start_{v}")).alias(f"before_{v}") for v in values])


def running_totals(
    df: DataFrame, group: Sequence[str], key: str, values: Sequence[str], radix: int = 1024, levels: int = 2
) -> DataFrame:
    """Add ``before_<v>``: the sum of ``v`` over smaller keys of the group.

    ``df`` has one row per (group, key); ``key`` is a bigint.
    """
    if levels == 0:
        w = W.partitionBy(*group).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"before_{v}") for v in values])
    block = f"_block{levels}"
    tagged = df.withColumn(block, F.floor(F.col(key) / radix))
    totals = tagged.groupBy(*group, block).agg(*[F.sum(v).alias(v) for v in values])
    offsets = running_totals(totals, group, block, values, radix, levels - 1).select(
        *group, block, *[F.col(f"before_{v}").alias(f"_off_{v}") for v in values]
    )
    w = W.partitionBy(*group, block).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    inner = tagged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_in_{v}") for v in values])
    return inner.join(offsets, [*group, block]).select(
        *df.columns, *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"before_{v}") for v in values]
    )
