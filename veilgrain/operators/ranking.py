"""Row numbers over a whole table without a window that holds it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.session import store

BLOCK_SHIFT = 33  # monotonically_increasing_id keeps the row of a partition in its low 33 bits
ROWS_OF_BLOCK = (1 << BLOCK_SHIFT) - 1


def with_global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``df`` with ``name`` long: 1, 2, 3, ... over all rows in ``order``.

    Rows are dealt over ranges of the order, numbered inside each range, and every range adds the rows of the ranges
    before it. Equal rows are numbered in any order; end ``order`` with a unique column where that matters, also so that
    one value that many rows share is dealt over several ranges. The numbered rows are stored once, so that all readers
    see the same numbers. An empty table gives an empty table. A column called ``name`` must not exist yet.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = store(
        ranged.select(
            F.struct("*").alias("row"),
            F.shiftright(place, BLOCK_SHIFT).alias("block"),
            (place.bitwiseAND(F.lit(ROWS_OF_BLOCK)) + 1).alias("place"),
        ),
        "ranks",
    )
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # a row per partition
    return placed.join(F.broadcast(before), "block").select("row.*", (F.col("before") + F.col("place")).alias(name))
