"""Mergeable summaries of fixed size: frequent items, counts, samples.

Each summary of a union follows from the summaries of its parts, so partitions, days and stream batches are summarised by
themselves and merged in any order. None grows with the rows or with the number of distinct items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CountMin:
    """Counters of ``depth`` rows of ``width`` buckets; an item's estimate is the least of its counters.

    An estimate is never below the count, and above it by more than ``error * rows`` with a chance of at most ``exp(-depth)``.
    Buckets come from the md5 of the item, so other engines can check them.
    """

    width: int = 256
    depth: int = 4

    @property
    def error(self) -> float:
        return math.e / self.width

    def _buckets(self, item: Column) -> Column:
        digest = F.md5(item.cast("string"))
        cells = []
        for row in range(self.depth):  # 7 hex digits a row; md5 has 32
            word = F.conv(F.substring(digest, 1 + 7 * row, 7), 16, 10).cast("bigint")
            cells.append(F.struct(F.lit(row).alias("row"), (word % self.width).cast("int").alias("bucket")))
        return F.inline(F.array(*cells))

    def __post_init__(self):
        if not 1 <= self.depth <= 4 or self.width < 1:
            raise ValueError("depth is 1 to 4, width at least 1")

    def summary(self, df: DataFrame, keys: Sequence[str], item: Column, weight: Column | None = None) -> DataFrame:
        """(keys, row, bucket, n), at most depth x width rows per key. Map tasks send no more than that either."""
        times = weight if weight is not None else F.lit(1)
        rows = df.select(*keys, times.alias("_n"), self._buckets(item))
        return rows.groupBy(*keys, "row", "bucket").agg(F.sum("_n").cast("bigint").alias("n"))

    def merged(self, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Summary per ``keys`` from summaries by finer keys, or from a union of summaries."""
        return summaries.groupBy(*keys, "row", "bucket").agg(F.sum("n").alias("n"))

    def estimates(self, items: DataFrame, summary: DataFrame, keys: Sequence[str], item: Column) -> DataFrame:
        """``items`` with ``estimate``; an item in an empty counter has none of the rows and gets 0."""
        at = items.select(*items.columns, F.struct(*items.columns).alias("_of"), self._buckets(item))
        met = at.join(summary, [*keys, "row", "bucket"], "left")
        least = met.groupBy("_of").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
        return least.select("_of.*", "estimate")


@dataclass(frozen=True)
class FrequentItems:
    """Misra-Gries summary of at most ``tracked`` items (the engine's own aggregate, built per map task and merged).

    Every item with more than ``error * rows`` rows is in it, and its count is off by at most that.
    """

    tracked: int = 384

    @property
    def error(self) -> float:
        slots = 1 << math.ceil(math.log2(self.tracked / 0.75))  # of the sketch's hash table
        return 3.5 / slots

    def summary(self, df: DataFrame, keys: Sequence[str], item: Column) -> DataFrame:
        sketch = F.call_function("approx_top_k_accumulate", item, F.lit(self.tracked))
        return df.groupBy(*keys).agg(sketch.alias("frequent"), F.count(item).alias("n_obs"))

    def merged(self, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
        sketch = F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(self.tracked))
        return summaries.groupBy(*keys).agg(sketch.alias("frequent"), F.sum("n_obs").alias("n_obs"))

    def items(self, summaries: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
        """(keys, item, summary_count, n_obs): the ``k`` items with the highest counts of each summary."""
        top = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(k))
        rows = summaries.select(*keys, "n_obs", F.explode(top).alias("_t"))
        return rows.select(*keys, F.col("_t.item").alias("item"), F.col("_t.count").alias("summary_count"), "n_obs")


def bottom_k(df: DataFrame, keys: Sequence[str], identity: Column, k: int, seed: str = "sample") -> DataFrame:
    """The ``k`` rows of each key whose identities have the smallest digests: a uniform sample without replacement.

    The sample of a union is the sample of the parts' samples. A group never meets whole in one task: the ranking keeps at
    most ``k`` rows on both sides of the shuffle.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), identity.cast("string")))
    ranked = df.withColumn("_digest", digest).withColumn(
        "_place", F.row_number().over(W.partitionBy(*keys).orderBy("_digest", identity))
    )
    return ranked.filter(F.col("_place") <= k).drop("_place", "_digest")
