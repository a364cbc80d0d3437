"""TransformPlan: bucketization, cell keys, encodings and the policy-safe schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.scalar import clamp
from veilgrain.schema import GRANULARITY_RANK

UNKNOWN = "UNKNOWN"


def week_id(ts: Column) -> Column:
    """Monday of the week, as yyyy-MM-dd. Dates, not instants, so the session time zone plays no part."""
    return F.trunc(F.to_date(ts), "week").cast("string")


def day_id(ts: Column) -> Column:
    return F.to_date(ts).cast("string")


def month_id(ts: Column) -> Column:
    return F.substring(F.to_date(ts).cast("string"), 1, 7)


def hour_id(ts: Column) -> Column:
    return F.concat(day_id(ts), F.lit("T"), F.lpad(F.hour(ts).cast("string"), 2, "0"))


WINDOW_ID = {"hour": hour_id, "day": day_id, "week": week_id, "month": month_id}


def bucketize_time(df: DataFrame, ts: str, granularity: str, out: str = "window_id") -> DataFrame:
    return df.withColumn(out, WINDOW_ID[granularity](F.col(ts)))


def numeric_bucket(c: Column, lo: float, hi: float, n: int) -> Column:
    """Bucket number 0..n-1 of equal-width buckets; values outside fall into the end buckets."""
    raw = F.floor((c - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(n)))
    return F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int"))


def map_dimension(df: DataFrame, mapping: DataFrame, key: str, out: str) -> DataFrame:
    """Left-join a (key, out) mapping; unmapped rows become UNKNOWN.

    The optimizer broadcasts the mapping when its measured size allows, and shuffles otherwise.
    """
    return df.join(mapping.select(key, out), key, "left").withColumn(out, F.coalesce(out, F.lit(UNKNOWN)))


def clip_numeric(c: Column, lo: float, hi: float) -> Column:
    return clamp(c, lo, hi)


def cell_key(*dims: str) -> Column:
    """Canonical cell key: bucketed dimensions joined by '|', absent ones as UNKNOWN."""
    return F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit(UNKNOWN)) for d in dims])


def ladder(df: DataFrame, item: Column, cluster: Column) -> DataFrame:
    """Each row once per granularity, with columns level, lvl and cell.

    Three rows per input row whatever the data; the copies meet map-side limits or partial
    aggregates before they are shuffled.
    """
    steps = F.array(
        *[
            F.struct(F.lit(g).alias("level"), F.lit(GRANULARITY_RANK[g]).alias("lvl"), c.cast("string").alias("cell"))
            for g, c in (("ITEM", item), ("CLUSTER", cluster), ("AGGREGATE", F.lit("all")))
        ]
    )
    return df.withColumn("_step", F.explode(steps)).select("*", "_step.*").drop("_step")


def roll_up(items: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Additive columns at every granularity, from one row per ``by``, ``_item`` and ``_cluster``.

    A cluster is a function of the item, so the rows already are the ITEM level and stay where they are; only the
    coarser levels are aggregated again. Both branches read the same exchange.
    """
    fine = items.select(
        *by, F.lit("ITEM").alias("level"), F.lit(0).alias("lvl"), F.col("_item").cast("string").alias("cell"), *sums
    )
    steps = F.array(
        F.struct(F.lit("CLUSTER").alias("level"), F.lit(1).alias("lvl"), F.col("_cluster").cast("string").alias("cell")),
        F.struct(F.lit("AGGREGATE").alias("level"), F.lit(2).alias("lvl"), F.lit("all").alias("cell")),
    )
    coarse = (
        items.select(*by, *sums, F.explode(steps).alias("_step"))
        .select(*by, "_step.*", *sums)
        .groupBy(*by, "level", "lvl", "cell")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    return fine.unionByName(coarse)


def category_index(c: Column, domain: Sequence[str]) -> Column:
    """Index 0..K-1 within a fixed public domain; null outside it."""
    pos = F.array_position(F.array(*[F.lit(v) for v in domain]), c)
    return F.when(pos > 0, (pos - 1).cast("int"))


def one_hot(index: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == index).cast("int"))


def hash_bucket(value: Column, salt: str, buckets: int) -> Column:
    """Hash of a value into 0..buckets-1, the same on every engine that has md5."""
    head = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), value.cast("string"))), 1, 12), 16, 10)
    return (head.cast("bigint") % F.lit(buckets)).cast("int")


def coarsen_bucketizations(m: Column) -> Column:
    """Halve every bucket count, at least 2."""
    return F.transform_values(m, lambda _, v: F.greatest(F.lit(2), F.floor(v / 2).cast("int")))


def coarsen_bucket(bucket: Column) -> Column:
    """Merge neighbouring buckets of already bucketized data."""
    return F.floor(bucket / 2).cast("int")


def policy_safe_schema(features: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Drop forbidden identifiers, coarsen what is left, restrict join keys to retained fields."""
    banned = F.array(*[F.lit(x) for x in forbidden])
    names = F.transform("fields", lambda f: f["name"])
    kept = F.array_except(names, banned)
    return features.select(
        "feature_id",
        kept.alias("safe_fields"),
        F.array_intersect(F.transform("join_keys", lambda k: k["name"]), kept).alias("safe_join_keys"),
        F.map_filter(
            coarsen_bucketizations(F.col("bucketizations")), lambda name, _: F.array_contains(kept, name)
        ).alias("safe_buckets"),
        F.transform(
            F.filter("fields", lambda f: f.dtype.isin("int", "float") & F.array_contains(kept, f["name"])),
            lambda f: f["name"],
        ).alias("clipped_fields"),
    )
