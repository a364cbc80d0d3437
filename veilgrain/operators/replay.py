"""Replay checks: is a second run of a job the same, row for row, and if not, where.

A run is stored with a fingerprint per partition of its keys: the number of rows and two sums of row hashes with different seeds.
Sums do not depend on the order or the number of tasks, and repeated rows count. Two runs are compared by these few rows; only
partitions that differ are compared by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.session import overwrite_partitions

PRINTS = "part int, n bigint, first decimal(38,0), second decimal(38,0), plan_fingerprint string, run string"
PARTS = 256


def part_of(key: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


def fingerprints(df: DataFrame, key: Sequence[str], parts: int = PARTS) -> DataFrame:
    """(part, n, first, second) over all columns of ``df``, in the order of their names; nulls are told from other values."""
    row = [F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})]

    def total(seed: str) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))

    return df.groupBy(part_of(key, parts).alias("part")).agg(
        F.count("*").alias("n"), total("first").alias("first"), total("second").alias("second")
    )


def record_run(df: DataFrame, path: str, run: str, key: Sequence[str], plan_fingerprint: str, parts: int = PARTS) -> None:
    """Store rows and fingerprints of one run below ``path``; the fingerprints are those of the stored rows."""
    spark = df.sparkSession
    named = df.withColumn("part", part_of(key, parts)).withColumn("run", F.lit(run))
    overwrite_partitions(named, f"{path}/rows", ["run"])
    back = rows_of(spark, path, run, df)
    prints = fingerprints(back.drop("part"), key, parts).withColumn("plan_fingerprint", F.lit(plan_fingerprint))
    overwrite_partitions(prints.withColumn("run", F.lit(run)), f"{path}/prints", ["run"])


def rows_of(spark: SparkSession, path: str, run: str, like: DataFrame) -> DataFrame:
    """The stored rows of a run with ``part``; ``like`` has their columns."""
    schema = like.withColumn("part", F.lit(0)).withColumn("run", F.lit("")).schema
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("run") == run).drop("run")


def compare_runs(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """(part, n_first, n_second, same, same_plan): one row per partition of the keys that either run has."""
    prints = spark.read.schema(PRINTS).parquet(f"{path}/prints")
    a, b = (prints.filter(F.col("run") == r).drop("run") for r in (first, second))
    met = a.alias("a").join(b.alias("b"), "part", "full")
    same = F.lit(True)
    for c in ("n", "first", "second"):
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return met.select(
        "part",
        F.coalesce("a.n", F.lit(0)).alias("n_first"),
        F.coalesce("b.n", F.lit(0)).alias("n_second"),
        same.alias("same"),
        F.coalesce(F.col("a.plan_fingerprint") == F.col("b.plan_fingerprint"), F.lit(False)).alias("same_plan"),
    )


def differing_rows(spark: SparkSession, path: str, first: str, second: str, key: Sequence[str], like: DataFrame) -> DataFrame:
    """(key, verdict) of every key whose rows differ; reads only the partitions whose fingerprints do."""
    odd = compare_runs(spark, path, first, second).filter("NOT same").select("part")

    def side(run: str, name: str) -> DataFrame:
        rows = rows_of(spark, path, run, like).join(F.broadcast(odd), "part", "left_semi")  # at most PARTS rows
        content = F.to_json(F.struct(*sorted(like.columns)), {"ignoreNullFields": "false"})
        return rows.groupBy(*key).agg(F.sort_array(F.collect_list(content)).alias(name))

    met = side(first, "_a").join(side(second, "_b"), list(key), "full")
    verdict = (
        F.when(F.col("_a").isNull(), "ONLY_SECOND").when(F.col("_b").isNull(), "ONLY_FIRST").when(F.col("_a") != F.col("_b"), "MISMATCH")
    )
    return met.select(*key, verdict.alias("verdict")).filter("verdict IS NOT NULL")
