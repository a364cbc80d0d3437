"""Readers that put raw tables into the shape the operators expect.

Every reader selects only the columns its consumers need, so the parquet scan stays narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shape_events(raw: DataFrame) -> DataFrame:
    """Raw events as (event_id, contributor, ts, event_type, k, value)."""
    return raw.select(
        "event_id",
        F.col("user_id").alias("contributor"),
        "ts",
        "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "value",
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return shape_events(table(spark, folder, "events"))


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Star-schema events: one row per line item, contributed by the ordering customer.

    No join hints: the size of ``part`` and ``orders`` is for the optimizer (and AQE) to judge.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("contributor")
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey")
