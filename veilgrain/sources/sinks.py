"""Writers. Every sink writes into a folder shared by all executors and is safe to repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilgrain.operators.gates import leak_guard
from veilgrain.session import run_folder

FORBIDDEN = ("contributor", "user_id", "device_id", "session_id", "email")


def write_partitioned(df: DataFrame, path: str, partition: Sequence[str], forbidden: Sequence[str] = FORBIDDEN) -> str:
    """Overwrite only the partitions present in ``df``; a repeated job leaves the same table behind.

    Rebalancing gathers each partition into few files and, under adaptive execution, splits one that is too large.
    """
    leak_guard(df, forbidden)
    df.hint("rebalance", *partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
    return path


def read_partitioned(df: DataFrame, path: str) -> DataFrame:
    """The table written from ``df``, with its schema: partition values keep their type, an empty table stays readable."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_partitioned(df: DataFrame, path: str, partition: Sequence[str], forbidden: Sequence[str] = FORBIDDEN) -> str:
    leak_guard(df, forbidden)
    df.write.mode("append").partitionBy(*partition).parquet(path)
    return path


def write_json_lines(df: DataFrame, name: str, path: str | None = None, forbidden: Sequence[str] = FORBIDDEN) -> str:
    leak_guard(df, forbidden)
    path = path or run_folder(df.sparkSession, name)
    df.write.mode("overwrite").json(path)
    return path


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def expired_partitions(spark: SparkSession, path: str, partition: str, oldest_kept: str) -> DataFrame:
    """Partition values of a staging table that are past their TTL, for the deletion job."""
    return spark.read.parquet(path).select(partition).distinct().filter(F.col(partition).cast("string") < oldest_kept)
