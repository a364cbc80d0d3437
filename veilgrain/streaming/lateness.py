"""Allowed lateness with the late rows as a second output.

A stateful operator drops late rows and keeps only a count of them for as long as progress reports are kept. Here every batch is
split before anything is aggregated: the watermark is the newest event time of all batches before it, less the allowed
lateness, and it is stored with the batch id. Rows whose window was closed by then go to an audit table; the others are aggregated
per batch into parts that add up. A replayed batch finds the same watermark and replaces exactly what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.session import overwrite_partitions, read_or_empty
from veilgrain.streaming.ingest import run_batches

MARKS = "newest timestamp, batch_id bigint"


@dataclass(frozen=True)
class Split:
    """Outcome of ``split_late``: aggregated parts by batch, late rows, and the final watermark (None without rows)."""

    parts: DataFrame
    late: DataFrame
    watermark: object


def newest_before(spark: SparkSession, path: str, batch_id: int):
    """Newest event time of all batches before ``batch_id``, None if there was none.

    Marks are cumulative, so the last one is enough; each is a partition of its own and only one is read.
    """
    if batch_id == 0:
        return None
    marks = read_or_empty(spark, MARKS, f"{path}/marks")
    row = marks.filter(F.col("batch_id") == batch_id - 1).agg(F.max("newest").alias("t")).first()
    if row["t"] is None:  # no mark of that batch: look through all of them
        row = marks.filter(F.col("batch_id") < batch_id).agg(F.max("newest").alias("t")).first()
    return row["t"]


def split_batch(
    df: DataFrame, batch_id: int, path: str, lateness_seconds: int, closes: Column, aggregate: Callable[[DataFrame], DataFrame],
    ts: str = "ts",
) -> None:
    """Write late rows, parts and mark of one batch below ``path``; the same batch id replaces them."""
    spark = df.sparkSession
    before = newest_before(spark, path, batch_id)
    df = df.persist()
    number = F.lit(batch_id).cast("bigint").alias("batch_id")
    untimed = df.filter(F.col(ts).isNull()).select("*", F.lit("NO_TIME").alias("reject_reason"))
    timed = df.filter(F.col(ts).isNotNull())  # a time window drops rows without a time
    if before is None:
        rejected, on_time = untimed, timed
    else:
        wm = F.lit(before) - F.make_dt_interval(secs=F.lit(lateness_seconds))
        known = timed.withColumn("_closed", closes <= wm)
        late = known.filter("_closed").drop("_closed").select("*", F.lit("LATE").alias("reject_reason"))
        rejected, on_time = untimed.unionByName(late), known.filter("NOT _closed").drop("_closed")
    overwrite_partitions(rejected.select("*", number), f"{path}/late", ["batch_id"])
    overwrite_partitions(aggregate(on_time).select("*", number), f"{path}/parts", ["batch_id"])
    newest = df.agg(F.max(ts).alias("newest"))
    mark = newest.select(F.greatest(F.col("newest"), F.lit(before).cast("timestamp")).alias("newest"), number)
    overwrite_partitions(mark, f"{path}/marks", ["batch_id"])
    df.unpersist()


def split_late(
    stream: DataFrame, lateness_seconds: int, closes: Column, aggregate: Callable[[DataFrame], DataFrame], ts: str = "ts"
) -> Split:
    """Process everything available. ``closes`` is when a row's window ends; ``aggregate`` must give parts that add up.

    A row is late when its window has ended by the watermark, which is when a windowed aggregation would drop it; a row
    without a time is rejected, too. Parts and late rows carry ``batch_id``; together they cover every row of the stream.
    """
    spark = stream.sparkSession

    def handle(df: DataFrame, batch_id: int, path: str) -> None:
        split_batch(df, batch_id, path, lateness_seconds, closes, aggregate, ts)

    path = run_batches(stream, "lateness", handle)
    number = F.lit(0).cast("bigint").alias("batch_id")
    parts = read_or_empty(spark, aggregate(stream).select("*", number).schema, f"{path}/parts")
    rejected = stream.select("*", F.lit("").alias("reject_reason"), number)
    late = read_or_empty(spark, rejected.schema, f"{path}/late")
    end = read_or_empty(spark, MARKS, f"{path}/marks").agg(
        F.max("newest") - F.make_dt_interval(secs=F.lit(lateness_seconds))
    ).first()[0]
    return Split(parts, late, end)
