"""Structured Streaming: event streams, gates, deduplication and contribution caps at ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilgrain.operators import bounding, gates, sketches
from veilgrain.session import overwrite_partitions, read_or_empty, run_folder
from veilgrain.sources.tables import shape_events

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, files: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded events from the files of a folder; ``ts`` becomes a timestamp with zone, which watermarks require."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return shape_events(reader.parquet(folder)).withColumn("ts", F.col("ts").cast("timestamp"))


def with_watermark(stream: DataFrame, lateness: str, ts: str = "ts") -> DataFrame:
    """Rows older than the watermark are dropped by stateful operators and counted in the query progress."""
    return stream.withWatermark(ts, lateness)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as late, from the progress reports Spark still keeps: of a long stream only the last batches.

    ``lateness.split_late`` keeps the rows themselves, of any number of batches.
    """
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def _use_rocksdb(spark: SparkSession) -> None:
    # state larger than memory stays on local disk and is checkpointed incrementally
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_table(stream: DataFrame, name: str, partition: list[str] | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Process everything available and append it to a parquet table; (table, finished query)."""
    spark = stream.sparkSession
    _use_rocksdb(spark)
    folder = run_folder(spark, name)
    path = f"{folder}/data"
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    if partition:
        writer = writer.partitionBy(*partition)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), query


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Process everything available with ``handle(batch, batch_id, folder)``; returns the output folder."""
    spark = stream.sparkSession
    _use_rocksdb(spark)
    folder = run_folder(spark, name)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(lambda df, batch_id: handle(df, batch_id, f"{folder}/data"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{folder}/data"


def dedupe_stream(stream: DataFrame, key: str, lateness: str) -> DataFrame:
    """First delivery of each key; its state expires with the watermark."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def split_ingest(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stream labelled by a gate as (passed, rejected) rows, each in a table of its own.

    Partitions carry the batch id, so a replayed batch replaces what it wrote before.
    """

    def split(df: DataFrame, batch_id: int, path: str) -> None:
        df = df.withColumn("batch_id", F.lit(batch_id)).persist()
        overwrite_partitions(gates.passed(df), f"{path}/passed", ["batch_id"])
        overwrite_partitions(gates.rejected(df), f"{path}/rejected", ["batch_id"])
        df.unpersist()

    path = run_batches(gated, "gated-ingest", split)
    spark, number = gated.sparkSession, F.lit(0).alias("batch_id")
    return (
        read_or_empty(spark, gates.passed(gated).withColumn("batch_id", number).schema, f"{path}/passed").drop("batch_id"),
        read_or_empty(spark, gates.rejected(gated).withColumn("batch_id", number).schema, f"{path}/rejected").drop("batch_id"),
    )


def gated_ingest(stream: DataFrame, allowed: DataFrame, boundary: str) -> tuple[DataFrame, DataFrame]:
    """Contract gate on a stream: (passed, rejected) rows."""
    return split_ingest(gates.contract_gate(stream, allowed, boundary))


def domain_ingest(stream: DataFrame, cell: Column, domain: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected) rows of a stream by whether their cell is in a public domain; a null cell is outside."""
    return split_ingest(gates.label(stream, [("REJECT_DOMAIN", cell.isin(*domain))]))


def capped_ingest(stream: DataFrame, cap: int) -> DataFrame:
    """Contribution cap at ingest: the stored parts of all batches, to be merged by ``merge_capped``.

    Each batch keeps at most ``cap`` rows per contributor, window and cell and writes them under its batch id. The cap
    of a union of capped parts is the cap of all rows, so the merged result is exact, and nothing ever holds more than
    ``cap`` rows per group and batch.
    """

    def write(df: DataFrame, batch_id: int, path: str) -> None:
        capped = bounding.contribution_cap(df, cap).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        overwrite_partitions(capped, path, ["window_id", "batch_id"])

    path = run_batches(stream, "capped-ingest", write)
    schema = stream.withColumn("batch_id", F.lit(0).cast("bigint")).schema
    return read_or_empty(stream.sparkSession, schema, path)


def sampled_ingest(stream: DataFrame, keys: list[str], identity: str, k: int) -> DataFrame:
    """Bottom-k sample at ingest: the samples of all batches, to be merged by ``sketches.bottom_k`` with the same keys.

    A batch leaves at most ``k`` rows per key under its batch id; a replayed batch replaces them.
    """

    def write(df: DataFrame, batch_id: int, path: str) -> None:
        sample = sketches.bottom_k(df, keys, F.col(identity), k).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        overwrite_partitions(sample, path, ["batch_id"])

    path = run_batches(stream, "sampled-ingest", write)
    schema = stream.withColumn("batch_id", F.lit(0).cast("bigint")).schema
    return read_or_empty(stream.sparkSession, schema, path)


def merge_capped(parts: DataFrame, cap: int) -> DataFrame:
    return bounding.contribution_cap(parts.drop("batch_id"), cap)
