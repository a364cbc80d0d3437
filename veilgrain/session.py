"""Session helpers: a tuned local session and the shared folder used for checkpoints and sinks."""

from __future__ import annotations

import contextlib
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and bench runs on one machine. On a cluster, use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilgrain")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


ROWS_PER_TASK = 100_000  # of the table that a job is sized for
TASK_BYTES = 4 << 20  # of a file or an exchange, compressed


def sized_session(spark: SparkSession, rows: int) -> SparkSession:
    """A session of its own for a job over ``rows`` rows, with the settings of ``spark`` but tasks of a bounded size.

    At the defaults a task reads up to 128 MB of a file and 64 MB of an exchange, and more of it once the fixed number of
    partitions is used up. Narrow, well-compressed rows take twenty times that in a hash table, so the memory of a task would
    grow with the tables. Here the number of tasks grows instead. Settings that are finer already stay.
    """
    if spark.sparkContext.master.startswith("local"):
        shared_root(spark)  # one temporary folder for all jobs of a local session
    job = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if job.conf.isModifiable(key):
            job.conf.set(key, value)
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    job.conf.set("spark.sql.shuffle.partitions", str(max(current, math.ceil(rows / ROWS_PER_TASK))))
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if _byte_count(spark.conf.get(key)) > TASK_BYTES:
            job.conf.set(key, str(TASK_BYTES))
    return job


def _byte_count(setting: str) -> int:
    """Bytes of a size as Spark writes it, such as 64MB, 16m or 134217728b."""
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit[:1]]


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="veilgrain-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared root for one run."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver's JVM ends."""
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(folder)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that several branches of a job read: without it every branch would repeat the scan behind them, as
    the branches need different columns and so share no exchange. The stored table survives the loss of executors.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def record_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Send at most ``rows`` rows at once to Python while jobs of the block run; a smaller setting stays.

    At the default of 10,000 a task of whole texts is one batch, held beside its copy by the executor and by its worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared root unless the session already has a directory."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def read_or_empty(spark: SparkSession, schema: StructType | str, path: str) -> DataFrame:
    """The Parquet table at ``path``, without rows if nothing has been written there: empty partitions leave no folder."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def overwrite_partitions(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace the partitions present in ``df``; rebalancing keeps files few and splits a partition that is too large."""
    df.hint("rebalance", *partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)
