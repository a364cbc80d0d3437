"""Shuffle boundary: messages without identifiers, mixing, aggregation, estimation and release.

"Mixing" here is the permutation that unlinks messages from senders, not Spark's exchange of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilgrain.functions.noise import gaussian, keyed_uniform
from veilgrain.operators.local_dp import keep_probability
from veilgrain.session import overwrite_partitions, read_or_empty

SLICE_ROWS = 4096  # messages of a window that are ranked in one task, about
MESSAGE_COLUMNS = ("window_id", "cell", "protocol_type", "format", "data", "epsilon_local", "sample_rate")


def shufflable_messages(df: DataFrame, protocol: Column, fmt: Column, data: Column, epsilon_local: float | None,
                        sample_rate: float) -> DataFrame:
    """Bucketed dimensions plus payload; nothing that names or links the sender."""
    eps = F.lit(epsilon_local).cast("double")
    return df.select(
        "window_id",
        "cell",
        protocol.alias("protocol_type"),
        F.lit(epsilon_local is not None).alias("local_randomization_enabled"),
        eps.alias("epsilon_local"),
        fmt.alias("format"),
        data.alias("data"),
        F.lit(sample_rate).alias("sample_rate"),
    )


def shuffle_mix(df: DataFrame, row_key: Sequence[str], window: str, batch_size: int, min_batch: int, secret: str,
                payload: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Messages of each window in even batches of at least ``batch_size`` in a secret order, and the windows held back.

    A window of fewer than ``min_batch`` messages is held back as a whole and reported as (window, n); one of fewer than
    ``batch_size`` is a single batch. The message key decides the place and is then removed together with every other
    linkable column. Places are counted in slices of the hash range, so no window is ranked in one task.
    """
    sizes = df.groupBy(window).agg(F.count("*").alias("_size"))
    held = sizes.filter(F.col("_size") < min_batch).select(window, F.col("_size").alias("n"))
    kept = with_draws(df, row_key, secret).join(sizes.filter(F.col("_size") >= min_batch), window)
    return _in_batches(kept, window, batch_size, row_key, payload), held


def with_draws(df: DataFrame, row_key: Sequence[str], secret: str) -> DataFrame:
    """Add the secret draws that place a message: ``_u`` for its batch, ``_order`` for its place in it."""
    key = [F.col(k) for k in row_key]
    return df.withColumn("_u", keyed_uniform(secret, *key, "batch")).withColumn("_order", keyed_uniform(secret, *key, "order"))


def _in_batches(drawn: DataFrame, window: str, batch_size: int, ties: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """(window, batch_id, payload) of messages with draws and ``_size``, the number of messages of their window."""
    drawn = drawn.withColumn("_slice", F.floor(F.col("_u") * F.ceil(F.col("_size") / SLICE_ROWS)))
    earlier = W.partitionBy(window).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = drawn.groupBy(window, "_slice").agg(F.count("*").alias("_n")).select(
        window, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    here = F.row_number().over(W.partitionBy(window, "_slice").orderBy("_u", *ties))
    batches = F.greatest(F.lit(1), F.floor(F.col("_size") / batch_size))
    place = F.col("_before") + F.col("_place") - 1
    batched = (
        drawn.withColumn("_place", here)
        .join(starts, [window, "_slice"])
        .withColumn("batch_id", F.floor(place * batches / F.col("_size")))
    )
    return (
        batched.repartition(window, "batch_id", F.floor(F.col("_order") * 16))
        .sortWithinPartitions(window, "batch_id", "_order")
        .select(window, "batch_id", *payload)
    )


@dataclass(frozen=True)
class Mixer:
    """Mixing over many runs: what is too little for a batch waits in a stored hold table and joins a later run.

    A run takes its own messages and those held by the run before. At ``min_batch`` messages all of them go out in even batches of
    at least ``batch_size`` (one batch if fewer). Otherwise they wait; once the oldest has waited ``max_wait`` runs, ``timed_batch``
    messages are enough. The hold table keeps payload and secret draws, never the message key, and holds fewer than ``min_batch``
    messages. Tables are kept per run below ``path``: repeating a run replaces what it wrote.
    """

    path: str
    batch_size: int
    min_batch: int
    secret: str
    payload: tuple[str, ...]
    max_wait: int | None = None
    timed_batch: int = 1

    def _state(self, spark: SparkSession, name: str, fields: StructType, more: str) -> DataFrame:
        schema = StructType(list(fields.fields))  # add() changes its list
        for part in more.split(", "):
            schema = schema.add(*part.split(" "))
        return read_or_empty(spark, schema.add("run", "long"), f"{self.path}/{name}")

    def run(self, messages: DataFrame, run: int, row_key: Sequence[str]) -> None:
        """Mix or hold the messages of run ``run`` = 0, 1, 2, ...; ``messages`` holds the payload columns and the key."""
        spark = messages.sparkSession
        arrived = with_draws(messages, row_key, self.secret).select(*self.payload, "_u", "_order", F.lit(run).cast("bigint").alias("since"))
        pool = arrived
        if run:
            before = self.held(spark, messages.select(*self.payload).schema).filter(F.col("run") == run - 1).drop("run")
            pool = arrived.unionByName(before)
        pool = pool.persist()
        n, oldest = pool.agg(F.count("*"), F.min("since")).first()
        waited = self.max_wait is not None and n >= self.timed_batch and run - (run if oldest is None else oldest) >= self.max_wait
        go = n >= self.min_batch or waited
        sized = pool.withColumn("_size", F.lit(n)).withColumn("run", F.lit(run).cast("bigint"))
        out = _in_batches(sized if go else sized.limit(0), "run", self.batch_size, ["_order"], self.payload)
        overwrite_partitions(out, f"{self.path}/mixed", ["run"])
        keep = (sized.limit(0) if go else sized).drop("_size")
        overwrite_partitions(keep, f"{self.path}/hold", ["run"])
        pool.unpersist()

    def mixed(self, spark: SparkSession, fields: StructType) -> DataFrame:
        """(payload, batch_id, run) of all runs so far."""
        return self._state(spark, "mixed", fields, "batch_id long")

    def held(self, spark: SparkSession, fields: StructType) -> DataFrame:
        """(payload, draws, since, run): the hold table after each run."""
        return self._state(spark, "hold", fields, "_u double, _order double, since long")


def aggregate_messages(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n and Y per cell and payload position: increments, category counts, vector and sketch sums."""
    d = F.col("data")
    pos = F.when(F.col("format") == "category", d[0]).when(F.col("format") == "sketch", F.get(d, F.lit(1)))
    row = F.when(F.col("format") == "sketch", d[0]).otherwise(0)
    y = F.when(F.col("format") == "category", 1).when(F.col("format") == "sketch", F.get(d, F.lit(2))).otherwise(d[0])
    scalars = df.filter("format <> 'vector'").select(
        *keys, "format", row.alias("row"), F.coalesce(pos, F.lit(0)).alias("pos"), y.alias("y")
    )
    vectors = df.filter("format = 'vector'").select(
        *keys, "format", F.lit(0).alias("row"), F.posexplode("data").alias("pos", "y")
    )
    return scalars.unionByName(vectors).groupBy(*keys, "format", "row", "pos").agg(
        F.count("*").alias("n"), F.sum("y").alias("y")
    )


def estimate(sums: DataFrame, epsilon_local: float | None) -> DataFrame:
    """Debias bit sums when messages were randomized, identity otherwise."""
    if epsilon_local is None:
        return sums.withColumn("estimate_value", F.col("y").cast("double")).withColumn("variance", F.lit(0.0))
    p = keep_probability(epsilon_local)
    return sums.withColumn("estimate_value", (F.col("y") - F.col("n") * (1 - p)) / (2 * p - 1)).withColumn(
        "variance", F.col("n") * (p * (1 - p) / (2 * p - 1) ** 2)
    )


def harden(df: DataFrame, sd: float, secret: str, key: Sequence[str]) -> DataFrame:
    """Optional central Gaussian noise on top of the estimate."""
    noise = sd * gaussian(secret, *[F.col(k) for k in key], "harden")
    return df.withColumn("estimate_value", F.col("estimate_value") + noise).withColumn(
        "variance", F.col("variance") + sd * sd
    )


def with_interval(df: DataFrame, value: str, z: float = 1.959964) -> DataFrame:
    sd = F.sqrt("variance")
    return df.withColumn("ci_lower", F.col(value) - z * sd).withColumn("ci_upper", F.col(value) + z * sd)


def planned_local_epsilon(epsilon: float, n: Column, delta: float) -> Column:
    """Planning approximation eps * sqrt(n) / ln(1/delta). It grows without bound; never release under it."""
    return epsilon * F.sqrt(n) / math.log(1.0 / delta)


def amplified_epsilon(epsilon_local: float, n: Column, delta: float) -> Column:
    """Published closed-form bound on the central epsilon of n shuffled reports; null where it does not apply."""
    e = math.exp(epsilon_local)
    gain = 8.0 * math.sqrt(e * math.log(4.0 / delta)) / F.sqrt(n) + 8.0 * e / n
    applies = F.lit(epsilon_local) <= F.log(n / (16.0 * math.log(2.0 / delta)))
    return F.when(applies, F.log(1.0 + (e - 1.0) / (e + 1.0) * gain))


def planned_variance(epsilon0: Column, n: Column) -> Column:
    """Noise variance of a randomized-response count of n reports at local epsilon0."""
    return n * (F.exp(epsilon0) + 1.0) / F.pow(F.exp(epsilon0) - 1.0, 2)
