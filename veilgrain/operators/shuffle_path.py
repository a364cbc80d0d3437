"""The shuffle boundary end to end: client gates, messages, shuffler, server.

Client: dimensions with their fallback, policy and consent, sampling, frequency caps, encoding, light randomization. Shuffler:
validation and mixing over runs with a hold table. Server: the same validation again, sums, unbiased estimates scaled to the sampling
rate, central noise, released rows. Every stage returns what it rejected, with the reason, beside what it passed on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.operators import bounding, gates
from veilgrain.operators import local_dp as ld
from veilgrain.operators import shuffle_dp as sh
from veilgrain.operators.transforms import UNKNOWN

DIMS = ("geo_bucket", "cluster_id", "age_bucket")
PAYLOAD = ("contract_id", "contract_version", "feature_id", "window_id", *DIMS, "protocol_type",
           "local_randomization_enabled", "epsilon_local", "format", "data", "sample_rate")


@dataclass(frozen=True)
class ShuffleConfig:
    """What a SHUFFLE contract fixes for a bounded count of one feature."""

    contract_id: str
    contract_version: str
    feature_id: str
    secret: str
    epsilon_local: float | None = 2.0
    sample_rate: float = 1.0
    max_per_window: int = 5  # messages of a contributor in a window
    max_per_cell: int = 3  # of these in one cell
    cap: int = 1  # largest increment
    noise_sd: float = 0.0
    window_pattern: str = r"^\d{4}-\d{2}-\d{2}$"


def client(events: DataFrame, policies: DataFrame, consent: DataFrame, c: ShuffleConfig, value: Column) -> tuple[DataFrame, DataFrame]:
    """(messages with their event_id, rejected events with a reason).

    ``events``: event_id, contributor, ts, window_id, region and the dimensions; ``value`` is the 0/1 contribution. A null
    dimension becomes UNKNOWN. Events left out by sampling or caps are not rejects: nothing was wrong with them.
    """
    known = events.withColumns({d: F.coalesce(F.col(d), F.lit(UNKNOWN)) for d in DIMS}).withColumn("feature_id", F.lit(c.feature_id))
    gated = gates.policy_gate(known, policies, consent)
    ok = gates.sampling_gate(gates.passed(gated), c.sample_rate, c.secret, ["event_id"])
    ok = bounding.contribution_cap(ok, c.max_per_cell, ("contributor", "window_id", *DIMS))
    ok = bounding.contribution_cap(ok, c.max_per_window, ("contributor", "window_id"))
    bit = value.cast("int")
    if c.epsilon_local is not None:
        bit = ld.rr_binary(bit, c.epsilon_local, c.secret, F.col("event_id"))
    messages = ok.select(
        "event_id",  # places the message in a batch and is gone after mixing
        F.lit(c.contract_id).alias("contract_id"),
        F.lit(c.contract_version).alias("contract_version"),
        "feature_id",
        "window_id",
        *DIMS,
        F.lit("SHUFFLE_COUNT").alias("protocol_type"),
        F.lit(c.epsilon_local is not None).alias("local_randomization_enabled"),
        F.lit(c.epsilon_local).cast("double").alias("epsilon_local"),
        F.lit("bounded_increment").alias("format"),
        F.array(bit).alias("data"),
        F.lit(c.sample_rate).alias("sample_rate"),
    )
    return messages, gates.rejected(gated).select("event_id", F.lit("client").alias("stage"), gates.REASON)


def validate(messages: DataFrame, allowed: DataFrame, c: ShuffleConfig) -> DataFrame:
    """Messages with the first check they fail, of contract, window, dimensions and payload; one pass over the rows."""
    checks = [
        lambda df: gates.contract_gate(df, allowed, "SHUFFLE"),
        lambda df: gates.label(df, [("REJECT_CONTRACT:WINDOW_ID", F.col("window_id").rlike(c.window_pattern))]),
        lambda df: gates.schema_gate(df, ["feature_id", "protocol_type", *DIMS], ("contributor", "user_id", "device_id")),
        lambda df: gates.payload_gate(df, cap=c.cap, categories=2, width=1, depth=1, max_update=1),
    ]
    for i, check in enumerate(checks):
        messages = check(messages).withColumnRenamed(gates.REASON, f"_reason{i}")
    names = [f"_reason{i}" for i in range(len(checks))]
    return messages.withColumn(gates.REASON, F.coalesce(*names)).drop(*names)


def shuffler(messages: DataFrame, allowed: DataFrame, mixer: sh.Mixer, c: ShuffleConfig, runs: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mixed messages, held messages, rejects): the windows ``runs`` are mixed one after the other."""
    spark = messages.sparkSession
    checked = validate(messages, allowed, c)
    good = gates.passed(checked)
    for number, window in enumerate(runs):
        mixer.run(good.filter(F.col("window_id") == window), number, ["event_id"])
    fields = good.select(*PAYLOAD).schema
    held = mixer.held(spark, fields).filter(F.col("run") == len(runs) - 1).select(*PAYLOAD)
    bad = gates.rejected(checked).select("event_id", F.lit("shuffler").alias("stage"), gates.REASON)
    return mixer.mixed(spark, fields), held, bad


def server(mixed: DataFrame, allowed: DataFrame, c: ShuffleConfig, release_ts_ms: int) -> DataFrame:
    """Released rows: per window and cell the unbiased estimate of the true count, with variance and interval."""
    good = gates.passed(validate(mixed, allowed, c))
    keys = ["contract_id", "contract_version", "feature_id", "window_id", *DIMS]
    sums = sh.aggregate_messages(good, keys).drop("format", "row", "pos")
    est = sh.estimate(sums, c.epsilon_local)
    scaled = est.withColumn("estimate_value", ld.scale_by_sample_rate(F.col("estimate_value"), c.sample_rate)).withColumn(
        "variance", F.col("variance") / (c.sample_rate * c.sample_rate)
    )
    hard = sh.harden(scaled, c.noise_sd, c.secret, ["window_id", *DIMS]) if c.noise_sd else scaled
    return sh.with_interval(hard, "estimate_value").select(
        *keys, "estimate_value", "variance", "ci_lower", "ci_upper", F.lit("SHUFFLE_COUNT").alias("protocol_type"),
        F.lit(c.epsilon_local is not None).alias("local_randomization_enabled"),
        F.lit(c.epsilon_local).cast("double").alias("epsilon_local"), F.lit(c.sample_rate).alias("sample_rate"),
        F.lit(release_ts_ms).cast("bigint").alias("release_ts_ms"),
    )
