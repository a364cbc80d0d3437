"""Windowed streaming aggregates: staging, sliding statistics, sessions, sketches and release.

Exact distinct contributors come from two chained aggregations (contributor and cell, then cell): the first one is
also what keeps a hot cell from ending up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.scalar import clamp
from veilgrain.operators import central
from veilgrain.operators.gates import leak_guard
from veilgrain.schema import ReleaseContract
from veilgrain.session import overwrite_partitions, read_or_empty
from veilgrain.sources.sinks import FORBIDDEN
from veilgrain.streaming.ingest import run_batches


def window_name() -> Column:
    """The day a window starts, with hour and minute where windows are shorter than a day."""
    day = F.to_date("window.start").cast("string")
    short = F.date_format("window.start", "yyyy-MM-dd'T'HH:mm")
    return F.when(F.expr("window.end - window.start >= INTERVAL '1' DAY"), day).otherwise(short)


def bounded_tumbling_staging(stream: DataFrame, length: str, cell: Column, domain: Sequence[str], c: ReleaseContract,
                             contributor: str = "contributor") -> DataFrame:
    """Per closed window and cell of a public domain, every contributor within the contract's bounds. Append mode.

    A contributor counts for at most ``cap`` rows of a cell, and its clipped values for at most ``cap`` times the
    largest one. The domain may hold at most ``max_cells`` cells, so nobody can touch more; rows outside it belong to
    no cell that the contract releases. ``ingest.domain_ingest`` keeps them as rejects.
    """
    if len(set(domain)) > c.max_cells:
        raise ValueError(f"{len(set(domain))} cells, but the contract bounds contributors to {c.max_cells}")
    most = c.cap * max(abs(c.lo), abs(c.hi))
    value = clamp(F.col("value"), c.lo, c.hi)
    named = stream.withColumn("cell", cell).filter(F.col("cell").isin(*domain))
    per_person = named.groupBy(F.window("ts", length), "cell", contributor).agg(
        F.least(F.lit(c.cap), F.count("*")).alias("n"), clamp(F.sum(value), -most, most).alias("v")
    )
    return (
        per_person.groupBy("window", "cell")
        .agg(F.sum("n").alias("event_count"), F.sum("v").alias("value_sum"), F.count("*").alias("contributors_count"))
        .select(window_name().alias("window_id"), "cell", "event_count", "value_sum", "contributors_count")
    )


def tumbling_staging(stream: DataFrame, length: str, dims: Sequence[str], value: Column, contributor: str = "contributor") -> DataFrame:
    """Per closed window and cell: rows, value sum and distinct contributors. Append mode."""
    per_person = stream.groupBy(F.window("ts", length), *dims, contributor).agg(
        F.count("*").alias("n"), F.sum(value).alias("v")
    )
    return (
        per_person.groupBy("window", *dims)
        .agg(F.sum("n").alias("event_count"), F.sum("v").alias("value_sum"), F.count("*").alias("contributors_count"))
        .select(window_name().alias("window_id"), *dims, "event_count", "value_sum", "contributors_count")
    )


def sliding_stats(stream: DataFrame, length: str, dims: Sequence[str], outcome: Column) -> DataFrame:
    """Rolling windows that end every day, built from daily partials, so an event is not copied into each window."""
    daily = stream.groupBy(F.window("ts", "1 day"), *dims).agg(F.count("*").alias("n"), F.sum(outcome).alias("y"))
    at = daily.withColumn("day", F.window_time("window"))
    return (
        at.groupBy(F.window("day", length, "1 day").alias("span"), *dims)
        .agg(F.sum("n").alias("n_obs"), F.sum("y").alias("y"))
        .select(
            F.to_date("span.start").alias("from_day"), F.to_date("span.end").alias("to_day"), *dims, "n_obs",
            (F.col("y") / F.col("n_obs")).alias("rate"),
        )
    )


def session_counts(stream: DataFrame, gap: str, contributor: str = "contributor") -> DataFrame:
    """Rows per session. The contributor only keys the session and is left behind."""
    return (
        stream.groupBy(F.session_window("ts", gap), contributor)
        .agg(F.count("*").alias("n"))
        .select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")
    )


KLL_K = 800  # size of the value sketches
RANK_ERROR = 0.0133  # of a quantile; a sketch of this size stays within a third of it in 99 of 100 cases


def sketch_stats(stream: DataFrame, length: str, dims: Sequence[str], contributor: str, value: str) -> DataFrame:
    """Mergeable sketches per window: distinct contributors (HLL) and the value distribution (KLL)."""
    return (
        stream.groupBy(F.window("ts", length), *dims)
        .agg(
            F.count("*").alias("n_obs"),
            F.hll_sketch_agg(contributor, F.lit(12)).alias("contributors_sketch"),
            F.kll_sketch_agg_double(value, F.lit(KLL_K)).alias("value_sketch"),
        )
        .select(window_name().alias("window_id"), *dims, "n_obs", "contributors_sketch", "value_sketch")
    )


def merged_sketches(sketches: DataFrame, dims: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """Estimates over all windows of ``sketch_stats``: n_obs, contributors_est and quantile values in the given order."""
    merged = sketches.groupBy(*dims).agg(
        F.sum("n_obs").alias("n_obs"),
        F.hll_sketch_estimate(F.hll_union_agg("contributors_sketch")).alias("contributors_est"),
        F.kll_merge_agg_double("value_sketch", F.lit(KLL_K)).alias("_values"),
    )
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    return merged.select(
        *dims, "n_obs", "contributors_est", F.kll_sketch_get_quantile_double("_values", ranks).alias("quantiles")
    )


def release_stream(staging: DataFrame, c: ReleaseContract, release_ts_ms: int) -> DataFrame:
    """Closed windows of a bounded staging stream through k gate and noise into the released table, one partition per window.

    A replayed batch overwrites its windows with the same rows: the noise is keyed, not drawn anew.
    """

    def released(df: DataFrame) -> DataFrame:
        kept = central.k_gate(df, c.k_min).filter("passes")
        return leak_guard(central.with_provenance(central.dp_metrics(kept, c), c, release_ts_ms), FORBIDDEN)

    path = run_batches(staging, "stream-release", lambda df, _, out: overwrite_partitions(released(df), out, ["window_id"]))
    return read_or_empty(staging.sparkSession, released(staging).schema, path)
