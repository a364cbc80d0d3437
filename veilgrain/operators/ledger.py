"""Sliding-window privacy budget with basic (sequential) composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.schema import LEDGER

EXACT_DIGITS = 12  # sums of daily spends are compared after rounding; their order of addition is not fixed


def ledger_rows(df: DataFrame) -> DataFrame:
    """Fill ledger defaults and put the columns in table order."""
    defaults = {"accountant": F.lit("BASIC"), "delta_spend": F.lit(0.0), "status": F.lit("COMMITTED"),
                "created_at": F.current_timestamp()}
    for c, value in defaults.items():
        df = df.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns else value)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER])


def duplicate_keys(ledger: DataFrame) -> DataFrame:
    """Primary-key violations: more than one row per feature, contract version and day."""
    return ledger.groupBy("feature_id", "contract_version", "window_day").agg(F.count("*").alias("n")).filter("n > 1")


def window_spend(ledger: DataFrame, window_days: int) -> DataFrame:
    """Spend in the ``window_days`` days up to and including each day with a spend."""
    daily = ledger.groupBy("feature_id", "window_day").agg(
        F.sum("epsilon_spend").alias("eps"), F.sum("delta_spend").alias("dlt")
    )
    w = W.partitionBy("feature_id").orderBy(F.unix_date("window_day")).rangeBetween(-(window_days - 1), 0)
    return daily.select(
        "feature_id",
        "window_day",
        "eps",
        "dlt",
        F.sum("eps").over(w).alias("spent_epsilon"),
        F.sum("dlt").over(w).alias("spent_delta"),
    )


def can_spend(spent_eps: Column, spent_delta: Column, next_eps: Column, next_delta: Column,
              eps_cap: float, delta_cap: float) -> Column:
    return (F.round(spent_eps + next_eps, EXACT_DIGITS) <= eps_cap) & (
        F.round(spent_delta + next_delta, EXACT_DIGITS) <= delta_cap
    )


def adaptive_epsilon(spent_eps: Column, eps_cap: float, releases_left: Column) -> Column:
    """Spread what is left of the cap evenly; nothing once no release is left."""
    remaining = F.greatest(F.lit(0.0), F.lit(eps_cap) - spent_eps)
    return F.when(releases_left > 0, remaining / releases_left).otherwise(F.lit(0.0))


def exposure(ledger: DataFrame, eps_max: float, keys: tuple[str, ...] = ("feature_id",)) -> DataFrame:
    """Effective epsilon over the whole window and its score in [0, 1]."""
    total = ledger.groupBy(*keys).agg(F.sum("epsilon_spend").alias("eps_eff"))
    return total.withColumn("s_eps", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("eps_eff") / F.lit(eps_max))))


def commit_spend(released: DataFrame, epsilon: float, delta: float, boundary: str, contract_version: str,
                 privacy_unit: str = "user") -> DataFrame:
    """One ledger row per released feature and window day."""
    keys = released.select("feature_id", "granularity", "window_day").distinct()
    return ledger_rows(
        keys.withColumn("contract_version", F.lit(contract_version))
        .withColumn("boundary", F.lit(boundary))
        .withColumn("privacy_unit", F.lit(privacy_unit))
        .withColumn("epsilon_spend", F.lit(epsilon))
        .withColumn("delta_spend", F.lit(delta))
    )
