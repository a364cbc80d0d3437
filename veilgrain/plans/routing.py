"""Granularity and boundary selection over admissible sets, and the routing decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.scalar import boundary_rank, granularity_rank
from veilgrain.operators.shuffle_dp import planned_local_epsilon, planned_variance
from veilgrain.schema import ScorePolicy

EFFVAR_DIGITS = 15
# Reason codes of a selection.
SELECTED = ("MIN_EFFVAR_SELECTED", "TIEBREAK_FINEST_THEN_SAFEST")
FALLBACK = "NO_FEASIBLE_STATS_FALLBACK_COARSE"


def effective_variance(query_type: Column, n: Column, variance: Column, sigma: float) -> Column:
    """Noise plus sampling variance of a bounded mean; for counts the noise variance per row."""
    n = F.greatest(F.lit(1), n)
    mean = (sigma * sigma) / (n * n) + F.greatest(F.lit(0.0), variance)
    return F.when(query_type == "MEAN_BOUNDED_0_1", mean).otherwise((sigma * sigma) / n)


def select_min_effvar(scored: DataFrame, p: ScorePolicy, n_col: str = "n_obs", window: str = "W1") -> DataFrame:
    """Admissible pair of least effective variance; ties go to the finest level, then the safest boundary.

    ``scored`` carries the admissible set and the snapshot map, so this is a projection. Pairs without statistics or
    below the support threshold do not compete. If none is left, the coarsest admissible level at its safest boundary
    is taken; an empty admissible set gives nulls.
    """

    def candidate(x: Column) -> Column:
        s = F.try_element_at("snapshots", F.concat(F.lit(f"{window}/"), x["granularity"]))
        var = effective_variance(F.col("query_type"), s[n_col], s["approx_variance"], p.central_sigma)
        return F.when(
            s["min_support_est"] >= p.min_support_threshold,
            F.struct(
                F.round(var, EFFVAR_DIGITS).alias("effvar"), granularity_rank(x["granularity"]).alias("g"),
                boundary_rank(x["boundary"]).alias("b"), x["boundary"].alias("boundary"),
                x["granularity"].alias("granularity"),
            ),
        )

    best = F.array_min(F.array_compact(F.transform("admissible_set", candidate)))
    fallback = F.array_min(
        F.transform(
            "admissible_set",
            lambda x: F.struct(
                (-granularity_rank(x["granularity"])).alias("g"), boundary_rank(x["boundary"]).alias("b"),
                x["boundary"].alias("boundary"), x["granularity"].alias("granularity"),
            ),
        )
    )
    chosen = scored.withColumn("_best", best).withColumn("_fall", fallback)
    found = F.col("_best").isNotNull()
    return chosen.withColumns(
        {
            "selected_boundary": F.when(found, F.col("_best.boundary")).otherwise(F.col("_fall.boundary")),
            "selected_granularity": F.when(found, F.col("_best.granularity")).otherwise(F.col("_fall.granularity")),
            "eff_var": F.col("_best.effvar"),
            "decision_reason_codes": F.when(
                found, F.array(*[F.lit(x) for x in SELECTED])
            ).otherwise(F.array(F.lit(FALLBACK))),
        }
    ).drop("_best", "_fall")


def std_total(rate: Column, n: Column, sigma: float) -> Column:
    """Sampling and noise standard deviation of a rate over n rows."""
    return F.sqrt(rate * (1 - rate) / n + (sigma * sigma) / (n * n))


def select_finest_under_tau(rows: DataFrame, tau: float, sigma: float) -> DataFrame:
    """Finest level of each feature whose total standard deviation stays within ``tau``; rows: feature_id, level, rate, n."""
    ok = rows.withColumn("std_total", std_total(F.col("rate"), F.col("n"), sigma)).filter(F.round("std_total", 12) <= tau)
    return ok.groupBy("feature_id").agg(
        F.min_by(F.struct("level", "std_total"), granularity_rank(F.col("level"))).alias("_b")
    ).select("feature_id", F.col("_b.level").alias("selected_granularity"), F.col("_b.std_total").alias("std_total"))


def select_best(rows: DataFrame, score: str, ok: Column | None = None, largest: bool = True) -> DataFrame:
    """Level with the best score per feature among rows that satisfy ``ok``; ties go to the finest level."""
    kept = rows if ok is None else rows.filter(ok)
    order = F.round(F.col(score), EFFVAR_DIGITS)
    key = F.struct((-order if largest else order).alias("s"), granularity_rank(F.col("level")).alias("g"))
    return kept.groupBy("feature_id").agg(F.min_by(F.struct("level", score), key).alias("_b")).select(
        "feature_id", F.col("_b.level").alias("selected_granularity"), F.col(f"_b.{score}").alias(score)
    )


def noise_loss(n: Column, agg_loss: Column, weight: float, epsilon: float, delta: float) -> Column:
    """weight * shuffle noise variance of a frequency + loss of aggregating."""
    eps0 = planned_local_epsilon(epsilon, n, delta)
    return weight * planned_variance(eps0, n) / (n * n) + agg_loss


def select_boundary(risks: DataFrame, utility: dict[str, float], caps: dict[str, float], finest: dict[str, str]) -> DataFrame:
    """Boundary of highest utility whose risk at its finest permitted level is within its cap; else null.

    ``risks`` holds risk_<granularity> columns, one row per feature.
    """
    order = sorted(utility, key=lambda b: -utility[b])
    tries = [F.when(F.round(F.col(f"risk_{finest[b]}"), 12) <= caps[b], F.lit(b)) for b in order]
    return risks.withColumn("selected_boundary", F.coalesce(*tries))


def routing_decision(selected: DataFrame, p: ScorePolicy) -> DataFrame:
    """DP parameters, aggregation keys, join and retention policy of each selection. Joins only at CENTRAL."""
    g = F.col("selected_granularity")
    keys = (
        F.when(g == "ITEM", F.array(F.lit("item_id")))
        .when(g == "CLUSTER", F.array(F.lit("cluster_id")))
        .otherwise(F.array().cast("array<string>"))
    )
    return selected.withColumns(
        {
            "dp_mechanism": F.lit("GAUSSIAN"),
            "dp_parameters": F.struct(
                F.lit(p.central_sigma).alias("sigma"), F.lit(p.min_support_threshold).alias("min_support_threshold")
            ),
            "aggregation_keys": keys,
            "join_policy": F.struct(
                (F.col("selected_boundary") == "CENTRAL").alias("allow_joins"), F.col("join_keys").alias("join_keys")
            ),
            "retention_policy": F.struct(F.col("retention_days").alias("retention_days")),
        }
    )

