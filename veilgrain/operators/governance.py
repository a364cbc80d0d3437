"""Lineage, boundary invariants, audit quality and lifecycle checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.functions.scalar import boundary_rank, granularity_rank


# ---- evaluation metrics ----
def score_distribution(df: DataFrame, score: str, keys: Sequence[str] = (), mid: float = 0.40, high: float = 0.75) -> DataFrame:
    band = F.when(F.col(score) >= high, "high").when(F.col(score) >= mid, "medium").otherwise("low")
    return df.groupBy(*keys, band.alias("band")).agg(
        F.count("*").alias("n"), F.bool_and(F.col(score).between(0, 1)).alias("in_range")
    )


def consistency(df: DataFrame, inputs: Sequence[str], outcome: str) -> DataFrame:
    """Evaluations and distinct outcomes per input; one outcome means consistent."""
    return (
        df.groupBy(*inputs, outcome)
        .agg(F.count("*").alias("n"))
        .groupBy(*inputs)
        .agg(F.sum("n").alias("evaluations"), F.count("*").alias("outcomes"))
    )


def granularity_reduction(requested: Column, applied: Column) -> Column:
    """Share of the remaining ladder that was climbed; 0 when the request already sat at the top."""
    a, b = granularity_rank(requested), granularity_rank(applied)
    return F.when(a < 2, F.greatest(b - a, F.lit(0)) / (2 - a)).otherwise(0.0)


# ---- lineage ----
def lineage_conflicts(records: DataFrame) -> DataFrame:
    """Contract versions whose lineage records differ; a record is immutable per version."""
    content = F.sha2(F.to_json(F.struct("source_boundary", "materialization_boundary", "granularity", "retention_days")), 256)
    return (
        records.select("feature_id", "contract_version", content.alias("_h"))
        .distinct()
        .groupBy("feature_id", "contract_version")
        .agg(F.count("*").alias("variants"))
    )


def hop_pairs(hops: DataFrame, keys: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Each hop with the hop before it. A path holds one row per hop number, so windows stay small."""
    w = W.partitionBy(*keys).orderBy("hop")
    prev = {f"prev_{c}": F.lag(c).over(w) for c in ("boundary", "granularity", "retention_days")}
    return hops.withColumns(prev).filter("prev_boundary is not null")


def boundary_escalations(pairs: DataFrame, permits: DataFrame) -> DataFrame:
    """Hops that go back to a lower boundary, or up without a contract for that very hop."""
    rise = boundary_rank(F.col("boundary")) - boundary_rank(F.col("prev_boundary"))
    flagged = pairs.join(
        permits.select("feature_id", "prev_boundary", "boundary").distinct().withColumn("_permit", F.lit(True)),
        ["feature_id", "prev_boundary", "boundary"],
        "left",
    )
    return flagged.withColumn(
        "violation",
        F.when(rise < 0, "REVERSE_FLOW").when((rise > 0) & F.col("_permit").isNull(), "NO_CONTRACT_FOR_HOP"),
    ).filter("violation is not null").drop("_permit")


def granularity_refinements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(granularity_rank(F.col("granularity")) < granularity_rank(F.col("prev_granularity")))


def retention_increases(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("retention_days") > F.col("prev_retention_days"))


def emergency_downgrades(requests: DataFrame) -> DataFrame:
    """Only toward coarser granularity and within the same or a lower boundary."""
    coarser = granularity_rank(F.col("to_granularity")) > granularity_rank(F.col("from_granularity"))
    lower = boundary_rank(F.col("to_boundary")) <= boundary_rank(F.col("from_boundary"))
    return requests.withColumn(
        "verdict", F.when(~coarser, "NOT_COARSER").when(~lower, "HIGHER_BOUNDARY").otherwise("ALLOWED")
    )


def untraceable(releases: DataFrame, contracts: DataFrame) -> DataFrame:
    """What each release lacks of boundary, mechanism and granularity; the contract is that of its feature and version.

    A version with several contracts that differ is no answer either: ``contract`` is missing then.
    """
    terms = ("boundary", "mechanism", "granularity")
    c = contracts.select("feature_id", "contract_version", *terms).distinct().groupBy("feature_id", "contract_version").agg(
        *[F.min(t).alias(t) for t in terms], F.count("*").alias("_variants")
    )
    joined = releases.join(c, ["feature_id", "contract_version"], "left")
    lacking = [F.when(F.col(x).isNull(), F.lit(x)) for x in terms]
    missing = F.array(F.when(F.col("_variants") > 1, F.lit("contract")), *lacking)
    return joined.withColumn("missing", F.array_compact(missing)).drop("_variants")


def lineage_block(features: DataFrame, lineage: DataFrame) -> DataFrame:
    """(feature_id, blocked) of every feature: true where ``lineage`` has no record of it."""
    known = lineage.select("feature_id").distinct().withColumn("_known", F.lit(True))
    return features.join(known, "feature_id", "left").select("feature_id", F.col("_known").isNull().alias("blocked"))


def expired(df: DataFrame, day: str, asof: str, ttl_days: Column) -> DataFrame:
    return df.filter(F.date_diff(F.lit(asof).cast("date"), F.col(day)) > ttl_days)


def audit_completeness(audit: DataFrame, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows and the share of them with every required field; a column ``leaked`` (boolean) is counted as ``n_leaks``."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    leaks = [F.count_if("leaked").alias("n_leaks")] if "leaked" in audit.columns else []
    return audit.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(complete.cast("double")).alias("completeness"), *leaks)


def replay_diff(first: DataFrame, second: DataFrame, key: str, outcome: str) -> DataFrame:
    """Outer comparison of two runs: match, mismatch or missing on one side."""
    a = first.select(key, F.col(outcome).alias("_a"), F.lit(True).alias("_in_a"))
    b = second.select(key, F.col(outcome).alias("_b"), F.lit(True).alias("_in_b"))
    return a.join(b, key, "full_outer").withColumn(
        "verdict",
        F.when(F.col("_in_a").isNull(), "ONLY_SECOND")
        .when(F.col("_in_b").isNull(), "ONLY_FIRST")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "MATCH")
        .otherwise("MISMATCH"),
    )
