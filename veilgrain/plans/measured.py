"""Scores measured from statistics snapshots, probes and the catalog, and the admissible set they lead to."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions.scalar import auc_to_risk, clamp01, granularity_rank, lookup
from veilgrain.schema import ScorePolicy

# Which level's statistics stand for a feature, in order of preference.
STATS_PREFERENCE = {"CLUSTER": 0, "ITEM": 1, "AGGREGATE": 2}
STABLE_IDS = ("user_id", "device_id")
# Score above which a normalised join degree or retention is worth a reason code.
HIGH_SHARE = 0.7
# Reason codes.
STABLE_ID = "STABLE_ID_PRESENT"
HIGH_DEGREE = "HIGH_JOIN_DEGREE"
LONG_RETENTION = "LONG_RETENTION"
LOW_SUPPORT = "LOW_MIN_SUPPORT"
DISTINCT_DRIFT = "DISTINCT_DRIFT"
HIGH_INFER = "HIGH_INFER:"
MISSING_METADATA = "MISSING_METADATA_CONSERVATIVE_LINK"
MISSING_STATS = "MISSING_STATS_CONSERVATIVE_UNIQ"
ZERO_OBS = "ZERO_OBS_CONSERVATIVE_UNIQ"
MISSING_PROBE = "MISSING_PROBE_CONSERVATIVE_INFER"
DENY_CENTRAL = "POLICY_DENY:CENTRAL_FOR_PRECISE_LOCATION"
MIN_CLUSTER = "POLICY_MIN_GRANULARITY:CLUSTER_FOR_DEMOGRAPHICS"
SOFT_PENALTY = "POLICY_SOFT_PENALTY:SENSITIVE_TAG_PRESENT"


def _reasons(*pairs: tuple[Column, str | Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(x) if isinstance(x, str) else x) for c, x in pairs]))


def link_score(keys: Column, degree: Column, retention_days: Column, p: ScorePolicy) -> tuple[Column, Column]:
    """(score, reasons): stable identifiers, join-graph degree on a log scale, retention."""
    has_id = F.arrays_overlap(keys, F.array(*[F.lit(x) for x in STABLE_IDS]))
    n_join = F.least(F.lit(1.0), F.log1p(degree) / math.log(1 + max(1, p.deg_max)))
    n_ttl = F.least(F.lit(1.0), retention_days / float(max(1, p.retention_days_max)))
    score = clamp01(p.a_id * has_id.cast("int") + p.a_join * n_join + p.a_ttl * n_ttl)
    reasons = _reasons((has_id, STABLE_ID), (n_join > HIGH_SHARE, HIGH_DEGREE), (n_ttl > HIGH_SHARE, LONG_RETENTION))
    missing = keys.isNull() | retention_days.isNull()
    return (
        F.when(missing, F.lit(1.0)).otherwise(score),
        F.when(missing, F.array(F.lit(MISSING_METADATA))).otherwise(reasons),
    )


def uniq_min_support(min_support: Column, n_obs: Column) -> Column:
    return clamp01(1.0 - F.log1p(min_support) / F.log1p(F.greatest(F.lit(1), n_obs)))


def uniq_score(w1: Column, w0: Column, p: ScorePolicy) -> tuple[Column, Column]:
    """(score, reasons) from the two windows' snapshots; missing or empty statistics score 1."""
    usable = w1.isNotNull() & (w1["n_obs"] > 0)
    score = F.when(usable, uniq_min_support(w1["min_support_est"], w1["n_obs"])).otherwise(1.0)
    drift = F.abs(w1["n_distinct_est"] - w0["n_distinct_est"]) > p.distinct_drift_threshold
    reasons = (
        F.when(w1.isNull(), F.array(F.lit(MISSING_STATS)))
        .when(w1["n_obs"] <= 0, F.array(F.lit(ZERO_OBS)))
        .otherwise(
            _reasons(
                (w1["min_support_est"] < p.min_support_floor, LOW_SUPPORT),
                (w0.isNotNull() & drift, DISTINCT_DRIFT),
            )
        )
    )
    return score, reasons


def uniq_distinct_ratio(n_distinct: Column, n_obs: Column, r0: float, r1: float) -> Column:
    ratio = n_distinct / F.greatest(F.lit(1), n_obs)
    return clamp01((ratio - r0) / (r1 - r0))


def uniq_tail_mass(tail_mass: Column, tail_max: float) -> Column:
    return clamp01(tail_mass / tail_max)


def infer_by_feature(probes: DataFrame, p: ScorePolicy) -> DataFrame:
    """Worst probe per feature: (feature_id, s_infer, infer_reasons). One row per attribute enters."""
    scored = probes.withColumn("_r", auc_to_risk(F.col("auc")))
    high = F.when(F.round("_r", 12) > p.infer_high, F.concat(F.lit(HIGH_INFER), F.col("attr")))
    return scored.groupBy("feature_id").agg(
        F.max("_r").alias("s_infer"), F.array_sort(F.collect_set(high)).alias("infer_reasons")
    )


def policy_score(tags: Column, p: ScorePolicy) -> tuple[Column, Column]:
    """(score, reasons): the soft penalty as soon as any sensitivity tag is present."""
    tagged = F.size(tags) > 0
    reasons = _reasons(
        (F.array_contains(tags, "precise_location"), DENY_CENTRAL),
        (F.array_contains(tags, "demographics"), MIN_CLUSTER),
        (tagged, SOFT_PENALTY),
    )
    return F.when(tagged, F.lit(p.soft_penalty)).otherwise(0.0), reasons


def apply_policy_rules(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Penalty and constraints that declared rules put on a feature.

    ``rules`` has one row per tag: penalty, and optionally deny_boundary, min_granularity, deny_join. The highest penalty
    counts, denials add up, the coarsest minimum holds. Features without a matching rule score 0.
    """
    tagged = features.select("feature_id", F.explode_outer(F.array_distinct("sensitivity_tags")).alias("tag"))
    hit = tagged.join(rules, "tag", "left")
    rank = granularity_rank(F.col("min_granularity"))
    return hit.groupBy("feature_id").agg(
        F.coalesce(F.max("penalty"), F.lit(0.0)).alias("s_policy"),
        F.array_sort(F.collect_set("deny_boundary")).alias("denied_boundaries"),
        F.max_by("min_granularity", rank).alias("min_granularity"),
        F.coalesce(F.bool_or("deny_join"), F.lit(False)).alias("deny_join"),
        F.array_sort(F.collect_set(F.when(F.col("penalty").isNotNull(), F.concat(F.lit("POLICY_RULE:"), F.col("tag"))))).alias(
            "policy_reasons"
        ),
    )


def hard_policy_score(hard: Column, sensitive: Column, p: ScorePolicy) -> Column:
    """1 for hard-restricted features, the soft penalty for sensitive ones, 0 otherwise."""
    return F.when(hard, F.lit(1.0)).when(sensitive, F.lit(p.soft_penalty)).otherwise(0.0)


def best_stats(stats: DataFrame) -> DataFrame:
    """One snapshot per feature and window: CLUSTER if there is one, else ITEM, else AGGREGATE."""
    order = lookup(STATS_PREFERENCE, F.col("level"))
    snapshot = F.struct("level", "n_obs", "n_distinct_est", "min_support_est", "tail_mass_est", "approx_variance")
    return stats.groupBy("feature_id", "window_id").agg(F.min_by(snapshot, order).alias("snapshot"))


def snapshot_map(stats: DataFrame) -> DataFrame:
    """All snapshots of a feature in one row: map "window/level" -> snapshot, a handful of entries per feature.

    Scoring and selection then read it without joining the statistics again.
    """
    snapshot = F.struct("n_obs", "n_distinct_est", "min_support_est", "tail_mass_est", "n_eff", "approx_variance")
    entry = F.struct(F.concat_ws("/", "window_id", "level").alias("key"), snapshot.alias("value"))
    return stats.groupBy("feature_id").agg(F.map_from_entries(F.collect_list(entry)).alias("snapshots"))


def preferred_snapshot(window: str) -> Column:
    order = sorted(STATS_PREFERENCE, key=STATS_PREFERENCE.get)
    return F.coalesce(*[F.try_element_at("snapshots", F.lit(f"{window}/{g}")) for g in order])


def score_features(defs: DataFrame, stats: DataFrame, probes: DataFrame, p: ScorePolicy, current: str = "W1",
                   previous: str = "W0") -> DataFrame:
    """Sub-scores, total and reason codes per feature.

    ``defs`` has feature_id, join_keys, degree, retention_days, sensitivity_tags. Missing statistics, metadata or
    probes score upward, each with its own reason code.
    """
    joined = (
        defs.join(snapshot_map(stats), "feature_id", "left")
        .join(infer_by_feature(probes, p).withColumnRenamed("s_infer", "_infer"), "feature_id", "left")
        .withColumns({"w1": preferred_snapshot(current), "w0": preferred_snapshot(previous)})
    )
    s_link, why_link = link_score(F.col("join_keys"), F.col("degree"), F.col("retention_days"), p)
    s_uniq, why_uniq = uniq_score(F.col("w1"), F.col("w0"), p)
    s_policy, why_policy = policy_score(F.col("sensitivity_tags"), p)
    why_infer = F.when(
        F.col("_infer").isNull(), F.array(F.lit(MISSING_PROBE))
    ).otherwise(F.col("infer_reasons"))
    scored = joined.withColumns(
        {
            "s_link": s_link,
            "s_uniq": s_uniq,
            "s_infer": F.coalesce("_infer", F.lit(p.infer_default)),
            "s_policy": s_policy,
            "reason_codes": F.concat(why_link, why_uniq, why_infer, why_policy),
        }
    )
    total = (
        p.w_link * F.col("s_link") + p.w_uniq * F.col("s_uniq") + p.w_infer * F.col("s_infer")
        + p.w_policy * F.col("s_policy")
    )
    return scored.withColumn("lps_total", total).drop("_infer", "infer_reasons", "w1", "w0")


def band_granularity(total: Column, p: ScorePolicy) -> Column:
    rounded = F.round(total, 12)
    return F.when(rounded >= p.band_high, "AGGREGATE").when(rounded >= p.band_mid, "CLUSTER").otherwise("ITEM")


def with_admissible_set(scored: DataFrame, p: ScorePolicy, rule: str = "coarsest") -> DataFrame:
    """Add ``min_granularity`` and ``admissible_set`` (sorted array of boundary/granularity structs).

    A hard minimum (demographics need CLUSTER) and the risk band both apply. ``rule='replace'`` lets the hard
    minimum replace the band instead, even where the band asks for a coarser level.
    """
    band = band_granularity(F.col("lps_total"), p)
    hard = F.when(F.array_contains("sensitivity_tags", "demographics"), F.lit("CLUSTER"))
    if rule == "replace":
        minimum = F.coalesce(hard, band)
    else:
        coarser = granularity_rank(hard) > granularity_rank(band)
        minimum = F.when(coarser, hard).otherwise(band)
    denied = F.array_contains("sensitivity_tags", "precise_location")
    pairs = F.flatten(
        F.transform(
            "boundary_capabilities",
            lambda b: F.transform(
                "granularity_candidates", lambda g: F.struct(b.alias("boundary"), g.alias("granularity"))
            ),
        )
    )
    return scored.withColumn("min_granularity", minimum).withColumn(
        "admissible_set",
        F.array_sort(
            F.array_distinct(
                F.filter(
                    pairs,
                    lambda x: ~(denied & (x["boundary"] == "CENTRAL"))
                    & (granularity_rank(x["granularity"]) >= granularity_rank(F.col("min_granularity"))),
                )
            )
        ),
    )


def routing_tier(lps: Column, ibv_high: Column) -> Column:
    """Aggregate-only from 0.75, shuffle from 0.40, below that central if the business value is worth it."""
    return (
        F.when(lps >= 0.75, "AGGREGATE_ONLY").when(lps >= 0.40, "SHUFFLE").when(ibv_high, "CENTRAL_ITEM").otherwise("AGGREGATE_ONLY")
    )


def six_component_score(weights: dict[str, float], logistic: bool = False) -> Column:
    """Weighted sum of s_sem, s_uniq, s_link, s_inf, s_eps and s_stab; optionally squashed."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(F.col(name), F.lit(1.0))
    return 1.0 / (1.0 + F.exp(-total)) if logistic else total


def semantic_score(fields: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Most sensitive class among a feature's fields; a field the taxonomy does not know counts as 1."""
    return (
        fields.join(taxonomy, "field", "left")
        .groupBy("feature_id")
        .agg(F.max(F.coalesce("sensitivity", F.lit(1.0))).alias("s_sem"))
    )


def resolve_keys(keys: DataFrame, registry: DataFrame) -> DataFrame:
    """Canonical name of every declared key; unknown names get a conservative flag."""
    return keys.join(registry, "key_name", "left").withColumn(
        "flag", F.when(F.col("canonical").isNull(), "UNDECLARED_KEY_CONSERVATIVE")
    )


def probe_due(last_probe: Column, sensitive: Column, rising: Column) -> Column:
    """Next probe date: weekly for sensitive features, every two weeks for rising risk, else monthly."""
    days = F.when(sensitive, 7).when(rising, 14).otherwise(30)
    return F.date_add(last_probe, days)
