"""Catalog scorecard: linkability, uniqueness, inferability and policy penalty of feature specs.

All scores are Column expressions over one catalog row, so scoring and deciding a catalog of any size is a
projection: no shuffle, no join, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.functions.scalar import clamp01, lookup, mean_over
from veilgrain.schema import GRANULARITIES, OTHER_TAG_WEIGHT, TAG_WEIGHTS, Thresholds

# Constants of the scorecard formulas.
STABILITY_WEIGHT, NDV_WEIGHT, NDV_SCALE = 0.8, 0.2, 1000.0
TTL_BASE, TTL_WEIGHT, TTL_DAYS = 0.7, 0.3, 90.0
IDENTIFIER_PRESSURE, UNKNOWN_PRESSURE, PRESSURE_SCALE = 1.0, 0.15, 200.0
NO_SENSITIVE_FIELD = 0.05
SENSITIVE_BASE, SENSITIVE_STEP, SENSITIVE_MAX = 0.15, 0.12, 5
DETAIL_WEIGHT, DETAIL_UNBUCKETED, DETAIL_BUCKETED, DETAIL_BUCKETS = 0.05, 0.25, 0.15, 500.0
KEY_AMPLIFICATION = 0.15
# How much of the cell pressure remains at each granularity.
CELL_FACTOR = {"ITEM": 1.0, "CLUSTER": 0.6, "AGGREGATE": 0.25}
# Boundaries and granularities in order of preference.
BOUNDARY_PREFERENCE = ("CENTRAL", "SHUFFLE", "LOCAL")
RISK_DIGITS = 12  # risk is compared after rounding, so the order of additions cannot flip a decision


def _sum(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + value(x))


def key_strength(k: Column) -> Column:
    """Strength of one join key: mostly its stability, a little its number of values."""
    ndv = F.when(k["ndv_hint"] > 0, F.least(F.lit(1.0), F.sqrt(k["ndv_hint"]) / NDV_SCALE)).otherwise(0.0)
    return STABILITY_WEIGHT * clamp01(k["stability"]) + NDV_WEIGHT * ndv


def linkability(keys: Column, ttl_days: Column) -> Column:
    horizon = TTL_BASE + TTL_WEIGHT * clamp01(ttl_days / TTL_DAYS)
    return F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(clamp01(mean_over(keys, key_strength) * horizon))


def field_pressure(f: Column, buckets: Column) -> Column:
    """How much one field splits the cells: identifiers fully, others by bucket count or cardinality."""
    n = F.try_element_at(buckets, f["name"])
    return (
        F.when(f["is_identifier"], F.lit(IDENTIFIER_PRESSURE))
        .when(n.isNotNull(), clamp01(n / PRESSURE_SCALE))
        .when(f["cardinality_hint"].isNotNull(), clamp01(F.sqrt(f["cardinality_hint"]) / PRESSURE_SCALE))
        .otherwise(UNKNOWN_PRESSURE)
    )


def uniqueness(fields: Column, buckets: Column, support: Column, granularity: str, k_min: int) -> Column:
    """From measured support when there is any, else from the pressure of the schema on cell sizes."""
    hint = F.try_element_at(support, F.lit(granularity))
    measured = clamp01(1.0 / F.greatest(F.lit(1.0), hint / float(k_min)))
    cold = clamp01(mean_over(fields, lambda f: field_pressure(f, buckets)) * CELL_FACTOR[granularity])
    return F.when(hint > 0, measured).otherwise(cold)


def sensitive_share(f: Column, buckets: Column) -> Column:
    n = F.try_element_at(buckets, f["name"])
    return F.when(n.isNull(), F.lit(DETAIL_UNBUCKETED)).otherwise(clamp01(DETAIL_BUCKETED + n / DETAIL_BUCKETS))


def inferability(fields: Column, buckets: Column, keys: Column) -> Column:
    """Proxy leakage: number and resolution of sensitive fields, amplified by stable join keys."""
    sensitive = F.filter(fields, lambda f: f["is_sensitive"])
    base = SENSITIVE_BASE + SENSITIVE_STEP * F.least(F.lit(SENSITIVE_MAX), F.size(sensitive))
    detail = DETAIL_WEIGHT * _sum(sensitive, lambda f: sensitive_share(f, buckets))
    stability = clamp01(mean_over(keys, lambda k: k["stability"]))
    amplified = F.when(F.size(keys) > 0, KEY_AMPLIFICATION * stability).otherwise(0.0)
    return F.when(F.size(sensitive) == 0, F.lit(NO_SENSITIVE_FIELD)).otherwise(clamp01(base + detail + amplified))


def policy_penalty(tags: Column) -> Column:
    return clamp01(_sum(tags, lambda t: lookup(TAG_WEIGHTS, t, OTHER_TAG_WEIGHT)))


def total_risk(l: Column, u: Column, i: Column, r: Column, th: Thresholds) -> Column:
    return clamp01(th.alpha_l * l + th.alpha_u * u + th.alpha_i * i + th.alpha_r * r)


def scorecard(features: DataFrame, th: Thresholds) -> DataFrame:
    """Add L, I, R and, per granularity g, U_g and risk_g."""
    fields, buckets, keys = F.col("fields"), F.col("bucketizations"), F.col("join_keys")
    scored = features.withColumns(
        {
            "L": linkability(keys, F.col("ttl_days")),
            "I": inferability(fields, buckets, keys),
            "R": policy_penalty(F.col("policy_tags")),
            **{f"U_{g}": uniqueness(fields, buckets, F.col("support_hint"), g, th.k_min) for g in GRANULARITIES},
        }
    )
    return scored.withColumns(
        {f"risk_{g}": total_risk(F.col("L"), F.col(f"U_{g}"), F.col("I"), F.col("R"), th) for g in GRANULARITIES}
    )


def scorecard_rows(features: DataFrame, th: Thresholds) -> DataFrame:
    """One row per feature and granularity: L, U, I, R, risk."""
    per_g = F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), F.col(f"U_{g}").alias("U"), F.col(f"risk_{g}").alias("risk"))
            for g in GRANULARITIES
        ]
    )
    scored = scorecard(features, th).withColumn("_g", F.explode(per_g))
    return scored.select("feature_id", "_g.granularity", "L", "_g.U", "I", "R", "_g.risk")


def contributors(features: DataFrame, granularity: str, th: Thresholds) -> DataFrame:
    """Long table (feature_id, component, field, value) of what drives each component."""
    fields, buckets, keys = F.col("fields"), F.col("bucketizations"), F.col("join_keys")

    def entries(component: str, array: Column, name, value) -> Column:
        return F.transform(
            array,
            lambda x: F.struct(
                F.lit(component).alias("component"), name(x).alias("field"), value(x).cast("double").alias("value")
            ),
        )

    one = F.array(F.lit(0))
    hint = F.try_element_at("support_hint", F.lit(granularity))
    u = uniqueness(fields, buckets, F.col("support_hint"), granularity, th.k_min)
    sensitive = F.filter(fields, lambda f: f["is_sensitive"])
    parts = F.concat(
        entries("L", keys, lambda k: k["name"], key_strength),
        F.when(hint > 0, entries("U", one, lambda _: F.lit("support_hint"), lambda _: u)).otherwise(
            entries("U", fields, lambda f: f["name"], lambda f: field_pressure(f, buckets))
        ),
        F.when(
            F.size(sensitive) == 0,
            entries("I", one, lambda _: F.lit("no_sensitive_declared"), lambda _: F.lit(NO_SENSITIVE_FIELD)),
        ).otherwise(entries("I", sensitive, lambda f: f["name"], lambda f: sensitive_share(f, buckets))),
        entries("R", F.col("policy_tags"), lambda t: t, lambda t: lookup(TAG_WEIGHTS, t, OTHER_TAG_WEIGHT)),
    )
    return features.select("feature_id", F.explode(parts).alias("c")).select("feature_id", "c.*")


def feasible(risk: Column, boundary: str, granularity: str, th: Thresholds) -> Column:
    rounded = F.round(risk, RISK_DIGITS)
    return (rounded <= th.tau_boundary[boundary]) & (rounded <= th.tau_granularity[granularity])


def options(scored: DataFrame, th: Thresholds) -> DataFrame:
    """Every feasible (boundary, granularity) with its risk and its place in the preference order."""
    pairs = [(b, g) for b in BOUNDARY_PREFERENCE for g in GRANULARITIES]
    rows = F.array_compact(
        F.array(
            *[
                F.when(
                    feasible(F.col(f"risk_{g}"), b, g, th),
                    F.struct(
                        F.lit(n).alias("place"), F.lit(b).alias("boundary"), F.lit(g).alias("granularity"),
                        F.col(f"risk_{g}").alias("risk"),
                    ),
                )
                for n, (b, g) in enumerate(pairs)
            ]
        )
    )
    return scored.withColumn("_o", F.explode(rows)).select("feature_id", "_o.*")


def decide(features: DataFrame, th: Thresholds) -> DataFrame:
    """First feasible option in preference order: boundaries by utility, then granularities from fine to coarse.

    Without one, LOCAL / AGGREGATE marked infeasible, carrying the scores of the option looked at first.
    """
    scored = scorecard(features, th)

    def choice(b: str, g: str, ok: bool, reason: str, scored_at: str) -> Column:
        return F.struct(
            F.lit(b).alias("boundary"),
            F.lit(g).alias("granularity"),
            F.lit(ok).alias("feasible"),
            F.lit(reason).alias("reason"),
            F.col(f"U_{scored_at}").alias("U"),
            F.col(f"risk_{scored_at}").alias("risk"),
        )

    tries = [
        F.when(feasible(F.col(f"risk_{g}"), b, g, th), choice(b, g, True, "feasible", g))
        for b in BOUNDARY_PREFERENCE
        for g in GRANULARITIES
    ]
    fallback = choice("LOCAL", "AGGREGATE", False, "no_feasible_option_under_thresholds", GRANULARITIES[0])
    drop = [f"{c}_{g}" for c in ("U", "risk") for g in GRANULARITIES]
    return scored.withColumn("_d", F.coalesce(*tries, fallback)).drop(*drop).select("*", "_d.*").drop("_d")


def constraint_columns(granularity: Column, k_min: int) -> dict[str, Column]:
    """What a query over the released feature may do. ``*_all`` stands for every key."""
    item, aggregate = granularity == "ITEM", granularity == "AGGREGATE"
    none = F.array().cast("array<string>")
    ids = F.transform(F.filter("fields", lambda f: f["is_identifier"]), lambda f: f["name"])
    keys = F.transform("join_keys", lambda k: k["name"])
    cluster = granularity == "CLUSTER"
    return {
        "forbid_group_by_all": aggregate,
        "forbid_group_by_keys": F.when(cluster, ids).otherwise(none),
        "forbid_joins_all": aggregate,
        "forbid_joins_on": F.when(cluster, keys).otherwise(none),
        "min_group_cardinality": F.when(item, F.lit(1)).otherwise(F.lit(max(k_min, 2))),
        "require_pre_aggregation": ~item,
    }


def planner_constraints(decided: DataFrame, th: Thresholds) -> DataFrame:
    return decided.withColumns(constraint_columns(F.col("granularity"), th.k_min))


def query_request_gate(requests: DataFrame, constraints: DataFrame) -> DataFrame:
    """Check requested grouping keys, join keys and minimum group size against the constraints."""
    joined = requests.join(
        constraints.select(
            "feature_id", "forbid_group_by_all", "forbid_group_by_keys", "forbid_joins_all", "forbid_joins_on",
            "min_group_cardinality", "require_pre_aggregation",
        ),
        "feature_id",
        "left",
    )
    group_by, join_on = F.col("group_by"), F.col("join_keys")
    bad_group = (F.col("forbid_group_by_all") & (F.size(group_by) > 0)) | F.arrays_overlap(group_by, "forbid_group_by_keys")
    bad_join = (F.col("forbid_joins_all") & (F.size(join_on) > 0)) | F.arrays_overlap(join_on, "forbid_joins_on")
    codes = F.array(
        F.when(F.col("min_group_cardinality").isNull(), "NO_CONSTRAINTS"),
        F.when(bad_group, "GROUP_BY_FORBIDDEN"),
        F.when(bad_join, "JOIN_FORBIDDEN"),
        F.when(F.col("min_group_size") < F.col("min_group_cardinality"), "GROUP_TOO_SMALL"),
        F.when(F.col("require_pre_aggregation") & ~F.col("aggregated"), "NOT_AGGREGATED"),
    )
    return joined.withColumn("violations", F.array_compact(codes))


def counterfactuals(features: DataFrame, th: Thresholds, target: str) -> DataFrame:
    """Edits that could lower a feature's risk, rescored at ``target``.

    Edits: halve the buckets of a sensitive field (down to 2), or drop an identifier or sensitive field.
    """
    fields, buckets = F.col("fields"), F.col("bucketizations")

    def halved(f: Column) -> Column:
        return F.greatest(F.lit(2), F.floor(F.try_element_at(buckets, f["name"]) / 2).cast("int"))

    def edit(text: Column, kind: str, f: Column, to: Column) -> Column:
        return F.struct(text.alias("edit"), F.lit(kind).alias("kind"), f["name"].alias("field"), to.alias("to"))

    coarser = F.filter(
        fields, lambda f: f["is_sensitive"] & (F.try_element_at(buckets, f["name"]) != halved(f))
    )
    edits = F.concat(
        F.transform(
            coarser,
            lambda f: edit(
                F.concat(F.lit("bucketize:"), f["name"], F.lit(":"),
                         F.try_element_at(buckets, f["name"]).cast("string"), F.lit("->"), halved(f).cast("string")),
                "bucketize", f, halved(f),
            ),
        ),
        F.transform(
            F.filter(fields, lambda f: f["is_identifier"] | f["is_sensitive"]),
            lambda f: edit(F.concat(F.lit("drop_field:"), f["name"]), "drop_field", f, F.lit(None).cast("int")),
        ),
    )
    rows = features.select("*", F.posexplode(edits).alias("position", "_e")).select("*", "_e.*").drop("_e")
    dropped = F.col("kind") == "drop_field"
    new_fields = F.when(dropped, F.filter(fields, lambda f: f["name"] != F.col("field"))).otherwise(fields)
    kept = F.map_filter(buckets, lambda name, _: name != F.col("field"))
    new_buckets = F.when(dropped, kept).otherwise(F.map_concat(kept, F.create_map(F.col("field"), F.col("to"))))
    edited = rows.withColumns({"fields": new_fields, "bucketizations": new_buckets})
    scored = scorecard(edited, th)
    risk = F.col(f"risk_{target}")
    ok = F.round(risk, RISK_DIGITS) <= th.tau_granularity[target]
    return scored.select(
        "feature_id", "edit", "position", F.lit(target).alias("target_granularity"), ok.alias("feasible_at_target"),
        "L", F.col(f"U_{target}").alias("U"), "I", "R", risk.alias("risk"),
        *[c.alias(n) for n, c in constraint_columns(F.lit(target), th.k_min).items()],
    )


def rank_edits(df: DataFrame, top: int) -> DataFrame:
    """The ``top`` best edits per feature: feasible first, then lowest risk; ties keep the order of the edits."""
    w = W.partitionBy("feature_id").orderBy(
        (~F.col("feasible_at_target")).cast("int"), F.round("risk", RISK_DIGITS), "position"
    )
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
