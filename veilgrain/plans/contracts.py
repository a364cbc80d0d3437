"""Plan records, fingerprints, contract bundles and issued contracts."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from veilgrain.functions.scalar import fingerprint, lookup, sorted_map
from veilgrain.schema import GRANULARITIES, ReleaseContract, Thresholds

PLAN_SCHEMA_VERSION = "plan/1"


def fingerprint_of(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns; their order does not matter."""
    return fingerprint({c: F.col(c) for c in columns})


def with_fingerprint(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Add the fingerprint of ``columns``; maps enter in key order, so neither they nor the columns depend on order."""
    canonical = {
        c: sorted_map(F.col(c)) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in columns
    }
    return df.withColumn(name, fingerprint(canonical))


def policy_json(th: Thresholds) -> str:
    """Canonical JSON of every threshold and weight that a decision depends on."""
    return json.dumps(dataclasses.asdict(th), sort_keys=True, separators=(",", ":"))


def policy_hash(th: Thresholds) -> str:
    """SHA-256 of the policy; any change of a threshold or weight changes it."""
    return hashlib.sha256(policy_json(th).encode()).hexdigest()


def rejection_reasons(th: Thresholds) -> Column:
    """Why a decision was rejected, with the cap it missed."""
    reason = F.struct(
        F.lit("NO_FEASIBLE_OPTION").alias("code"),
        F.concat(F.lit("risk exceeds every cap; "), F.col("reason")).alias("message"),
        F.lit(None).cast("string").alias("path"),
        F.lit("risk").alias("metric"),
        F.lit(max(th.tau_granularity.values())).alias("threshold"),
        F.col("risk").alias("observed"),
    )
    return F.array_compact(F.array(F.when(~F.col("feasible"), reason)))


def plan_records(decided: DataFrame, input_columns: Sequence[str], th: Thresholds, created_at: Column) -> DataFrame:
    """One plan row per decided feature, with the hash of the policy it was decided under.

    The plan hash leaves out ``created_at`` and itself.
    """
    hashed_policy = decided.withColumn("policy_hash", F.lit(policy_hash(th)))
    plan = with_fingerprint(hashed_policy, input_columns, "input_fingerprint").withColumns(
        {
            "schema_version": F.lit(PLAN_SCHEMA_VERSION),
            "created_at": created_at,
            "status": F.when(F.col("feasible"), "accepted").otherwise("rejected"),
            "rejection_reasons": rejection_reasons(th),
        }
    )
    hashed = ("boundary", "granularity", "feasible", "status", "input_fingerprint", "policy_hash")
    return plan.withColumn("plan_fingerprint", fingerprint_of(*hashed)).select(
        "feature_id", "schema_version", "created_at", "policy_hash", "input_fingerprint", "plan_fingerprint", "status",
        F.struct("boundary", "granularity", "feasible", "reason").alias("decision"), "rejection_reasons",
    )


def explain(decided: DataFrame, th: Thresholds) -> DataFrame:
    """One sentence per feature: where it went and which component weighs most."""
    weighted = [
        ("linkability", F.round(th.alpha_l * F.col("L"), 9)),
        ("uniqueness", F.round(th.alpha_u * F.col("U"), 9)),
        ("inferability", F.round(th.alpha_i * F.col("I"), 9)),
        ("policy", F.round(th.alpha_r * F.col("R"), 9)),
    ]
    top = F.greatest(*[c for _, c in weighted])
    driver = F.coalesce(*[F.when(c == top, F.lit(name)) for name, c in weighted])
    where = F.when(
        F.col("feasible"), F.concat(F.lit("routed to "), F.col("boundary"), F.lit("/"), F.col("granularity"))
    ).otherwise("rejected, nothing fits the caps")
    return decided.withColumn("driver", driver).withColumn(
        "report", F.concat("feature_id", F.lit(": "), where, F.lit("; main driver "), F.col("driver"))
    )


def downgrades(granularity: Column, boundary: Column) -> Column:
    """Strictly coarser granularities at the same boundary, in ladder order."""
    rank = lookup({g: i for i, g in enumerate(GRANULARITIES)}, granularity)
    steps = [
        F.when(rank < i, F.struct(boundary.alias("boundary"), F.lit(g).alias("granularity")))
        for i, g in enumerate(GRANULARITIES)
    ]
    return F.array_compact(F.array(*steps))


def issue_contracts(decisions: DataFrame, run_ts: str) -> DataFrame:
    """Active contract per routing decision, with the downgrades it permits."""
    return decisions.withColumns(
        {
            "contract_version": F.concat(F.lit("c_"), "feature_id", F.lit(f"_{run_ts}")),
            "allow_downgrade_to": downgrades(F.col("selected_granularity"), F.col("selected_boundary")),
            "active": F.lit(True),
        }
    )


def contract_bundles(contracts: DataFrame, specs: DataFrame, policy: ReleaseContract) -> DataFrame:
    """Everything the runtime needs for a feature, one struct per plan."""
    names = F.transform("fields", lambda f: f["name"])
    identifiers = F.transform(F.filter("fields", lambda f: f["is_identifier"]), lambda f: f["name"])
    numeric = F.transform(F.filter("fields", lambda f: f["dtype"].isin("int", "float")), lambda f: f["name"])
    rfc = F.struct(
        names.alias("required_fields"), identifiers.alias("forbidden_in_staging"),
        F.array_except(names, identifiers).alias("staging_fields"),
    )
    transform_plan = F.struct(
        F.col("bucketizations").alias("bucketizations"), F.lit("week").alias("window"),
        F.col("aggregation_keys").alias("cell_dimensions"),
    )
    bounding = F.struct(
        F.lit(policy.cap).alias("cap_per_cell"), F.lit(policy.max_cells).alias("max_cells"),
        F.lit(policy.lo).alias("lo"), F.lit(policy.hi).alias("hi"), numeric.alias("clipped_fields"),
    )
    granularity = F.struct(
        F.lit(policy.k_min).alias("k_min"), F.col("selected_granularity").alias("preferred"),
        F.col("allow_downgrade_to").alias("ladder"),
    )
    dp = F.struct(
        F.col("selected_boundary").alias("boundary"), F.lit(policy.mechanism).alias("mechanism"),
        F.lit(policy.epsilon).alias("epsilon"), F.lit(policy.delta).alias("delta"), F.lit(policy.sigma).cast("double").alias("sigma"),
    )
    return contracts.join(specs, "feature_id").select(
        "feature_id", "contract_version", rfc.alias("rfc"), transform_plan.alias("transform_plan"),
        bounding.alias("bounding_plan"), granularity.alias("granularity_plan"), dp.alias("dp_config"),
    )
