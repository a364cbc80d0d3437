"""Release of all issued contracts in one job: contract check, bounded staging, minimum contributors on each contract's own
ladder, budget, noise, audit rows and ledger. Contracts are joined as rows; nothing runs once per feature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.functions.noise import gaussian
from veilgrain.functions.scalar import granularity_rank
from veilgrain.operators import bounding, central, gates
from veilgrain.operators import ledger as lg
from veilgrain.operators.transforms import roll_up
from veilgrain.schema import ReleaseContract
from veilgrain.session import store

CELL = ("feature_id", "contract_version", "window_id")


def terms(bundles: DataFrame) -> DataFrame:
    """What the release reads of each contract bundle."""
    plan = F.col("granularity_plan")
    levels = F.concat(F.array(plan["preferred"]), F.transform(plan["ladder"], lambda x: x["granularity"]))
    return bundles.select(
        "feature_id", "contract_version", "dp_config.boundary", "dp_config.epsilon", "dp_config.delta",
        plan["k_min"].alias("k_min"), plan["preferred"].alias("preferred"), levels.alias("levels"),
    )


def checked_items(events: DataFrame, item: Column, cluster: Column, bundles: DataFrame, boundary: str) -> DataFrame:
    """Rows per feature, window, contributor and item, each with its contract and a reason if that forbids this path.

    Events are counted before the join, so a feature with a third of all events is joined on its counts only.
    """
    items = events.groupBy("feature_id", "window_id", "contributor", item.alias("_item"), cluster.alias("_cluster")).agg(
        F.count("*").alias("n")
    )
    issued = terms(bundles).select("feature_id", "contract_version", "boundary")
    reason = F.when(F.col("contract_version").isNull(), "NO_CONTRACT").when(
        F.col("boundary") != boundary, "BOUNDARY_MISMATCH"
    )
    return items.join(issued, "feature_id", "left").withColumn("reason", reason)


def staging(checked: DataFrame, policy: ReleaseContract) -> DataFrame:
    """Stored cells of the permitted features at every level, from bounded contributors; no contributor is written."""
    valid = checked.filter(F.col("reason").isNull())
    partials = roll_up(valid, [*CELL, "contributor"], ["n"]).withColumn("n", F.least(F.lit(policy.cap), F.col("n")))
    capped = bounding.l0_cell_cap(partials, policy.max_cells, policy.secret, ("feature_id",), policy.digest)
    staged = bounding.stage(capped, ("feature_id", "contract_version"))
    return store(gates.leak_guard(staged, ["contributor", "_item", "_cluster"]), "contract-staging")


def outcomes(staged: DataFrame, bundles: DataFrame, ledger: DataFrame, eps_cap: float, delta_cap: float) -> DataFrame:
    """One row per staged feature and window: the level to release, the outcome and its reason.

    The level is the finest of the contract's ladder at which every cell has the contract's k. Windows that have one are
    paid for in their order from what the ledger leaves of the caps; the first that cannot be paid ends the release.
    """
    rows = central.level_support(staged, CELL).join(terms(bundles), ["feature_id", "contract_version"])
    permitted = F.array_contains("levels", F.col("level"))
    enough = permitted & (F.col("min_contributors") >= F.col("k_min"))
    picked = rows.groupBy(*CELL, "preferred", "epsilon", "delta").agg(
        F.min(F.when(enough, F.col("lvl"))).alias("lvl"),
        F.max(F.when(permitted, F.col("min_contributors"))).alias("min_support"),
    )
    spent = ledger.groupBy("feature_id").agg(
        F.sum("epsilon_spend").alias("_eps"), F.sum("delta_spend").alias("_delta")
    )
    earlier = W.partitionBy("feature_id").orderBy("window_id", "contract_version").rowsBetween(W.unboundedPreceding, -1)
    due = F.col("lvl").isNotNull()

    def used(before: str, each: str) -> Column:
        own = F.coalesce(F.sum(F.when(due, F.col(each))).over(earlier), F.lit(0.0))
        return F.coalesce(F.col(before), F.lit(0.0)) + own

    priced = picked.join(spent, "feature_id", "left").withColumns(
        {"spent_epsilon": used("_eps", "epsilon"), "spent_delta": used("_delta", "delta")}
    )
    paid = lg.can_spend(
        F.col("spent_epsilon"), F.col("spent_delta"), F.col("epsilon"), F.col("delta"), eps_cap, delta_cap
    )
    finest = F.col("lvl") == granularity_rank(F.col("preferred"))
    outcome = F.when(~due | ~paid, "BLOCK").when(finest, "MATERIALIZE").otherwise("DOWNGRADE")
    reason = F.when(~due, "MIN_SUPPORT_FAIL").when(~paid, "BUDGET_EXHAUSTED").when(~finest, "MIN_SUPPORT_FAIL")
    return priced.withColumns({"outcome": outcome, "reason": reason})


def released(staged: DataFrame, decided: DataFrame, policy: ReleaseContract) -> DataFrame:
    """Noised counts of the chosen cells; the noise follows the contract's epsilon and delta."""
    pay = decided.filter("outcome <> 'BLOCK'").select(*CELL, "lvl", "epsilon", "delta")
    bound = F.lit(policy.cap * math.sqrt(policy.max_cells))
    sd = F.sqrt(2.0 * F.log(1.25 / F.col("delta"))) / F.col("epsilon") * bound
    names = [F.col(c) for c in (*CELL, "level", "cell")]
    noise = gaussian(policy.secret, *names, "COUNT", digest=policy.digest)
    cells = staged.join(pay, [*CELL, "lvl"]).withColumn("_sd", sd)
    value = F.greatest(F.lit(0.0), F.col("event_count") + F.col("_sd") * noise)
    out = central.with_uncertainty(cells.withColumn("dp_event_count", value), "dp_event_count", F.col("_sd"))
    return out.select(*CELL, "level", "cell", "dp_event_count", "variance", "ci_lower", "ci_upper", "epsilon", "delta")


def audit(checked: DataFrame, decided: DataFrame) -> DataFrame:
    """REJECT rows of features and windows without a fitting contract; BLOCK, DOWNGRADE, MATERIALIZE rows of the others."""
    refused = (
        checked.filter(F.col("reason").isNotNull())
        .groupBy(*CELL, "reason")
        .agg(F.sum("n").alias("_n"))
        .select(F.lit("REJECT").alias("event_type"), *CELL, "reason")
    )
    return refused.unionByName(decided.select(F.col("outcome").alias("event_type"), *CELL, "reason"))


def spends(decided: DataFrame, window_day: Column, boundary: str, privacy_unit: str = "user") -> DataFrame:
    """Ledger rows of the released windows."""
    level = F.element_at(F.array(*[F.lit(g) for g in ("ITEM", "CLUSTER", "AGGREGATE")]), F.col("lvl") + 1)
    return lg.ledger_rows(
        decided.filter("outcome <> 'BLOCK'").select(
            "feature_id", "contract_version", F.lit(boundary).alias("boundary"), level.alias("granularity"),
            F.lit(privacy_unit).alias("privacy_unit"), window_day.alias("window_day"),
            F.col("epsilon").alias("epsilon_spend"), F.col("delta").alias("delta_spend"),
        )
    )
