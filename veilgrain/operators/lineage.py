"""Risk floors along feature lineage, family penalties and domain budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.session import ensure_checkpoint_dir


def raised(state: DataFrame, frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Floors after one round and whether they rose.

    The joins are merges: a broadcast would send links, frontier or offers through the driver again in every round.
    """
    offered = (
        links.hint("merge")
        .join(frontier.select(F.col("feature_id").alias("parent"), F.col("floor").alias("_f")), "parent")
        .groupBy(F.col("child").alias("feature_id"))
        .agg(F.max("_f").alias("_f"))
    )
    return state.hint("merge").join(offered, "feature_id", "left").select(
        "feature_id",
        F.greatest("floor", "_f").alias("floor"),
        F.coalesce(F.col("_f") > F.col("floor"), F.lit(False)).alias("_rose"),
    )


def inherit_floor(own: DataFrame, edges: DataFrame) -> DataFrame:
    """Highest risk among a feature and all its ancestors.

    ``own`` is (feature_id, risk), ``edges`` (child, parent). Rounds follow the depth of the lineage, not the number
    of features: only features whose floor rose in the last round pass it on. Each round is checkpointed, so its
    plan stays short and a lost executor costs one round. A floor only rises, to one of the given risks, so the rounds
    end for any depth and for cycles, too.
    """
    ensure_checkpoint_dir(own.sparkSession)
    links = edges.select(F.col("child"), F.col("parent")).distinct().checkpoint()
    state = own.select("feature_id", F.col("risk").alias("floor")).checkpoint()
    frontier = state
    while True:
        step = raised(state, frontier, links).checkpoint()
        state = step.drop("_rose")
        frontier = step.filter("_rose").drop("_rose")
        if frontier.isEmpty():
            return state


def family_penalty(scores: DataFrame, family: str, per_member: float) -> DataFrame:
    """Raise every member of a feature family by a step per further sensitive member, at most to 1."""
    sizes = scores.groupBy(family).agg(F.count_if(F.col("sensitive")).alias("_n"))
    extra = F.greatest(F.lit(0), F.col("_n") - 1) * F.lit(per_member)
    return scores.join(sizes, family).withColumn("risk", F.least(F.lit(1.0), F.col("risk") + extra)).drop("_n")


def domain_budget(scores: DataFrame, domain: str, cap: float) -> DataFrame:
    """Total risk per domain and whether it exceeds the cap."""
    return scores.groupBy(domain).agg(F.sum("risk").alias("total_risk")).withColumn(
        "over_budget", F.round("total_risk", 9) > cap
    )
