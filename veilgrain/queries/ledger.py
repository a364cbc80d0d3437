"""Budget ledger derived from events: one spend per event type and day."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import ledger as lg
from veilgrain.queries.registry import R, query, r
from veilgrain.sources import tables

LEDGER = """ledger AS (
  SELECT event_type AS feature_id, 'v1' AS contract_version, CAST(ts AS DATE) AS window_day,
         sum(0.001 * (1 + event_id % 10)) / 10 AS epsilon_spend, count(*) * 1e-9 AS delta_spend
  FROM events GROUP BY ALL)"""


def ledger(spark, sf):
    raw = (
        tables.table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("feature_id"), F.to_date("ts").alias("window_day"))
        .agg((F.sum(0.001 * (1 + F.col("event_id") % 10)) / 10).alias("epsilon_spend"),
             (F.count("*") * 1e-9).alias("delta_spend"))
        .withColumn("contract_version", F.lit("v1"))
        .withColumn("boundary", F.lit("CENTRAL"))
        .withColumn("granularity", F.lit("CLUSTER"))
        .withColumn("privacy_unit", F.lit("user"))
        .withColumn("created_at", F.col("window_day").cast("timestamp"))
    )
    return lg.ledger_rows(raw)


SPEND = f"""{LEDGER}, spend AS (
  SELECT a.feature_id, a.window_day, max(a.epsilon_spend) AS eps, max(a.delta_spend) AS dlt, sum(b.epsilon_spend) AS spent, sum(b.delta_spend) AS spent_d
  FROM ledger a JOIN ledger b ON a.feature_id = b.feature_id AND b.window_day BETWEEN a.window_day - 6 AND a.window_day
  GROUP BY ALL)"""


@query(
    "window_spend",
    f"WITH {SPEND} SELECT feature_id, window_day, {R('spent')} AS spent_epsilon, {R('spent_d', 9)} AS spent_delta FROM spend",
)
def window_spend(spark, sf):
    return lg.window_spend(ledger(spark, sf), 7).select(
        "feature_id", "window_day", r(F.col("spent_epsilon")).alias("spent_epsilon"),
        r(F.col("spent_delta"), 9).alias("spent_delta"),
    )


@query(
    "can_spend",
    f"""WITH {SPEND} SELECT feature_id, window_day, round(spent + 0.03, 12) <= 0.26 AND round(spent_d + 0, 12) <= 1e-6 AS allowed
FROM spend""",
)
def can_spend(spark, sf):
    spent = lg.window_spend(ledger(spark, sf), 7)
    ok = lg.can_spend(F.col("spent_epsilon"), F.col("spent_delta"), F.lit(0.03), F.lit(0.0), 0.26, 1e-6)
    return spent.select("feature_id", "window_day", ok.alias("allowed"))


@query(
    "adaptive_eps",
    f"""WITH {SPEND} SELECT feature_id, window_day, {R('CASE WHEN 29 - day(window_day) > 0 THEN greatest(0.0, 0.3 - spent) / (29 - day(window_day)) ELSE 0.0 END')} AS next_epsilon
FROM spend""",
)
def adaptive_eps(spark, sf):
    """The number of releases left in the plan runs out on the 29th."""
    spent = lg.window_spend(ledger(spark, sf), 7)
    nxt = lg.adaptive_epsilon(F.col("spent_epsilon"), 0.3, 29 - F.dayofmonth("window_day"))
    return spent.select("feature_id", "window_day", r(nxt).alias("next_epsilon"))


@query(
    "exposure_epsilon",
    f"""WITH {LEDGER} SELECT feature_id, {R('sum(epsilon_spend)')} AS eps_eff, {R('greatest(0, least(1, sum(epsilon_spend) / 1.1))')} AS s_eps
FROM ledger GROUP BY 1""",
)
def exposure_epsilon(spark, sf):
    return lg.exposure(ledger(spark, sf), 1.1).select(
        "feature_id", r(F.col("eps_eff")).alias("eps_eff"), r(F.col("s_eps")).alias("s_eps")
    )
