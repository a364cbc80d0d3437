"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import joins
from veilgrain.operators.transforms import month_id
from veilgrain.queries import common as cm
from veilgrain.queries.catalog import CAT, catalog
from veilgrain.queries.ledger import LEDGER, ledger
from veilgrain.queries.registry import R, query, r
from veilgrain.sources import tables

STATS_CELLS = (
    cm.LADDER
    + """, cells AS (SELECT event_type AS feature_id, window_id, level, lvl, cell, count(*) AS cnt FROM lad GROUP BY ALL),
  st AS (SELECT feature_id, window_id, level, lvl, sum(cnt)::BIGINT AS n_obs, count(*) AS n_distinct, min(cnt) AS min_support
         FROM cells GROUP BY ALL)"""
)


@query(
    "scorecard_stats_policy_join",
    f"""WITH {STATS_CELLS}, sc AS (
  SELECT event_type AS feature_id, CASE WHEN event_type IN ('click', 'view') THEN 'policy_a' ELSE 'policy_b' END AS policy_version,
         CASE WHEN avg(value) > 49 THEN ['CLUSTER', 'AGGREGATE'] ELSE ['ITEM', 'CLUSTER', 'AGGREGATE'] END AS admissible
  FROM ev GROUP BY event_type),
pol AS (SELECT * FROM (VALUES ('policy_a', 16.0, 20), ('policy_b', 9.0, 1)) p(policy_version, noise_variance, threshold))
SELECT feature_id, window_id, level AS granularity, min_support, {R('noise_variance / (n_obs / n_distinct)')} AS eff_var
FROM st JOIN sc USING (feature_id) JOIN pol USING (policy_version)
WHERE list_contains(admissible, level) AND min_support >= threshold""",
)
def scorecard_stats_policy_join(spark, sf):
    stats = (
        cm.feature_cells(spark, sf)
        .groupBy("feature_id", "window_id", F.col("level").alias("granularity"))
        .agg(F.sum("cnt").alias("n_obs"), F.count("*").alias("n_distinct"), F.min("cnt").alias("min_support"))
    )
    fine = F.array(F.lit("ITEM"), F.lit("CLUSTER"), F.lit("AGGREGATE"))
    cards = (
        tables.events(spark, sf)
        .groupBy(F.col("event_type").alias("feature_id"))
        .agg(F.avg("value").alias("v"))
        .select(
            "feature_id",
            F.when(F.col("feature_id").isin("click", "view"), "policy_a").otherwise("policy_b").alias("policy_version"),
            F.when(F.col("v") > 49, F.slice(fine, 2, 2)).otherwise(fine).alias("admissible"),
        )
    )
    # the policy table is a fixed handful of rows
    policies = spark.createDataFrame(
        [("policy_a", 16.0, 20), ("policy_b", 9.0, 1)], "policy_version string, noise_variance double, threshold int"
    )
    return (
        stats.join(cards, "feature_id")
        .join(F.broadcast(policies), "policy_version")
        .filter(F.array_contains("admissible", F.col("granularity")) & (F.col("min_support") >= F.col("threshold")))
        .select(
            "feature_id", "window_id", "granularity", "min_support",
            r(F.col("noise_variance") / (F.col("n_obs") / F.col("n_distinct"))).alias("eff_var"),
        )
    )


@query(
    "ladder_lookup_join",
    f"""WITH {cm.SHIP}, item AS (SELECT l_partkey, window_id, count(*) AS n FROM lineitem, LATERAL (SELECT strftime(l_shipdate, '%Y-%m') AS window_id) GROUP BY ALL)
SELECT p_brand AS cluster_id, window_id, count(*) AS n_items, sum(n)::BIGINT AS n_rows
FROM item JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
)
def ladder_lookup_join(spark, sf):
    """Items are counted before the lookup, so the join sees one row per item and window."""
    items = (
        tables.table(spark, sf, "lineitem")
        .groupBy("l_partkey", month_id(F.col("l_shipdate")).alias("window_id"))
        .agg(F.count("*").alias("n"))
    )
    mapping = tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cluster_id")
    )
    return items.join(mapping, "l_partkey").groupBy("cluster_id", "window_id").agg(
        F.count("*").alias("n_items"), F.sum("n").alias("n_rows")
    )


@query(
    "active_contract_join",
    f"""WITH {cm.CONTRACTS}, act AS (SELECT feature_id, max(contract_version) AS active_version,
   max_by(granularity, contract_version) AS granularity FROM contracts GROUP BY 1)
SELECT event_id, active_version, granularity, CASE WHEN active_version IS NULL THEN 'NO_ACTIVE_CONTRACT' END AS reject_reason
FROM ev LEFT JOIN act ON event_type = feature_id""",
)
def active_contract_join(spark, sf):
    active = cm.contracts(spark, sf).groupBy("feature_id").agg(
        F.max("contract_version").alias("active_version"),
        F.max_by("granularity", "contract_version").alias("granularity"),
    )
    ev = tables.events(spark, sf).select("event_id", F.col("event_type").alias("feature_id"))
    return ev.join(active, "feature_id", "left").select(
        "event_id",
        "active_version",
        "granularity",
        F.when(F.col("active_version").isNull(), "NO_ACTIVE_CONTRACT").alias("reject_reason"),
    )


@query(
    "asof_contract_join",
    f"""WITH {cm.CONTRACTS}
SELECT e.event_id, max(c.contract_version) AS contract_version, max_by(c.granularity, c.issued_at) AS granularity,
  CASE WHEN max(c.contract_version) IS NULL THEN 'NO_CONTRACT' END AS reject_reason
FROM ev e LEFT JOIN contracts c ON e.event_type = c.feature_id AND c.issued_at + INTERVAL 1 DAY <= e.ts GROUP BY e.event_id""",
)
def asof_contract_join(spark, sf):
    """The contract in force at each event; contracts take effect a day after they are issued, so the first events have none."""
    ev = tables.events(spark, sf).select("event_id", F.col("event_type").alias("feature_id"), "ts")
    in_force = cm.contracts(spark, sf).withColumn("issued_at", F.col("issued_at") + F.expr("INTERVAL 1 DAY"))
    return joins.asof_contract_gate(ev, in_force).select("event_id", "contract_version", "granularity", "reject_reason")


@query(
    "ledger_range_join",
    f"""WITH {LEDGER}, probe AS (SELECT DISTINCT feature_id, window_day + d AS asof FROM ledger, (VALUES (0), (3)) t(d))
SELECT p.feature_id, p.asof, {R('coalesce(sum(epsilon_spend), 0)')} AS spent_epsilon, {R('coalesce(sum(delta_spend), 0)', 9)} AS spent_delta
FROM probe p LEFT JOIN ledger l ON l.feature_id = p.feature_id AND l.window_day BETWEEN p.asof - 6 AND p.asof
GROUP BY ALL""",
)
def ledger_range_join(spark, sf):
    led = ledger(spark, sf)
    asof = led.select("feature_id", F.explode(F.array("window_day", F.date_add("window_day", 3))).alias("asof"))
    return joins.ledger_range_join(asof, led, 7).select(
        "feature_id", "asof", r(F.col("spent_epsilon")).alias("spent_epsilon"),
        r(F.col("spent_delta"), 9).alias("spent_delta"),
    )


FEATURE_OPTIONS = """opt AS (SELECT feature_id, p_type, b AS boundary, g AS granularity FROM cat,
  LATERAL (SELECT unnest(CASE WHEN p_type = 'LARGE' THEN ['LOCAL', 'SHUFFLE'] ELSE ['LOCAL', 'SHUFFLE', 'CENTRAL'] END) AS b),
  LATERAL (SELECT unnest(CASE WHEN p_size > 40 THEN ['CLUSTER', 'AGGREGATE'] ELSE ['ITEM', 'CLUSTER', 'AGGREGATE'] END) AS g))"""


def capable_features(spark, sf):
    local = [F.lit(b) for b in ("LOCAL", "SHUFFLE", "CENTRAL")]
    gran = [F.lit(g) for g in ("ITEM", "CLUSTER", "AGGREGATE")]
    return catalog(spark, sf).select(
        "feature_id",
        "p_type",
        F.when(F.col("p_type") == "LARGE", F.array(*local[:2])).otherwise(F.array(*local)).alias("boundary_capabilities"),
        F.when(F.col("p_size") > 40, F.array(*gran[1:])).otherwise(F.array(*gran)).alias("granularity_candidates"),
    )


@query("candidate_cross_join", f"WITH {CAT}, {FEATURE_OPTIONS} SELECT feature_id, boundary, granularity FROM opt")
def candidate_cross_join(spark, sf):
    return joins.candidate_pairs(capable_features(spark, sf)).select("feature_id", "boundary", "granularity")


@query(
    "option_cross_join",
    f"""WITH {CAT} SELECT feature_id, b AS boundary, g AS granularity FROM cat,
  (VALUES ('LOCAL'), ('SHUFFLE'), ('CENTRAL')) x(b), (VALUES ('ITEM'), ('CLUSTER'), ('AGGREGATE')) y(g)""",
)
def option_cross_join(spark, sf):
    return joins.with_options(catalog(spark, sf).select("feature_id"))


@query(
    "deny_anti_join",
    f"""WITH {CAT}, {FEATURE_OPTIONS} SELECT feature_id, boundary, granularity FROM opt
  WHERE NOT (boundary = 'CENTRAL' AND p_type IN ('SMALL', 'PROMO'))""",
)
def deny_anti_join(spark, sf):
    features = capable_features(spark, sf)
    denied = features.filter(F.col("p_type").isin("SMALL", "PROMO")).select("feature_id", F.lit("CENTRAL").alias("boundary"))
    return joins.deny_pairs(joins.candidate_pairs(features), denied).select("feature_id", "boundary", "granularity")


DATASETS = """ds AS (SELECT p_partkey, list_filter([
   CASE WHEN p_size < 10 THEN 'uid' END, CASE WHEN p_type = 'PROMO' THEN 'device' END,
   CASE WHEN p_size BETWEEN 8 AND 20 THEN 'zip' END, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN p_brand END],
   lambda x: x IS NOT NULL) AS keys FROM part)"""


@query(
    "join_degree_self_join",
    f"""WITH {DATASETS}
SELECT a.p_partkey, count(b.p_partkey) AS degree FROM ds a
LEFT JOIN ds b ON a.p_partkey <> b.p_partkey AND list_has_any(a.keys, b.keys) GROUP BY 1""",
)
def join_degree_self_join(spark, sf):
    part = tables.table(spark, sf, "part")
    keys = F.array_compact(
        F.array(
            F.when(F.col("p_size") < 10, "uid"),
            F.when(F.col("p_type") == "PROMO", "device"),
            F.when(F.col("p_size").between(8, 20), "zip"),
            F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.col("p_brand")),
        )
    )
    return joins.join_degree(part.select("p_partkey", keys.alias("keys")), "p_partkey", "keys")


@query(
    "key_persistence_join",
    f"""WITH {cm.EV}, seen AS (SELECT DISTINCT contributor, CAST(ts AS DATE) AS day FROM ev)
SELECT a.day, count(*) AS n_keys, count(b.day) AS n_again, {R('count(b.day) / count(*)')} AS persistence
FROM seen a LEFT JOIN seen b ON a.contributor = b.contributor AND b.day = a.day + 1 GROUP BY a.day""",
)
def key_persistence_join(spark, sf):
    ev = cm.weekly_events(spark, sf)
    return joins.key_persistence(ev, "contributor", "day_id").withColumn("persistence", r(F.col("persistence")))


@query(
    "join_gate",
    f"""WITH {CAT}, req AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, 'f_' || l_partkey AS feature_id,
         CASE l_returnflag WHEN 'A' THEN 'uid' WHEN 'N' THEN 'zip' ELSE 'region' END AS join_key,
         CASE l_linestatus WHEN 'F' THEN 'CENTRAL' ELSE 'SHUFFLE' END AS lb, CASE WHEN l_quantity < 25 THEN 'CENTRAL' ELSE 'SHUFFLE' END AS rb
  FROM lineitem),
con AS (SELECT feature_id, p_size > 40 AS forbid_all, CASE WHEN p_size > 20 THEN ['uid'] ELSE []::VARCHAR[] END AS forbid,
               CASE WHEN p_type = 'LARGE' THEN 'SHUFFLE' ELSE 'CENTRAL' END AS boundary FROM cat)
SELECT verdict, join_key, count(*) AS n, {R('sum(l_extendedprice)', 2)} AS total FROM (
  SELECT *, CASE WHEN boundary IS NULL THEN 'NO_CONTRACT' WHEN forbid_all OR list_contains(forbid, join_key) THEN 'JOIN_KEY_FORBIDDEN'
    WHEN lb <> boundary OR rb <> boundary THEN 'JOIN_OUTSIDE_BOUNDARY' ELSE 'ALLOWED' END AS verdict
  FROM req LEFT JOIN con USING (feature_id)) GROUP BY ALL""",
)
def join_gate(spark, sf):
    requests = tables.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f_"), "l_partkey").alias("feature_id"),
        F.when(F.col("l_returnflag") == "A", "uid").when(F.col("l_returnflag") == "N", "zip").otherwise("region").alias("join_key"),
        F.when(F.col("l_linestatus") == "F", "CENTRAL").otherwise("SHUFFLE").alias("left_boundary"),
        F.when(F.col("l_quantity") < 25, "CENTRAL").otherwise("SHUFFLE").alias("right_boundary"),
        "l_extendedprice",
    )
    constraints = catalog(spark, sf).select(
        "feature_id",
        (F.col("p_size") > 40).alias("forbid_joins_all"),
        F.when(F.col("p_size") > 20, F.array(F.lit("uid"))).otherwise(F.array().cast("array<string>")).alias("forbid_joins_on"),
        F.when(F.col("p_type") == "LARGE", "SHUFFLE").otherwise("CENTRAL").alias("boundary"),
    )
    return (
        joins.join_gate(requests, constraints)
        .groupBy("verdict", "join_key")
        .agg(F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("total"))
    )
