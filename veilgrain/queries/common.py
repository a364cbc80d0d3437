"""Inputs shared by the registered queries, each with the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.operators import stats
from veilgrain.operators import transforms as tr
from veilgrain.schema import ReleaseContract
from veilgrain.sources import tables

CONTRACT = ReleaseContract(secret="for-checks-only", digest="md5")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

# ---- events with week, day and the granularity ladder -----------------------------------------------------------
EV = """ev AS (
  SELECT event_id, user_id AS contributor, ts, event_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value,
         strftime(date_trunc('week', ts), '%Y-%m-%d') AS window_id,
         strftime(ts, '%Y-%m-%d') AS day_id
  FROM events)"""
LADDER = (
    EV
    + """, lad AS (
  SELECT ev.*, l.level, l.lvl,
         CASE l.level WHEN 'ITEM' THEN event_type || '|' || k
                      WHEN 'CLUSTER' THEN event_type || '|' || (k // 10) ELSE 'all' END AS cell
  FROM ev, (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) l(level, lvl))"""
)


def weekly_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = tables.events(spark, sf)
    return ev.withColumn("window_id", tr.week_id(F.col("ts"))).withColumn("day_id", tr.day_id(F.col("ts")))


def item_cell() -> Column:
    return F.concat_ws("|", "event_type", F.col("k").cast("string"))


def cluster_cell() -> Column:
    return F.concat_ws("|", "event_type", F.floor(F.col("k") / 10).cast("string"))


def laddered_events(spark: SparkSession, sf: str) -> DataFrame:
    return tr.ladder(weekly_events(spark, sf), item_cell(), cluster_cell())


def high_value() -> Column:
    """The 0/1 outcome of an event."""
    return (F.col("value") > 50).cast("double")


def feature_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of each event type (as feature), week and level."""
    ev = weekly_events(spark, sf).withColumn("feature_id", F.col("event_type"))
    return stats.ladder_cells(ev, ["feature_id", "window_id"], item_cell(), cluster_cell(), high_value())


# ---- monthly shipments per part, brand and in total -------------------------------------------------------------
SHIP = """ship AS (
  SELECT o_custkey AS contributor, l_orderkey, l_linenumber, l_partkey, p_brand, l_extendedprice AS value,
         l_returnflag, l_shipdate, strftime(l_shipdate, '%Y-%m') AS window_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def monthly_shipments(spark: SparkSession, sf: str) -> DataFrame:
    return tables.shipments(spark, sf).select(
        "contributor",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "p_brand",
        F.col("l_extendedprice").alias("value"),
        "l_returnflag",
        "l_shipdate",
        tr.month_id(F.col("l_shipdate")).alias("window_id"),
    )


# ---- contracts: one version per event type and week --------------------------------------------------------------
CONTRACTS = (
    EV
    + """, contracts AS (
  SELECT event_type AS feature_id, window_id AS contract_version,
         CASE event_type WHEN 'signup' THEN 'SHUFFLE' ELSE 'CENTRAL' END AS boundary,
         CASE WHEN count(*) >= 420 THEN 'ITEM' WHEN count(*) >= 300 THEN 'CLUSTER' ELSE 'AGGREGATE' END AS granularity,
         min(ts) AS issued_at, count(*) AS n
  FROM ev GROUP BY event_type, window_id)"""
)


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("*")
    return (
        weekly_events(spark, sf)
        .groupBy(F.col("event_type").alias("feature_id"), F.col("window_id").alias("contract_version"))
        .agg(
            F.when(n >= 420, "ITEM").when(n >= 300, "CLUSTER").otherwise("AGGREGATE").alias("granularity"),
            F.min("ts").alias("issued_at"),
            n.alias("n"),
        )
        .withColumn("boundary", F.when(F.col("feature_id") == "signup", "SHUFFLE").otherwise("CENTRAL"))
    )


# ---- shuffle messages: protocol by event type, payload from value and k ------------------------------------------
MESSAGES = (
    EV
    + """, msg AS (
  SELECT ev.*, CASE WHEN event_type IN ('click', 'view') THEN 'bounded_increment'
                    WHEN event_type = 'error' THEN 'sketch' ELSE 'category' END AS format,
         CAST(floor(value / 100) AS INT) AS inc, CAST(k // 20 AS INT) AS cat,
         CAST(k % 10 AS INT) AS srow, CAST(k // 4 AS INT) AS scol, CAST(floor(value / 50) AS INT) AS supd
  FROM ev)"""
)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    data = (
        F.when(F.col("event_type").isin("click", "view"), F.array(F.floor(v / 100).cast("int")))
        .when(
            F.col("event_type") == "error",
            F.array((k % 10).cast("int"), F.floor(k / 4).cast("int"), F.floor(v / 50).cast("int")),
        )
        .otherwise(F.array(F.floor(k / 20).cast("int")))
    )
    fmt = (
        F.when(F.col("event_type").isin("click", "view"), "bounded_increment")
        .when(F.col("event_type") == "error", "sketch")
        .otherwise("category")
    )
    return weekly_events(spark, sf).withColumn("format", fmt).withColumn("data", data)
