"""Physical plans of the larger queries: narrow scans, pruned partitions, no nested loops, no repeated scans."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from veilgrain.queries import load
from veilgrain.sources import sinks

QUERIES, _ = load()


def plan_of(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet[^\n]*/{table}\.parquet", plan))


@pytest.mark.parametrize(
    "name,table",
    [
        ("feature_stats", "events"), ("tail_mass", "events"), ("value_persistence", "events"), ("key_persistence_join", "events"),
        ("frequency_cap", "events"), ("lps_drift", "lineitem"), ("best_stats", "lineitem"), ("inv_no_escalation", "lineitem"),
        ("item_to_cluster", "lineitem"), ("ladder_lookup_join", "lineitem"), ("hr_k_estimate", "events"), ("dp_hist", "events"),
    ],
)
def test_one_scan_of_the_large_table(spark, name, table):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = plan_of(spark, QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    distinct = scans(plan, table) - plan.count("ReusedExchange")
    assert distinct <= 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(spark, QUERIES["inv_retention"](spark, SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} <= {"l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"}


def test_staging_reads_prune_partitions(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 4).cast("string").alias("window_id"), F.col("id").alias("event_count"))
    path = sinks.write_partitioned(df, str(tmp_path / "staging"), ["window_id"])
    plan = plan_of(spark, sinks.read_partitioned(df, path).filter("window_id = '2'"))
    assert re.search(r"PartitionFilters: \[[^\]]*window_id", plan)


def test_repeated_write_replaces_its_partitions_only(spark, tmp_path):
    df = spark.range(40).select((F.col("id") % 4).cast("string").alias("window_id"), F.col("id").alias("event_count"))
    path = sinks.write_partitioned(df, str(tmp_path / "staging"), ["window_id"])
    sinks.write_partitioned(df.filter("window_id = '1'"), path, ["window_id"])
    assert sinks.read_partitioned(df, path).count() == 40
