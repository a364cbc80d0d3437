"""A feature catalog with one feature per row of ``part``; its support is measured on ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.schema import FIELD, JOIN_KEY
from veilgrain.sources import tables

# Catalog rows: fields, join keys, ttl, bucketizations and tags follow from size, type and key of the part.
CAT = """cat AS (
  SELECT 'f_' || p_partkey AS feature_id, p_partkey, p_brand, p_size, p_type, 1 + p_size * 2 AS ttl_days,
    list_concat([{'name': 'age', 'dtype': 'int', 'is_sensitive': p_type IN ('ECONOMY', 'PROMO', 'SMALL'),
                  'is_identifier': false, 'cardinality_hint': NULL::BIGINT, 'buckets': p_size * 4},
                 {'name': 'brand', 'dtype': 'string', 'is_sensitive': false, 'is_identifier': false,
                  'cardinality_hint': CASE WHEN p_size < 30 THEN p_partkey + 1 END, 'buckets': NULL}],
      CASE WHEN p_size >= 15 THEN [{'name': 'zip', 'dtype': 'string', 'is_sensitive': true, 'is_identifier': false,
                  'cardinality_hint': NULL::BIGINT, 'buckets': p_size * 12}] ELSE [] END,
      CASE WHEN p_type IN ('LARGE', 'PROMO') THEN [{'name': 'device_id', 'dtype': 'string', 'is_sensitive': false,
                  'is_identifier': true, 'cardinality_hint': NULL::BIGINT, 'buckets': NULL}] ELSE [] END) AS fields,
    list_concat(
      CASE WHEN p_type <> 'MEDIUM' THEN [{'name': 'uid', 'stability': (p_partkey % 100) / 100.0::DOUBLE,
                  'ndv_hint': CASE WHEN p_size >= 10 THEN p_partkey * 100 END}] ELSE [] END,
      CASE WHEN p_type = 'STANDARD' THEN [{'name': 'zip', 'stability': 0.3::DOUBLE, 'ndv_hint': NULL::BIGINT}] ELSE [] END) AS join_keys,
    CASE p_type WHEN 'ECONOMY' THEN ['age'] WHEN 'PROMO' THEN ['age', 'location'] WHEN 'SMALL' THEN ['health']
      WHEN 'LARGE' THEN ['financial', 'children'] WHEN 'STANDARD' THEN ['custom'] ELSE [] END AS policy_tags
  FROM part)"""
CAT_FIELDS = """fld AS (
  SELECT feature_id, f.name AS name, f.dtype AS dtype, f.is_sensitive AS is_sensitive, f.is_identifier AS is_identifier,
         f.cardinality_hint AS cardinality_hint, f.buckets AS buckets, pos
  FROM (SELECT feature_id, unnest(fields) AS f, generate_subscripts(fields, 1) AS pos FROM cat))"""
CAT_KEYS = """keys AS (
  SELECT feature_id, j.name AS name, j.stability AS stability, j.ndv_hint AS ndv_hint
  FROM (SELECT feature_id, unnest(join_keys) AS j FROM cat))"""
# Support = distinct orders per part, per brand and overall.
CAT_SUPPORT = """sup AS (
  SELECT cat.feature_id,
         si AS s_item, sc AS s_cluster, sa AS s_agg
  FROM cat LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS si FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey
  LEFT JOIN (SELECT p_brand, count(DISTINCT l_orderkey) AS sc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) b USING (p_brand)
  CROSS JOIN (SELECT count(DISTINCT l_orderkey) AS sa FROM lineitem) c)"""


def _field(name, dtype, sensitive, identifier, hint=None):
    hint = F.lit(None).cast("bigint") if hint is None else hint
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(dtype).alias("dtype"),
        sensitive.alias("is_sensitive"),
        F.lit(identifier).alias("is_identifier"),
        hint.alias("cardinality_hint"),
    )


def _present(condition, value):
    return F.when(condition, value)


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Feature specs without support hints."""
    size, kind, key = F.col("p_size"), F.col("p_type"), F.col("p_partkey")
    no = F.lit(False)
    fields = F.array(
        _field("age", "int", kind.isin("ECONOMY", "PROMO", "SMALL"), False),
        _field("brand", "string", no, False, F.when(size < 30, key + 1)),
        _present(size >= 15, _field("zip", "string", F.lit(True), False)),
        _present(kind.isin("LARGE", "PROMO"), _field("device_id", "string", no, True)),
    )
    uid = F.struct(
        F.lit("uid").alias("name"),
        ((key % 100) / 100.0).alias("stability"),
        F.when(size >= 10, key * 100).alias("ndv_hint"),
    )
    zip_key = F.struct(
        F.lit("zip").alias("name"), F.lit(0.3).alias("stability"), F.lit(None).cast("bigint").alias("ndv_hint")
    )
    keys = F.array(_present(kind != "MEDIUM", uid), _present(kind == "STANDARD", zip_key))
    tags = (
        F.when(kind == "ECONOMY", F.array(F.lit("age")))
        .when(kind == "PROMO", F.array(F.lit("age"), F.lit("location")))
        .when(kind == "SMALL", F.array(F.lit("health")))
        .when(kind == "LARGE", F.array(F.lit("financial"), F.lit("children")))
        .when(kind == "STANDARD", F.array(F.lit("custom")))
        .otherwise(F.array().cast("array<string>"))
    )
    buckets = F.when(
        size >= 15, F.create_map(F.lit("age"), size * 4, F.lit("zip"), size * 12)
    ).otherwise(F.create_map(F.lit("age"), size * 4))
    # dealt out while rows are narrow: the specs are many times as wide, and a file of one row group is read by one task
    parts = tables.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_type").repartition("p_partkey")
    return parts.select(
        F.concat(F.lit("f_"), key).alias("feature_id"),
        "p_partkey",
        "p_brand",
        "p_size",
        "p_type",
        F.array_compact(fields).cast(f"array<{FIELD.simpleString()}>").alias("fields"),
        F.array_compact(keys).cast(f"array<{JOIN_KEY.simpleString()}>").alias("join_keys"),
        (1 + size * 2).alias("ttl_days"),
        buckets.alias("bucketizations"),
        F.lit("order").alias("privacy_unit"),
        tags.alias("policy_tags"),
    )


def with_support(spark: SparkSession, sf: str, specs: DataFrame) -> DataFrame:
    """Add ``support_hint``: distinct orders per part, per brand and overall, null for parts without history.

    One scan: distinct (part, order) pairs feed all three levels. The distinct counts are taken in two
    aggregations, so a part or brand with a third of all rows is split over tasks.
    """
    pairs = tables.table(spark, sf, "lineitem").select("l_partkey", "l_orderkey").distinct()
    by_part = pairs.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("s_item"))
    brands = specs.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    by_brand = (
        pairs.join(brands, "l_partkey")
        .select("p_brand", "l_orderkey")
        .distinct()
        .groupBy("p_brand")
        .agg(F.count("*").alias("s_cluster"))
    )
    overall = pairs.select("l_orderkey").distinct().agg(F.count("*").alias("s_agg"))
    return (
        specs.join(by_part, "p_partkey", "left")
        .join(by_brand, "p_brand", "left")
        .withColumn("s_agg", overall.scalar())
        .withColumn(
            "support_hint",
            F.create_map(
                F.lit("ITEM"), F.col("s_item"),
                F.lit("CLUSTER"), F.col("s_cluster"),
                F.lit("AGGREGATE"), F.col("s_agg"),
            ),
        )
        .drop("s_item", "s_cluster", "s_agg")
    )


def supported_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return with_support(spark, sf, catalog(spark, sf))
