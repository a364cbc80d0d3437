"""Feature catalog and policy readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.schema import FEATURE_SPEC, POLICY_SPEC, Thresholds


def with_spec_defaults(specs: DataFrame) -> DataFrame:
    """Fill what a spec file may leave out: dtype, flags, stability, ndv, ttl, maps and tags."""
    return specs.select(
        "feature_id",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(
            F.transform(
                "fields",
                lambda f: F.struct(
                    f["name"].alias("name"),
                    F.coalesce(f.dtype, F.lit("string")).alias("dtype"),
                    F.coalesce(f.is_sensitive, F.lit(False)).alias("is_sensitive"),
                    F.coalesce(f.is_identifier, F.lit(False)).alias("is_identifier"),
                    f.cardinality_hint.alias("cardinality_hint"),
                ),
            ),
            F.array().cast(FEATURE_SPEC["fields"].dataType),
        ).alias("fields"),
        F.coalesce(
            F.transform(
                "join_keys",
                lambda k: F.struct(
                    k["name"].alias("name"),
                    F.coalesce(k.stability, F.lit(1.0)).alias("stability"),
                    F.coalesce(k.ndv_hint, F.lit(0).cast("bigint")).alias("ndv_hint"),
                ),
            ),
            F.array().cast(FEATURE_SPEC["join_keys"].dataType),
        ).alias("join_keys"),
        F.coalesce("ttl_days", F.lit(0)).alias("ttl_days"),
        F.coalesce("bucketizations", F.create_map().cast("map<string,int>")).alias("bucketizations"),
        F.coalesce("privacy_unit", F.lit("user")).alias("privacy_unit"),
        F.coalesce("policy_tags", F.array().cast("array<string>")).alias("policy_tags"),
        F.coalesce("support_hint", F.create_map().cast("map<string,bigint>")).alias("support_hint"),
    )


def read_features(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Feature specs from JSON. Large catalogs should be JSON lines (``multi_line=False``), which can be split."""
    return with_spec_defaults(spark.read.schema(FEATURE_SPEC).json(path, multiLine=multi_line))


def overlay(defaults: Mapping[str, float], given: Column) -> Column:
    """``given`` laid over literal defaults."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    given = F.coalesce(given, F.create_map().cast("map<string,double>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k)), given)


def with_policy_defaults(policies: DataFrame) -> DataFrame:
    base = Thresholds()
    th = F.col("thresholds")
    return policies.select(
        "policy_version",
        F.coalesce(th["k_min"], F.lit(1)).alias("k_min"),
        overlay(base.tau_boundary, th["tau_boundary"]).alias("tau_boundary"),
        overlay(base.tau_granularity, th["tau_granularity"]).alias("tau_granularity"),
    )


def read_policy(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Thresholds from JSON policy files, laid over the default caps; k_min defaults to 1."""
    return with_policy_defaults(spark.read.schema(POLICY_SPEC).json(path, multiLine=multi_line))
