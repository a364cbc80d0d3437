"""Checks of a staging table before a release, and its dimension columns."""

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import staging

ROW = ("c", "v1", "f", "2024-01-01", "ITEM", 5, 1.0, 1.0, 3, 7, "click|12")
KINDS = ", ".join(f"{c} {t}" for c, t in staging.STAGING_TYPES.items()) + ", cell string"
DIMS = ("event_bucket", "k_bucket")


@pytest.fixture(scope="module")
def table(spark):
    return staging.with_dimensions(spark.createDataFrame([ROW, ROW[:-1] + ("all",), ROW[:-1] + ("view",)], KINDS), DIMS)


@pytest.fixture(scope="module")
def active(spark):
    return spark.createDataFrame([("c", "v1"), ("c", "v1"), ("d", "v2")], "contract_id string, contract_version string")


def test_dimensions(table):
    got = {r.cell: (r.event_bucket, r.k_bucket) for r in table.collect()}
    assert got == {"click|12": ("click", "12"), "all": ("UNKNOWN", "UNKNOWN"), "view": ("view", "UNKNOWN")}


def test_a_sound_table_passes(table, active):
    assert staging.validate_staging(table, active, DIMS, ("user_id",)).count() == 3
    assert staging.validate_staging(table.limit(0), active, DIMS, ("user_id",)).count() == 0


@pytest.mark.parametrize(
    "change,code",
    [
        (lambda t: t.drop("value_sumsq"), "REJECT_SCHEMA: missing"),
        (lambda t: t.drop("k_bucket"), "REJECT_SCHEMA: missing"),
        (lambda t: t.withColumn("event_count", F.col("event_count").cast("string")), "REJECT_SCHEMA: types"),
        (lambda t: t.withColumn("user_id", F.lit("u")), "REJECT_SCHEMA: forbidden"),
        (lambda t: t.withColumn("window_id", F.when(F.col("cell") != "all", F.col("window_id"))), "REJECT_SCHEMA: 1 rows"),
        (lambda t: t.withColumn("contract_version", F.when(F.col("cell") == "all", "v0").otherwise("v1")), "REJECT_CONTRACT"),
        (lambda t: t.withColumn("contract_id", F.when(F.col("cell") != "all", F.col("contract_id"))), "REJECT_CONTRACT"),
    ],
)
def test_a_faulty_table_fails_the_job(table, active, change, code):
    with pytest.raises(ValueError, match=code):
        staging.validate_staging(change(table), active, DIMS, ("user_id",))
