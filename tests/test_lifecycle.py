"""Contract-driven release on hand-made contracts."""

from pyspark.sql import functions as F

from veilgrain.operators import lifecycle as lc
from veilgrain.schema import ReleaseContract

POLICY = ReleaseContract(secret="test", k_min=2, metrics=("COUNT",))


def bundles(spark):
    rows = [("a", "ITEM", "CENTRAL", ["CLUSTER", "AGGREGATE"]), ("b", "ITEM", "CENTRAL", []), ("c", "ITEM", "LOCAL", [])]
    kind = "feature_id string, preferred string, boundary string, coarser array<string>"
    return spark.createDataFrame(rows, kind).select(
        "feature_id", F.concat(F.lit("v_"), "feature_id").alias("contract_version"),
        F.struct("boundary", F.lit(1.0).alias("epsilon"), F.lit(1e-6).alias("delta")).alias("dp_config"),
        F.struct(
            F.lit(2).alias("k_min"), "preferred", F.transform("coarser", lambda g: F.struct(g.alias("granularity"))).alias("ladder")
        ).alias("granularity_plan"),
    )


def test_outcomes_rejects_and_budget(spark):
    def rows(feature, window, *pairs):
        return [(feature, window, person, item, item[0]) for person, item in pairs]

    wide, thin = [(1, "x1"), (2, "x1")], [(1, "x1"), (2, "x2")]
    data = rows("a", "w1", *wide) + rows("a", "w2", *thin) + rows("a", "w3", *wide) + rows("b", "w1", *thin)
    data += rows("c", "w1", *wide) + rows("d", "w1", *wide)
    kind = "feature_id string, window_id string, contributor long, item string, cluster string"
    events = spark.createDataFrame(data, kind)
    ledger = spark.createDataFrame([("a", 0.5, 0.0)], "feature_id string, epsilon_spend double, delta_spend double")
    contracts = bundles(spark)
    checked = lc.checked_items(events, F.col("item"), F.col("cluster"), contracts, "CENTRAL")
    staged = lc.staging(checked, POLICY)
    decided = lc.outcomes(staged, contracts, ledger, 2.5, 1.0)
    found = {tuple(x) for x in lc.audit(checked, decided).select("event_type", "feature_id", "window_id", "reason").collect()}
    assert found == {
        ("MATERIALIZE", "a", "w1", None),
        ("DOWNGRADE", "a", "w2", "MIN_SUPPORT_FAIL"),
        ("BLOCK", "a", "w3", "BUDGET_EXHAUSTED"),
        ("BLOCK", "b", "w1", "MIN_SUPPORT_FAIL"),
        ("REJECT", "c", "w1", "BOUNDARY_MISMATCH"),
        ("REJECT", "d", "w1", "NO_CONTRACT"),
    }
    out = lc.released(staged, decided, POLICY).collect()
    assert {(x["feature_id"], x["window_id"], x["level"], x["cell"]) for x in out} == {
        ("a", "w1", "ITEM", "x1"), ("a", "w2", "CLUSTER", "x"),
    }
    assert "contributor" not in staged.columns
    spent = lc.spends(decided, F.lit("2024-01-01").cast("date"), "CENTRAL").select("granularity", "epsilon_spend").collect()
    assert {tuple(x) for x in spent} == {("ITEM", 1.0), ("CLUSTER", 1.0)}
