"""Partners that really are absent: every row comes back with a stated result."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import gates, governance, history, joins, sketches
from veilgrain.operators import transforms as tr

DAY = dt.datetime(2024, 1, 1)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_contract_gates(spark):
    known = "feature_id string, contract_version string, boundary string"
    contracts = spark.createDataFrame([("a", "v1", "CENTRAL"), ("a", "v2", "CENTRAL"), ("b", "v1", "SHUFFLE")], known)
    asked = spark.createDataFrame([(1, "a", "v2"), (2, "a", "v0"), (3, "b", "v1"), (4, "c", "v1"), (5, None, "v1")], "id int, feature_id string, contract_version string")
    got = dict(rows(gates.contract_gate(asked, gates.allowed_contracts(contracts, 2), "CENTRAL"), "id", "reject_reason"))
    assert got == {1: None, 2: "REJECT_CONTRACT:VERSION", 3: "REJECT_CONTRACT:BOUNDARY", 4: "REJECT_CONTRACT:NO_ACTIVE_CONTRACT", 5: "REJECT_CONTRACT:NO_ACTIVE_CONTRACT"}
    requests = asked.withColumn("boundary", F.lit("CENTRAL")).drop("contract_version")
    active = contracts.groupBy("feature_id").agg(F.max_by("boundary", "contract_version").alias("boundary"))
    got = dict(rows(gates.boundary_mismatch_gate(requests, active), "id", "reject_reason"))
    assert got == {1: None, 2: None, 3: "BOUNDARY_MISMATCH", 4: "NO_CONTRACT", 5: "NO_CONTRACT"}


def test_policy_and_consent(spark):
    ev = spark.createDataFrame([(1, "a", "EU", 7), (2, "a", "US", 7), (3, "b", "EU", 7), (4, "a", "EU", 8), (5, "a", None, None)], "id int, feature_id string, region string, contributor int")
    policies = spark.createDataFrame([("a", "EU", True, False), ("b", "EU", True, True)], "feature_id string, region string, enabled boolean, deprecated boolean")
    consent = spark.createDataFrame([(7,)], "contributor int")
    got = dict(rows(gates.policy_gate(ev, policies, consent), "id", "reject_reason"))
    assert got == {1: None, 2: "POLICY_DISABLED", 3: "POLICY_DEPRECATED", 4: "POLICY_NO_CONSENT", 5: "POLICY_DISABLED"}


def test_mappings_and_joins(spark):
    lines = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "id int, part int")
    mapping = spark.createDataFrame([(10, "x")], "part int, cluster_id string")
    assert rows(tr.map_dimension(lines, mapping, "part", "cluster_id"), "id", "cluster_id") == [(1, "x"), (2, "UNKNOWN"), (3, "UNKNOWN")]
    requests = spark.createDataFrame([(1, "a", "k", "CENTRAL", "CENTRAL"), (2, "z", "k", "CENTRAL", "CENTRAL")], "id int, feature_id string, join_key string, left_boundary string, right_boundary string")
    limits = spark.createDataFrame([("a", False, [], "CENTRAL")], "feature_id string, forbid_joins_all boolean, forbid_joins_on array<string>, boundary string")
    assert rows(joins.join_gate(requests, limits), "id", "verdict") == [(1, "ALLOWED"), (2, "NO_CONTRACT")]
    features = spark.createDataFrame([("a",), ("b",)], "feature_id string")
    assert rows(governance.lineage_block(features, features.filter("feature_id = 'a'")), "feature_id", "blocked") == [("a", False), ("b", True)]
    newest = history.latest(spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "feature_id string, computed_at int, n int"), ["feature_id"], "computed_at")
    assert dict(rows(features.join(newest, "feature_id", "left"), "feature_id", "n")) == {"a": 6, "b": None}


def test_contract_in_force_like_a_scan_of_all_versions(spark):
    rng = random.Random(2)
    issued = [(f"f{i % 5}", f"v{i:03d}", DAY + dt.timedelta(hours=rng.randrange(2000))) for i in range(300) if i % 5]
    issued += [("f1", "v900", issued[0][2]), ("f1", "v901", issued[0][2])]  # issued at one moment
    events = [(i, f"f{rng.randrange(6)}", DAY + dt.timedelta(hours=rng.randrange(-100, 2200))) for i in range(500)] + [(999, "f1", None)]
    con = spark.createDataFrame(issued, "feature_id string, contract_version string, issued_at timestamp")
    ev = spark.createDataFrame(events, "event_id int, feature_id string, ts timestamp")
    got = {r["event_id"]: (r["contract_version"], r["reject_reason"]) for r in joins.asof_contract_gate(ev, con).collect()}
    for i, feature, ts in events:
        valid = [(at, v) for f, v, at in issued if f == feature and ts is not None and at <= ts]
        assert got[i] == ((max(valid)[1], None) if valid else (None, "NO_CONTRACT"))
    assert len(got) == len(events)


@pytest.mark.parametrize("shared", [False, True])
def test_degree_like_brute_force(spark, shared):
    # up to 40 keys a dataset; with one key that every dataset but those without keys holds
    rng = random.Random(8)
    sets = [(i, [f"k{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 5, 40]))] + [None]) for i in range(120)]
    sets = [(i, k + ["all"] if shared and len(k) > 1 else k) for i, k in sets]
    sets += [(500 + i, sets[5][1]) for i in range(30)] + [(900, None), (901, [])]
    df = spark.createDataFrame(sets, "id int, keys array<string>")
    got = {r["id"]: r["degree"] for r in joins.join_degree(df, "id", "keys").collect()}
    held = {i: {k for k in keys or [] if k is not None} for i, keys in sets}
    assert got == {i: sum(1 for j in held if j != i and held[i] & held[j]) for i in held}


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([], "g string, item string, id long")
    cm, mg = sketches.CountMin(), sketches.FrequentItems()
    assert cm.summary(none, ["g"], F.col("item")).count() == 0
    assert mg.items(mg.summary(none, ["g"], F.col("item")), ["g"], 5).count() == 0
    assert sketches.bottom_k(none, ["g"], F.col("id"), 3).count() == 0
