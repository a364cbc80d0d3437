"""Replay fingerprints, policy hash, traceability and identifier scans on planted faults."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import gates, governance, replay
from veilgrain.plans import contracts
from veilgrain.schema import Thresholds
from veilgrain.sources import sinks


def runs(spark, folder, second):
    first = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") > 9, "x").alias("n"))
    first = first.unionByName(first.filter("k < 3"))  # repeated rows count
    replay.record_run(first, folder, "a", ["k"], "p", parts=32)
    replay.record_run(second(first), folder, "b", ["k"], "p", parts=32)
    parts = replay.compare_runs(spark, folder, "a", "b").collect()
    odd = replay.differing_rows(spark, folder, "a", "b", ["k"], first).collect()
    return parts, {r["k"]: r["verdict"] for r in odd}


def test_order_and_tasks_do_not_matter(spark, tmp_path):
    parts, odd = runs(spark, str(tmp_path), lambda df: df.repartition(7).orderBy(F.rand(1)))
    assert len(parts) == 32 and all(r["same"] and r["same_plan"] for r in parts) and odd == {}
    assert sum(r["n_first"] for r in parts) == 503


@pytest.mark.parametrize(
    "change,found",
    [
        (lambda df: df.withColumn("v", F.when(F.col("k") == 123, 99).otherwise(F.col("v"))), {123: "MISMATCH"}),
        (lambda df: df.filter("k <> 77"), {77: "ONLY_FIRST"}),
        (lambda df: df.unionByName(df.filter("k = 5").withColumn("k", F.lit(1000).cast("long"))), {1000: "ONLY_SECOND"}),
        (lambda df: df.unionByName(df.filter("k = 8")), {8: "MISMATCH"}),  # one row more of the same
        (lambda df: df.withColumn("n", F.when(F.col("k") == 4, "null").otherwise(F.col("n"))), {4: "MISMATCH"}),
        # two changes that cancel in a plain sum of values
        (lambda df: df.withColumn("v", F.when(F.col("k") == 10, F.col("v") + 1).when(F.col("k") == 11, F.col("v") - 1).otherwise(F.col("v"))), {10: "MISMATCH", 11: "MISMATCH"}),
    ],
)
def test_a_planted_change_is_found(spark, tmp_path, change, found):
    parts, odd = runs(spark, str(tmp_path), change)
    assert odd == found and 1 <= sum(not r["same"] for r in parts) <= len(found)


def test_policy_hash_covers_every_threshold():
    th = Thresholds()
    hashes = {contracts.policy_hash(th)}
    for f in dataclasses.fields(th):
        value = getattr(th, f.name)
        other = {**value, next(iter(value)): 0.123} if isinstance(value, dict) else value + 1
        hashes.add(contracts.policy_hash(dataclasses.replace(th, **{f.name: other})))
    assert len(hashes) == 1 + len(dataclasses.fields(th))


def test_contract_of_the_feature_and_version(spark):
    kinds = "feature_id string, contract_version string, boundary string, mechanism string, granularity string"
    known = [("a", "v1", "CENTRAL", "G", "ITEM"), ("a", "v1", "CENTRAL", "G", "ITEM"), ("b", "v1", "SHUFFLE", None, "ITEM"),
             ("c", "v1", "CENTRAL", "G", "ITEM"), ("c", "v1", "CENTRAL", "G", "CLUSTER")]
    releases = spark.createDataFrame([(f, "v1") for f in "abcd"] + [("a", "v2")], "feature_id string, contract_version string")
    got = {(r["feature_id"], r["contract_version"]): r["missing"] for r in governance.untraceable(releases, spark.createDataFrame(known, kinds)).collect()}
    every = ["boundary", "mechanism", "granularity"]
    assert got == {("a", "v1"): [], ("b", "v1"): ["mechanism"], ("c", "v1"): ["contract"], ("d", "v1"): every, ("a", "v2"): every}


def test_identifiers_inside_text_are_found(spark):
    rows = [
        (1, '{"seen":{"actor":"Ann.Lee@example.org"},"n":3}', None), (2, "sent by u-77.", "x"), (3, "u-770 and xu-77", "u-77"),
        (4, "", None), (5, None, "nothing here"), (6, "u-77 u-77 u-77", "u-77"),
    ]
    df = spark.createDataFrame(rows, "id int, details_json string, note string")
    known = spark.createDataFrame([("Ann.Lee@example.org",), ("u-77",), (None,)], "who string")
    hits = gates.identifier_hits(df, ["id"], ["details_json", "note"], gates.identifier_hashes(known, "who", "s"), "s")
    assert {(r["id"], r["column"]) for r in hits.collect()} == {
        (1, "details_json"), (2, "details_json"), (3, "note"), (6, "details_json"), (6, "note"),
    }
    other = gates.identifier_hits(df, ["id"], ["note"], gates.identifier_hashes(known, "who", "t"), "s")
    assert other.count() == 0  # hashes under another salt tell nothing


def test_every_writer_refuses_identifiers(spark, tmp_path):
    df = spark.createDataFrame([(1, "u")], "n int, user_id string")
    for write in (sinks.write_partitioned, sinks.append_partitioned):
        with pytest.raises(ValueError):
            write(df, str(tmp_path / "t"), ["n"])
    with pytest.raises(ValueError):
        sinks.write_json_lines(df, "reports", str(tmp_path / "j"))
