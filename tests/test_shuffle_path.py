"""Mixing over runs with a hold table, and the shuffle path on odd messages."""

import collections

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import gates
from veilgrain.operators import shuffle_dp as sh
from veilgrain.operators import shuffle_path as path

SIZES = [30, 30, 50, 5, 0, 4, 130]


def run_all(spark, mixer, sizes=SIZES, runs=None):
    messages = spark.createDataFrame(
        [(f"{r}-{i}", r, f"c{i % 3}") for r, n in enumerate(sizes) for i in range(n)], "event_id string, run_no int, cell string"
    )
    for r in runs if runs is not None else range(len(sizes)):
        mixer.run(messages.filter(F.col("run_no") == r), r, ["event_id"])
    fields = messages.select("run_no", "cell").schema
    return mixer.mixed(spark, fields), mixer.held(spark, fields)


def test_short_runs_wait_and_nothing_is_lost(spark, tmp_path):
    mixer = sh.Mixer(str(tmp_path), 50, 50, "s", ("run_no", "cell"))
    mixed, held = run_all(spark, mixer)
    out = mixed.collect()
    assert "event_id" not in mixed.columns + held.columns
    last = held.filter(F.col("run") == len(SIZES) - 1).collect()
    seen = collections.Counter((r["run_no"], r["cell"]) for r in out + last)
    assert seen == collections.Counter((r, f"c{i % 3}") for r, n in enumerate(SIZES) for i in range(n))
    went = {r["run_no"]: r["run"] for r in out}
    assert went == {0: 1, 1: 1, 2: 2, 3: 6, 5: 6, 6: 6} and not last
    batches = collections.Counter((r["run"], r["batch_id"]) for r in out)
    assert min(batches.values()) >= 50 and batches[(1, 0)] == 60
    # a later batch mixes messages of several runs
    assert len({r["run_no"] for r in out if r["run"] == 6 and r["batch_id"] == 0}) > 1


def test_repeating_a_run_changes_nothing(spark, tmp_path):
    mixer = sh.Mixer(str(tmp_path), 50, 50, "s", ("run_no", "cell"))

    def rows(tables):
        return [sorted(map(str, t.collect())) for t in tables]

    first = rows(run_all(spark, mixer, runs=range(4)))
    assert rows(run_all(spark, mixer, runs=[3, 1, 2])) == first


def test_time_trigger(spark, tmp_path):
    mixer = sh.Mixer(str(tmp_path), 50, 50, "s", ("run_no", "cell"), max_wait=2, timed_batch=10)
    mixed, held = run_all(spark, mixer, [12, 0, 0, 3, 0, 0])
    assert {(r["run_no"], r["run"]) for r in mixed.collect()} == {(0, 2)}
    assert held.filter("run = 5").count() == 3  # fewer than ten messages go on waiting


@pytest.fixture(scope="module")
def allowed(spark):
    return gates.allowed_contracts(spark.createDataFrame([("f", "SHUFFLE", "v1")], "feature_id string, boundary string, contract_version string"), 1)


def test_every_bad_message_has_its_first_reason(spark, allowed):
    c = path.ShuffleConfig("c", "v1", "f", "s")
    good = ("m", "c", "v1", "f", "2024-01-01", "EU", "x", "UNKNOWN", "SHUFFLE_COUNT", True, 2.0, "bounded_increment", [1], 1.0)
    names = ["event_id", *path.PAYLOAD]
    changes = [
        ({}, None), ({"feature_id": "g"}, "REJECT_CONTRACT:NO_ACTIVE_CONTRACT"), ({"contract_version": "v0"}, "REJECT_CONTRACT:VERSION"),
        ({"window_id": "week 1"}, "REJECT_CONTRACT:WINDOW_ID"), ({"window_id": None}, "REJECT_CONTRACT:WINDOW_ID"),
        ({"geo_bucket": None}, "REJECT_SCHEMA:MISSING_geo_bucket"), ({"data": [2]}, "REJECT_PAYLOAD_INCREMENT"),
        ({"data": None}, "REJECT_PAYLOAD_FORMAT"), ({"format": "raw", "data": [9]}, "REJECT_PAYLOAD_FORMAT"),
        ({"feature_id": "g", "data": [7]}, "REJECT_CONTRACT:NO_ACTIVE_CONTRACT"),
    ]
    rows = [tuple({**dict(zip(names, good)), "event_id": str(i), **change}[n] for n in names) for i, (change, _) in enumerate(changes)]
    schema = "event_id string, contract_id string, contract_version string, feature_id string, window_id string, geo_bucket string, cluster_id string, age_bucket string, protocol_type string, local_randomization_enabled boolean, epsilon_local double, format string, data array<int>, sample_rate double"
    got = {int(r["event_id"]): r["reject_reason"] for r in path.validate(spark.createDataFrame(rows, schema), allowed, c).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(changes)}


def test_estimates_cover_the_truth(spark, allowed, tmp_path):
    # 40 % of 20,000 messages carry a one; half of them are sampled
    c = path.ShuffleConfig("c", "v1", "f", "s", sample_rate=0.5, max_per_window=100, max_per_cell=100)
    events = spark.range(20_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 5000).alias("contributor"), F.col("id").alias("ts"), F.lit("2024-01-01").alias("window_id"),
        F.lit("EU").alias("region"), F.lit("EU").alias("geo_bucket"), F.lit("x").alias("cluster_id"), F.lit(None).cast("string").alias("age_bucket"),
    )
    policies = spark.createDataFrame([("f", "EU", True, False)], "feature_id string, region string, enabled boolean, deprecated boolean")
    consent = spark.range(4000).select(F.col("id").alias("contributor"))
    messages, rejects = path.client(events, policies, consent, c, F.col("event_id") % 5 < 2)
    assert {(r["reject_reason"], r["count"]) for r in rejects.groupBy("reject_reason").count().collect()} == {("POLICY_NO_CONSENT", 4000)}
    mixer = sh.Mixer(str(tmp_path), 500, 500, "s", path.PAYLOAD)
    mixed, held, bad = path.shuffler(messages, allowed, mixer, c, ["2024-01-01"])
    assert held.count() == 0 and bad.count() == 0 and mixed.count() == messages.count()
    row = path.server(mixed, allowed, c, 7).first()
    sampling = (16_000 * 0.4 * 0.5 / 0.5) ** 0.5  # the interval covers the randomized bits; sampling comes on top
    assert abs(row["estimate_value"] - 16_000 * 0.4) < 4 * (row["variance"] ** 0.5 + sampling)
    assert row["age_bucket"] == "UNKNOWN" and row["release_ts_ms"] == 7 and row["ci_lower"] < row["estimate_value"] < row["ci_upper"]


def test_nothing_mixed_yet(spark, tmp_path):
    mixer = sh.Mixer(str(tmp_path), 50, 50, "s", ("run_no", "cell"))
    mixed, held = run_all(spark, mixer, [3, 4])
    assert mixed.count() == 0 and held.filter("run = 1").count() == 7
