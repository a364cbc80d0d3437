"""Scores, decisions, selection and budget against values worked out by hand from the formulas."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilgrain.operators import joins, shuffle_dp
from veilgrain.operators import ledger as lg
from veilgrain.plans import contracts as pc
from veilgrain.plans import measured as ms
from veilgrain.plans import risk, routing
from veilgrain.schema import FEATURE_SPEC, ScorePolicy, Thresholds
from veilgrain.sources.catalog import with_spec_defaults


def spec(feature_id="f", fields=(), join_keys=(), ttl=30, buckets=None, tags=(), support=None):
    return (
        feature_id, "", [dict(name=n, dtype=t, is_sensitive=s, is_identifier=i, cardinality_hint=c) for n, t, s, i, c in fields],
        [dict(name=n, stability=s, ndv_hint=v) for n, s, v in join_keys], ttl, buckets or {}, "user", list(tags), support or {},
    )


def frame(spark, *specs):
    return with_spec_defaults(spark.createDataFrame(list(specs), FEATURE_SPEC))


AGE = ("age", "int", True, False, None)
ZIP = ("zip", "string", True, False, None)
SUPPORT = {"ITEM": 50, "CLUSTER": 10_000, "AGGREGATE": 10_000_000}


def test_sensitive_feature_with_stable_key(spark):
    f = spec(fields=[AGE, ZIP], join_keys=[("uid", 0.9, None)], buckets={"age": 80, "zip": 500}, tags=["age", "location"], support=SUPPORT)
    row = risk.scorecard(frame(spark, f), Thresholds()).first()
    assert row.L == pytest.approx(0.576)
    assert row.I == pytest.approx(0.5905)
    assert row.R == pytest.approx(0.4)
    assert row.risk_ITEM == pytest.approx(0.710425)
    assert row.risk_CLUSTER == pytest.approx(0.363925)
    d = risk.decide(frame(spark, f), Thresholds()).first()
    assert (d.boundary, d.granularity, d.feasible) == ("CENTRAL", "CLUSTER", True)


def test_cold_start_feature(spark):
    f = spec(fields=[AGE], buckets={"age": 80}, tags=["age"])
    rows = risk.rank_edits(risk.counterfactuals(frame(spark, f), Thresholds(), "ITEM"), top=5).orderBy("rank").collect()
    assert [r.edit for r in rows] == ["drop_field:age", "bucketize:age:80->40"]
    assert rows[0].risk == pytest.approx(0.0325)
    assert rows[1].risk == pytest.approx(0.160375)


def test_scores_are_monotone(spark):
    plain = spec("plain", fields=[("x", "int", False, False, None)])
    joined = spec("joined", fields=[("x", "int", False, False, None)], join_keys=[("uid", 0.95, 1_000_000)])
    rows = {r.feature_id: r for r in risk.scorecard(frame(spark, plain, joined), Thresholds()).collect()}
    assert rows["joined"].L > rows["plain"].L
    assert rows["joined"].risk_ITEM >= rows["plain"].risk_ITEM
    hinted = spec(fields=[("x", "int", False, False, None)], support=SUPPORT)
    r = risk.scorecard(frame(spark, hinted), Thresholds()).first()
    assert r.U_ITEM > r.U_CLUSTER > r.U_AGGREGATE


def test_infeasible_falls_back_to_the_safest_option(spark):
    fields = [(f"s{i}", "int", True, True, None) for i in range(5)]
    f = spec(fields=fields, join_keys=[("uid", 1.0, 10**9)], ttl=365, tags=["health", "children"])
    strict = Thresholds(tau_granularity={"ITEM": 0.1, "CLUSTER": 0.1, "AGGREGATE": 0.1})
    d = risk.planner_constraints(risk.decide(frame(spark, f), strict), strict).first()
    assert (d.boundary, d.granularity, d.feasible) == ("LOCAL", "AGGREGATE", False)
    assert d.U == pytest.approx(1.0)
    assert d.forbid_joins_all and d.min_group_cardinality == 100


def defs(spark, **over):
    base = dict(
        feature_id="click_rate", join_keys=["campaign_id"], degree=1, retention_days=30, sensitivity_tags=[], query_type="MEAN_BOUNDED_0_1",
        boundary_capabilities=["LOCAL", "SHUFFLE", "CENTRAL"], granularity_candidates=["ITEM", "CLUSTER", "AGGREGATE"],
    )
    base.update(over)
    schema = (
        "feature_id string, join_keys array<string>, degree int, retention_days int, sensitivity_tags array<string>, query_type string, "
        "boundary_capabilities array<string>, granularity_candidates array<string>"
    )
    return spark.createDataFrame([tuple(base.values())], schema)


def snapshots(spark):
    rate = 0.01 * 0.99
    rows = []
    for w, sizes in (("W1", (50, 10_000, 10_000_000)), ("W0", (45, 9_500, 9_500_000))):
        for level, n, nd, m in zip(("ITEM", "CLUSTER", "AGGREGATE"), sizes, (1_000_000, 10_000, 1), (30, 8_000, 10_000_000)):
            rows.append(("click_rate", w, level, n, nd, m, 0.1, float(n), rate / n))
    return spark.createDataFrame(
        rows,
        "feature_id string, window_id string, level string, n_obs bigint, n_distinct_est bigint, min_support_est bigint, "
        "tail_mass_est double, n_eff double, approx_variance double",
    )


def probes(spark):
    return spark.createDataFrame([("click_rate", "gender", 0.52), ("click_rate", "age_bucket", 0.55)], "feature_id string, attr string, auc double")


def test_measured_score_of_the_click_rate(spark):
    p = ScorePolicy()
    scored = ms.with_admissible_set(ms.score_features(defs(spark), snapshots(spark), probes(spark), p), p)
    row = scored.first()
    assert row.lps_total == pytest.approx(0.056846, abs=1e-6)
    assert row.min_granularity == "ITEM" and len(row.admissible_set) == 9
    sel = routing.select_min_effvar(scored, p).first()
    assert (sel.selected_boundary, sel.selected_granularity) == ("LOCAL", "AGGREGATE")


def test_missing_inputs_score_upward(spark):
    p = ScorePolicy()
    lost = defs(spark, join_keys=None, degree=None, retention_days=None, feature_id="other")
    row = ms.score_features(lost, snapshots(spark), probes(spark), p).first()
    assert (row.s_link, row.s_uniq, row.s_infer) == (1.0, 1.0, p.infer_default)
    assert row.reason_codes == [
        "MISSING_METADATA_CONSERVATIVE_LINK", "MISSING_STATS_CONSERVATIVE_UNIQ", "MISSING_PROBE_CONSERVATIVE_INFER",
    ]


def test_hard_minimum_does_not_relax_the_band(spark):
    p = ScorePolicy()
    row = defs(spark, sensitivity_tags=["demographics", "precise_location"]).withColumn("lps_total", F.lit(0.8))
    strict = ms.with_admissible_set(row, p).first()
    replaced = ms.with_admissible_set(row, p, "replace").first()
    assert strict.min_granularity == "AGGREGATE" and replaced.min_granularity == "CLUSTER"
    assert {x.boundary for x in strict.admissible_set} == {"LOCAL", "SHUFFLE"}


def test_worked_example_selects_cluster(spark):
    rows = spark.createDataFrame(
        [("f", "ITEM", 0.01, 50.0), ("f", "CLUSTER", 0.01, 1e4), ("f", "AGGREGATE", 0.01, 1e7)], "feature_id string, level string, rate double, n double"
    )
    stds = {r.level: r.s for r in rows.select("level", routing.std_total(F.col("rate"), F.col("n"), 4.0).alias("s")).collect()}
    assert stds["ITEM"] == pytest.approx(0.0812, abs=1e-4)
    assert stds["CLUSTER"] == pytest.approx(0.00107, abs=1e-5)
    assert stds["AGGREGATE"] == pytest.approx(0.0000315, abs=1e-7)
    assert routing.select_finest_under_tau(rows, 0.005, 4.0).first().selected_granularity == "CLUSTER"


def daily_spend(spark, days, eps=0.1):
    today = dt.date(2026, 1, 30)
    return spark.createDataFrame([Row(feature_id="f", window_day=today - dt.timedelta(days=i), epsilon_spend=eps, delta_spend=0.0) for i in range(days)])


def test_sliding_window_spend(spark):
    led = daily_spend(spark, 40)
    spent = {r.window_day: r.spent_epsilon for r in lg.window_spend(led, 30).collect()}
    assert spent[dt.date(2026, 1, 30)] == pytest.approx(3.0)
    asof = spark.createDataFrame([("f", dt.date(2026, 1, 30)), ("f", dt.date(2027, 1, 1)), ("g", dt.date(2026, 1, 30))], "feature_id string, asof date")
    got = {(r.feature_id, r.asof.year): r.spent_epsilon for r in joins.ledger_range_join(asof, led, 30).collect()}
    assert got[("f", 2026)] == pytest.approx(3.0)
    assert got[("f", 2027)] == 0.0 and got[("g", 2026)] == 0.0


def test_adaptive_epsilon_and_cap(spark):
    last = lg.window_spend(daily_spend(spark, 9), 30).orderBy(F.desc("window_day")).limit(1)
    row = last.select(
        "spent_epsilon",
        lg.adaptive_epsilon(F.col("spent_epsilon"), 1.0, F.lit(21)).alias("next"),
        lg.adaptive_epsilon(F.col("spent_epsilon"), 1.0, F.lit(0)).alias("none"),
        lg.can_spend(F.col("spent_epsilon"), F.col("spent_delta"), F.lit(0.1), F.lit(0.0), 1.0, 1e-6).alias("fits"),
        lg.can_spend(F.col("spent_epsilon"), F.col("spent_delta"), F.lit(0.11), F.lit(0.0), 1.0, 1e-6).alias("too_much"),
    ).first()
    assert row.spent_epsilon == pytest.approx(0.9)
    assert row.next == pytest.approx(0.1 / 21, abs=1e-9) and row.none == 0.0
    assert row.fits and not row.too_much


def test_fingerprint_ignores_column_order_and_matches_plain_json(spark):
    df = spark.createDataFrame([(1, 2, 0.1)], "a int, b int, lps double")
    one, two = df.select(pc.fingerprint_of("lps", "b", "a").alias("x"), pc.fingerprint_of("a", "lps", "b").alias("y")).first()
    plain = json.dumps({"a": 1, "b": 2, "lps": 0.1}, sort_keys=True, separators=(",", ":"))
    assert one == two == hashlib.sha256(plain.encode()).hexdigest()


def test_fingerprint_ignores_map_order(spark):
    df = spark.sql("SELECT 1 AS n, map('a', 1, 'b', 2) AS m UNION ALL SELECT 1, map('b', 2, 'a', 1) UNION ALL SELECT 1, map('b', 2)")
    got = [r.f for r in pc.with_fingerprint(df, ["m", "n"], "f").collect()]
    assert got[0] == got[1] != got[2]


def test_plan_fingerprint_leaves_out_the_time(spark):
    decided = risk.decide(frame(spark, spec(fields=[AGE])), Thresholds()).withColumn("policy_hash", F.lit("h"))
    plans = [pc.plan_records(decided, ["feature_id"], Thresholds(), F.lit(t)).first() for t in ("t1", "t2")]
    assert plans[0].created_at != plans[1].created_at
    assert plans[0].plan_fingerprint == plans[1].plan_fingerprint


def test_downgrades_are_strictly_coarser(spark):
    df = spark.createDataFrame([("ITEM", "CENTRAL"), ("CLUSTER", "LOCAL"), ("AGGREGATE", "SHUFFLE")], "g string, b string")
    got = [[(x.boundary, x.granularity) for x in r.d] for r in df.select(pc.downgrades(F.col("g"), F.col("b")).alias("d")).collect()]
    assert got == [[("CENTRAL", "CLUSTER"), ("CENTRAL", "AGGREGATE")], [("LOCAL", "AGGREGATE")], []]


def test_amplification_bound_only_where_it_holds(spark):
    df = spark.createDataFrame([(1_000_000,), (100,)], "n bigint")
    big, small = [r.e for r in df.select(shuffle_dp.amplified_epsilon(1.0, F.col("n"), 1e-6).alias("e")).collect()]
    assert 0 < big < 1.0 and small is None
    assert big == pytest.approx(
        math.log(1 + (math.e - 1) / (math.e + 1) * (8 * math.sqrt(math.e * math.log(4e6)) / 1000 + 8 * math.e / 1e6))
    )


def test_auc_scores_every_segment_of_the_table(spark, tmp_path):
    from veilgrain.queries import aggregates

    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SIXTH"]
    customers = spark.createDataFrame([(i, names[i % 6]) for i in range(30)], "c_custkey long, c_mktsegment string")
    orders = spark.createDataFrame([(i % 30, float(i * 7 % 50)) for i in range(120)], "o_custkey long, o_totalprice double")
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.attr: (r.n_pos, r.n_neg) for r in aggregates.probe_auc(spark, str(tmp_path)).collect()}
    assert got == {name: (20, 100) for name in names}
