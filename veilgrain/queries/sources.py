"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import gates, history, staging
from veilgrain.operators import ledger as lg
from veilgrain.plans import risk
from veilgrain.queries import central as qc
from veilgrain.queries import common as cm
from veilgrain.queries.aggregates import STAGED, staged_events
from veilgrain.queries.catalog import supported_catalog
from veilgrain.queries.history import HIST, scorecards
from veilgrain.queries.ledger import LEDGER, ledger
from veilgrain.queries.registry import R, query, r
from veilgrain.queries.scoring import BASE, TH
from veilgrain.schema import GRANULARITIES, TAG_WEIGHTS
from veilgrain.session import ensure_checkpoint_dir, run_folder
from veilgrain.sources import catalog as cat
from veilgrain.sources import sinks, tables


@query("scan_events", f"WITH {cm.EV} SELECT event_id, contributor, ts, event_type, k, value FROM ev")
def scan_events(spark, sf):
    return tables.events(spark, sf)


@query(
    "scan_features",
    """SELECT 'f_' || p_partkey AS feature_id, CASE WHEN p_size > 25 THEN 'int' ELSE 'string' END AS dtype, CASE WHEN p_size > 30 THEN p_size ELSE 0 END AS ttl_days,
  CASE WHEN p_type = 'PROMO' THEN 0.25 ELSE 1.0 END::DOUBLE AS stability, 0::BIGINT AS ndv_hint, 'user' AS privacy_unit, CASE WHEN p_type = 'SMALL' THEN 'health' ELSE '' END AS tags FROM part""",
)
def scan_features(spark, sf):
    """Spec files with members left out, written as JSON lines and read back with their defaults."""
    part = tables.table(spark, sf, "part")
    specs = part.select(
        F.concat(F.lit("f_"), "p_partkey").alias("feature_id"),
        F.array(F.struct(F.lit("x").alias("name"), F.when(F.col("p_size") > 25, "int").alias("dtype"))).alias("fields"),
        F.array(
            F.struct(F.lit("uid").alias("name"), F.when(F.col("p_type") == "PROMO", 0.25).alias("stability"))
        ).alias("join_keys"),
        F.when(F.col("p_size") > 30, F.col("p_size")).alias("ttl_days"),
        F.when(F.col("p_type") == "SMALL", F.array(F.lit("health"))).alias("policy_tags"),
    )
    path = sinks.write_json_lines(specs, "features")
    read = cat.read_features(spark, path, multi_line=False)
    return read.select(
        "feature_id", F.col("fields")[0]["dtype"].alias("dtype"), "ttl_days",
        F.col("join_keys")[0]["stability"].alias("stability"), F.col("join_keys")[0]["ndv_hint"].alias("ndv_hint"),
        "privacy_unit", F.array_join("policy_tags", ",").alias("tags"),
    )


@query(
    "scan_policy",
    """SELECT 'p_' || s_suppkey AS policy_version, CASE WHEN s_nationkey > 10 THEN s_nationkey ELSE 1 END AS k_min, 0.9::DOUBLE AS tau_local,
  CASE WHEN s_nationkey < 5 THEN s_nationkey / 10.0 ELSE 0.55 END::DOUBLE AS tau_central, 0.45::DOUBLE AS tau_item,
  CASE WHEN s_acctbal < 0 THEN 0.5 ELSE 0.6 END::DOUBLE AS tau_cluster FROM supplier""",
)
def scan_policy(spark, sf):
    """One policy file row per supplier, most members left to the defaults."""
    s = tables.table(spark, sf, "supplier")
    nation = F.col("s_nationkey")
    thresholds = F.struct(
        F.when(nation > 10, nation).alias("k_min"),
        F.when(nation < 5, F.create_map(F.lit("CENTRAL"), nation / 10.0)).alias("tau_boundary"),
        F.when(F.col("s_acctbal") < 0, F.create_map(F.lit("CLUSTER"), F.lit(0.5))).alias("tau_granularity"),
    )
    policies = s.select(F.concat(F.lit("p_"), "s_suppkey").alias("policy_version"), thresholds.alias("thresholds"))
    path = sinks.write_json_lines(policies, "policies")
    read = cat.read_policy(spark, path, multi_line=False)
    return read.select(
        "policy_version", "k_min", F.col("tau_boundary")["LOCAL"].alias("tau_local"),
        F.col("tau_boundary")["CENTRAL"].alias("tau_central"), F.col("tau_granularity")["ITEM"].alias("tau_item"),
        F.col("tau_granularity")["CLUSTER"].alias("tau_cluster"),
    )


@query(
    "list_and_lookup",
    f"""WITH {HIST} SELECT p_brand || '@' || p_size AS feature_id, count(*) AS n, max(n_obs) AS n_obs FROM part LEFT JOIN (SELECT feature_id, max_by(n_obs, computed_at) AS n_obs FROM hist GROUP BY 1) s
  ON s.feature_id = p_brand GROUP BY 1""",
)
def list_and_lookup(spark, sf):
    """All feature ids with their newest statistics by key; absent statistics stay null."""
    newest = history.latest(scorecards(spark, sf), ["feature_id"], "computed_at")
    ids = tables.table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    found = ids.join(newest.select(F.col("feature_id").alias("p_brand"), "n_obs"), "p_brand", "left")
    return found.select(F.concat_ws("@", "p_brand", F.col("p_size").cast("string")).alias("feature_id"), "n", "n_obs")


# ---- staging ----------------------------------------------------------------------------------------------------
def _staging_table(spark, sf):
    """(path, table) of the staged cells, partitioned by window."""
    staged = staged_events(spark, sf).select(
        F.lit("c_events").alias("contract_id"), F.lit("v1").alias("contract_version"),
        F.lit("events_weekly").alias("feature_id"), "window_id", "level", "lvl", "cell", "event_count", "value_sum",
        "value_sumsq", "contributors_count", F.lit(STAGING_TS).cast("bigint").alias("staging_ts_ms"),
    )
    staged = staging.with_dimensions(staged, DIMS)
    path = sinks.write_partitioned(staged, run_folder(spark, "staging"), ["window_id"])
    return path, sinks.read_partitioned(staged, path)


DIMS, STAGING_TS = ("event_bucket", "k_bucket"), 1706745000000
DIM_SQL = "CASE WHEN cell = 'all' THEN 'UNKNOWN' ELSE split_part(cell, '|', 1) END AS event_bucket, CASE WHEN cell = 'all' THEN 'UNKNOWN' ELSE split_part(cell, '|', 2) END AS k_bucket"


@query(
    "sink_staging",
    f"WITH {STAGED} SELECT window_id, level, {DIM_SQL}, event_count, {R('value_sum', 2)} AS value_sum, contributors_count, {STAGING_TS} AS staging_ts_ms FROM staged",
)
def sink_staging(spark, sf):
    """Written twice, as a retried job would; the partitions are replaced, not duplicated. The table passes the release's checks."""
    path, table = _staging_table(spark, sf)
    ensure_checkpoint_dir(spark)
    last_week = table.filter("window_id = '2024-01-29'").checkpoint()
    sinks.write_partitioned(last_week, path, ["window_id"])
    active = spark.createDataFrame([("c_events", "v1")], "contract_id string, contract_version string")
    checked = staging.validate_staging(sinks.read_partitioned(table, path), active, DIMS, sinks.FORBIDDEN)
    return checked.select(
        "window_id", "level", *DIMS, "event_count", r(F.col("value_sum"), 2).alias("value_sum"), "contributors_count", "staging_ts_ms"
    )


@query(
    "read_staged",
    f"""WITH {STAGED} SELECT cell, event_count, {R('value_sum', 2)} AS value_sum FROM staged WHERE window_id = '2024-01-15' AND level = 'CLUSTER'""",
)
def read_staged(spark, sf):
    """Staged rows of one feature, level and window; only that window's partition is read."""
    _, staged = _staging_table(spark, sf)
    rows = staged.filter("feature_id = 'events_weekly' AND level = 'CLUSTER' AND window_id = '2024-01-15'")
    return rows.select("cell", "event_count", r(F.col("value_sum"), 2).alias("value_sum"))


@query("sink_release", f"WITH {qc.BOUNDED}, rel AS ({qc.RELEASE}) SELECT * EXCLUDE (cell), {DIM_SQL} FROM rel")
def sink_release(spark, sf):
    """The released table with its bucketed dimensions as columns, written by window and read back."""
    released = staging.with_dimensions(qc.released(spark, sf), DIMS)
    path = sinks.write_partitioned(released, run_folder(spark, "release"), ["window_id"])
    back = sinks.read_partitioned(released, path)
    return qc.published(back, DIMS).drop("cell")


@query(
    "select_from_release",
    f"""WITH {qc.BOUNDED} SELECT level, cell, {R(qc.G_COUNT)} AS dp_event_count FROM chosen WHERE window_id = '2024-01-08' AND {qc.G_COUNT} >= 20""",
)
def select_from_release(spark, sf):
    """Projection over the released table with named parameters."""
    released = qc.released(spark, sf)
    rows = spark.sql(
        "SELECT level, cell, dp_event_count FROM {released} WHERE window_id = :window AND dp_event_count >= :least",
        args={"window": "2024-01-08", "least": 20.0},
        released=released,
    )
    return rows.withColumn("dp_event_count", r(F.col("dp_event_count")))


# ---- upserts and appends ----------------------------------------------------------------------------------------
@query(
    "upsert_features",
    """SELECT 'f_' || p_partkey AS feature_id, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS version, CASE WHEN p_size > 25 THEN p_size * 10 ELSE p_size END AS retention_days FROM part""",
)
def upsert_features(spark, sf):
    part = tables.table(spark, sf, "part")
    fid = F.concat(F.lit("f_"), "p_partkey").alias("feature_id")
    existing = part.select(fid, F.lit(1).alias("version"), F.col("p_size").alias("retention_days"))
    updates = part.filter("p_size > 25").select(fid, F.lit(2).alias("version"), (F.col("p_size") * 10).alias("retention_days"))
    return history.upsert(existing, updates, ["feature_id"], "version")


@query(
    "upsert_stats",
    f"""WITH {HIST} SELECT feature_id, computed_at AS window_id, CASE WHEN computed_at >= '2001-01' THEN n_obs * 2 ELSE n_obs END AS n_obs FROM hist""",
)
def upsert_stats(spark, sf):
    """Recomputed statistics of 2001 replace the ones on record, by feature and window."""
    st = scorecards(spark, sf).select("feature_id", F.col("computed_at").alias("window_id"), "n_obs", F.lit(1).alias("run"))
    fresh = st.filter("window_id >= '2001-01'").withColumn("n_obs", F.col("n_obs") * 2).withColumn("run", F.lit(2))
    return history.upsert(st, fresh, ["feature_id", "window_id"], "run").drop("run")


@query(
    "upsert_probe",
    """SELECT p_brand AS feature_id, CASE WHEN p_brand < 'Brand#2' THEN 'run2' ELSE 'run1' END AS probe_run_id, """
    + R("CASE WHEN p_brand < 'Brand#2' THEN 0.5 + avg(l_tax) ELSE 0.5 + avg(l_discount) END")
    + " AS auc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
)
def upsert_probe(spark, sf):
    parts = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature_id"))
    means = (
        tables.table(spark, sf, "lineitem").select("l_partkey", "l_discount", "l_tax").join(parts, "l_partkey")
        .groupBy("feature_id").agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    )
    first = means.select("feature_id", F.lit("run1").alias("probe_run_id"), (0.5 + F.col("d")).alias("auc"))
    second = means.filter("feature_id < 'Brand#2'").select(
        "feature_id", F.lit("run2").alias("probe_run_id"), (0.5 + F.col("t")).alias("auc")
    )
    return history.upsert(first, second, ["feature_id"], "probe_run_id").withColumn("auc", r(F.col("auc")))


@query(
    "append_scorecards",
    f"""WITH {HIST} SELECT feature_id, computed_at AS computed_month, {R('lps_total')} AS lps_total FROM hist""",
)
def append_scorecards(spark, sf):
    """Two scoring runs appended to one history table, partitioned by month."""
    cards = scorecards(spark, sf).withColumnRenamed("computed_at", "computed_month")
    path = run_folder(spark, "scorecards")
    for half in ("computed_month < '2000-01'", "computed_month >= '2000-01'"):
        part = cards.filter(half).select("feature_id", "computed_month", "lps_total").hint("rebalance", "computed_month")
        sinks.append_partitioned(part, path, ["computed_month"])
    back = spark.read.schema("feature_id string, lps_total double, computed_month string").parquet(path)
    return back.withColumn("lps_total", r(F.col("lps_total")))


@query(
    "ledger_table",
    f"""WITH {LEDGER} SELECT feature_id, contract_version, 'CENTRAL' AS boundary, 'CLUSTER' AS granularity, 'user' AS privacy_unit, window_day, 'BASIC' AS accountant,
  {R('epsilon_spend')} AS epsilon_spend, {R('delta_spend', 9)} AS delta_spend, 'COMMITTED' AS status, 0::BIGINT AS duplicate_keys FROM ledger""",
)
def ledger_table(spark, sf):
    """The ledger table, partitioned by day, with the number of primary-key violations found in it."""
    rows = ledger(spark, sf)
    path = sinks.append_partitioned(rows.hint("rebalance", "window_day"), run_folder(spark, "ledger"), ["window_day"])
    led = sinks.read_partitioned(rows, path)
    dup = lg.duplicate_keys(led).select("feature_id", "contract_version", "window_day", F.col("n").alias("_n"))
    out = led.join(dup, ["feature_id", "contract_version", "window_day"], "left")
    return out.select(
        "feature_id", "contract_version", "boundary", "granularity", "privacy_unit", "window_day", "accountant",
        r(F.col("epsilon_spend")).alias("epsilon_spend"), r(F.col("delta_spend"), 9).alias("delta_spend"), "status",
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("duplicate_keys"),
    )


TAG_JSON = """CASE p_type WHEN 'ECONOMY' THEN '[{"field":"age","value":0.2}]' WHEN 'PROMO' THEN '[{"field":"age","value":0.2},{"field":"location","value":0.2}]'
   WHEN 'SMALL' THEN '[{"field":"health","value":0.5}]' WHEN 'LARGE' THEN '[{"field":"financial","value":0.4},{"field":"children","value":0.6}]'
   WHEN 'STANDARD' THEN '[{"field":"custom","value":0.1}]' ELSE '[]' END"""


@query(
    "scorecard_table",
    f"""WITH {BASE} SELECT feature_id, 'v1' AS contract_version, granularity, {R('L')} AS L, {R('U')} AS U, {R('I')} AS I, {R('R')} AS R, {R('risk')} AS risk, {TAG_JSON} AS contributors_json FROM sc""",
)
def scorecard_table(spark, sf):
    """Scorecard rows with the policy contributors as JSON, one per feature, contract and granularity."""
    scored = risk.scorecard(supported_catalog(spark, sf), TH)
    per_g = F.array(
        *[F.struct(F.lit(g).alias("granularity"), F.col(f"U_{g}").alias("U"), F.col(f"risk_{g}").alias("risk")) for g in GRANULARITIES]
    )
    weights = F.transform(
        "policy_tags",
        lambda t: F.struct(t.alias("field"), risk.lookup(TAG_WEIGHTS, t, risk.OTHER_TAG_WEIGHT).alias("value")),
    )
    rows = scored.withColumn("_g", F.explode(per_g)).withColumn("contributors_json", F.to_json(weights))
    return rows.select(
        "feature_id", F.lit("v1").alias("contract_version"), "_g.granularity", r(F.col("L")).alias("L"),
        r(F.col("_g.U")).alias("U"), r(F.col("I")).alias("I"), r(F.col("R")).alias("R"),
        r(F.col("_g.risk")).alias("risk"), "contributors_json",
    )


@query(
    "audit_append",
    f"""WITH {cm.EV} SELECT event_type AS feature_id, 'REJECT' AS audit_event, '{{"reason":"LATE"}}' AS details_json, count(*) AS n FROM ev WHERE value > 120 GROUP BY 1
  UNION ALL SELECT event_type, 'REJECT', '{{"reason":"UNKNOWN_TYPE"}}', count(*) FROM ev WHERE event_type = 'error' AND value <= 120 GROUP BY 1""",
)
def audit_append(spark, sf):
    """Audit rows of two gates appended to one table and read back."""
    gated = gates.label(
        cm.weekly_events(spark, sf), [("LATE", F.col("value") <= 120), ("UNKNOWN_TYPE", F.col("event_type") != "error")]
    )
    audit = gates.audit_rows(gates.rejected(gated), "REJECT", "event_type", "ts").withColumn("day", F.to_date("ts"))
    path = sinks.append_partitioned(audit.hint("rebalance", "day"), run_folder(spark, "audit"), ["day"])
    back = spark.read.parquet(path)
    return back.groupBy("feature_id", F.col("event_type").alias("audit_event"), "details_json").agg(F.count("*").alias("n"))
