"""Measured scores and selection rules for a catalog derived from part and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.functions.scalar import auc_to_risk
from veilgrain.operators import joins, shuffle_dp, stats
from veilgrain.operators import ledger as lg
from veilgrain.plans import contracts as pc
from veilgrain.plans import measured as ms
from veilgrain.plans import risk, routing
from veilgrain.queries import common as cm
from veilgrain.queries.aggregates import MI, weekly_supports, worst_mutual_information
from veilgrain.queries.catalog import CAT, CAT_FIELDS, catalog, supported_catalog
from veilgrain.queries.ledger import LEDGER, ledger
from veilgrain.queries.registry import R, query, r, sized
from veilgrain.queries.scoring import BASE, TH
from veilgrain.schema import ScorePolicy
from veilgrain.session import store
from veilgrain.sources import tables

POLICY = ScorePolicy(distinct_drift_threshold=12, min_support_floor=2, min_support_threshold=3, central_sigma=0.5)
ASOF = "2002-01-01"
LOOKBACK = {"W1": 365, "W0": 1460}
LEVELS_SQL = "(VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) l(level, lvl)"

DEFS = """defs AS (
  SELECT 'f_' || p_partkey AS feature_id, p_size, p_type, p_retailprice,
    CASE WHEN p_brand <> 'Brand#9' THEN list_filter(['campaign_id', CASE WHEN p_type = 'ECONOMY' THEN 'user_id' END,
      CASE WHEN p_size > 25 THEN 'zip' END, CASE WHEN p_size > 40 THEN 'store' END], lambda x: x IS NOT NULL) END AS jk,
    p_size * 8 AS retention_days,
    CASE p_type WHEN 'PROMO' THEN ['demographics'] WHEN 'SMALL' THEN ['precise_location']
      WHEN 'LARGE' THEN ['demographics', 'precise_location'] ELSE [] END AS tags,
    CASE WHEN p_type = 'STANDARD' THEN 'COUNT' ELSE 'MEAN_BOUNDED_0_1' END AS query_type FROM part)"""
SNAP = f"""rowz AS (SELECT 'f_' || l_partkey AS feature_id, w.window_id, level, lvl,
    CASE lvl WHEN 0 THEN l_suppkey::VARCHAR WHEN 1 THEN (l_suppkey // 10)::VARCHAR ELSE 'all' END AS cell,
    CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y
  FROM lineitem, (VALUES ('W1', 365), ('W0', 1460)) w(window_id, days), {LEVELS_SQL}
  WHERE date_diff('day', l_shipdate::DATE, DATE '{ASOF}') BETWEEN 0 AND days - 1),
 cel AS (SELECT feature_id, window_id, level, lvl, cell, count(*) AS cnt, sum(y) AS y FROM rowz GROUP BY ALL),
 snap AS (SELECT feature_id, window_id, level, lvl, sum(cnt)::BIGINT AS n_obs, count(*) AS nd, min(cnt) AS minsup,
    sum(cnt)::DOUBLE / count(*) AS n_eff, sum(y) / sum(cnt) AS rate FROM cel GROUP BY ALL),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, window_id
    ORDER BY CASE level WHEN 'CLUSTER' THEN 0 WHEN 'ITEM' THEN 1 ELSE 2 END) AS rn FROM snap) WHERE rn = 1)"""
PROBE = """probe AS (SELECT 'f_' || p_partkey AS feature_id, 'gender' AS attr, 0.5 + 5 * avg(l_discount) AS auc
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey
  UNION ALL SELECT 'f_' || p_partkey, 'age_bucket', 0.5 + 5 * avg(l_tax) FROM lineitem JOIN part ON l_partkey = p_partkey
    GROUP BY p_partkey)"""
SUBSCORES = f"""{DEFS}, {SNAP}, {PROBE},
 inf AS (SELECT feature_id, max(greatest(0.0, least(1.0, 2 * (auc - 0.5)))) AS s,
   string_agg(CASE WHEN round(greatest(0.0, least(1.0, 2 * (auc - 0.5))), 12) > 0.7 THEN 'HIGH_INFER:' || attr END, ',' ORDER BY attr) AS why FROM probe GROUP BY 1),
 a AS (SELECT d.*, list_contains(jk, 'user_id') AS sid, least(1.0, ln(1 + len(jk)) / ln(11)) AS nj, least(1.0, retention_days / 365.0) AS nt,
   w1.n_obs AS n1, w1.nd AS d1, w1.minsup AS m1, w0.nd AS d0, inf.s AS inf_s, inf.why AS inf_why
   FROM defs d LEFT JOIN (SELECT * FROM best WHERE window_id = 'W1') w1 USING (feature_id)
   LEFT JOIN (SELECT * FROM best WHERE window_id = 'W0') w0 USING (feature_id) LEFT JOIN inf USING (feature_id)),
 sub AS (SELECT *,
   CASE WHEN jk IS NULL THEN 1.0 ELSE least(1.0, 0.5 * sid::INT + 0.3 * nj + 0.2 * nt) END AS s_link,
   CASE WHEN n1 IS NULL THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - ln(1 + m1) / ln(1 + greatest(1, n1)))) END AS s_uniq,
   coalesce(inf_s, 0.2) AS s_infer, CASE WHEN len(tags) > 0 THEN 0.5 ELSE 0.0 END AS s_policy,
   concat_ws(',',
     CASE WHEN jk IS NULL THEN 'MISSING_METADATA_CONSERVATIVE_LINK' ELSE concat_ws(',', CASE WHEN sid THEN 'STABLE_ID_PRESENT' END,
       CASE WHEN nj > 0.7 THEN 'HIGH_JOIN_DEGREE' END, CASE WHEN nt > 0.7 THEN 'LONG_RETENTION' END) END,
     CASE WHEN n1 IS NULL THEN 'MISSING_STATS_CONSERVATIVE_UNIQ' ELSE concat_ws(',', CASE WHEN m1 < 2 THEN 'LOW_MIN_SUPPORT' END,
       CASE WHEN abs(d1 - d0) > 12 THEN 'DISTINCT_DRIFT' END) END,
     CASE WHEN inf_s IS NULL THEN 'MISSING_PROBE_CONSERVATIVE_INFER' ELSE inf_why END,
     CASE WHEN list_contains(tags, 'precise_location') THEN 'POLICY_DENY:CENTRAL_FOR_PRECISE_LOCATION' END,
     CASE WHEN list_contains(tags, 'demographics') THEN 'POLICY_MIN_GRANULARITY:CLUSTER_FOR_DEMOGRAPHICS' END,
     CASE WHEN len(tags) > 0 THEN 'POLICY_SOFT_PENALTY:SENSITIVE_TAG_PRESENT' END) AS codes FROM a),
 lps AS (SELECT *, regexp_replace(trim(codes, ','), ',+', ',', 'g') AS reason_codes,
   0.25 * s_link + 0.25 * s_uniq + 0.25 * s_infer + 0.25 * s_policy AS lps_total FROM sub)"""


def feature_defs(spark, sf):
    kind, size = F.col("p_type"), F.col("p_size")
    keys = F.array_compact(
        F.array(
            F.lit("campaign_id"),
            F.when(kind == "ECONOMY", "user_id"),
            F.when(size > 25, "zip"),
            F.when(size > 40, "store"),
        )
    )
    every = [F.lit(b) for b in ("LOCAL", "SHUFFLE", "CENTRAL")], [F.lit(g) for g in ("ITEM", "CLUSTER", "AGGREGATE")]
    return tables.table(spark, sf, "part").select(
        F.concat(F.lit("f_"), "p_partkey").alias("feature_id"),
        "p_size",
        "p_type",
        "p_retailprice",
        F.when(F.col("p_brand") != "Brand#9", keys).alias("join_keys"),
        F.when(F.col("p_brand") != "Brand#9", F.size(keys)).alias("degree"),
        (size * 8).alias("retention_days"),
        F.when(kind == "PROMO", F.array(F.lit("demographics")))
        .when(kind == "SMALL", F.array(F.lit("precise_location")))
        .when(kind == "LARGE", F.array(F.lit("demographics"), F.lit("precise_location")))
        .otherwise(F.array().cast("array<string>"))
        .alias("sensitivity_tags"),
        F.when(kind == "STANDARD", "COUNT").otherwise("MEAN_BOUNDED_0_1").alias("query_type"),
        F.array(*every[0]).alias("boundary_capabilities"),
        F.array(*every[1]).alias("granularity_candidates"),
    )


def snapshots(spark, sf):
    lines = tables.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f_"), "l_partkey").alias("feature_id"), "l_suppkey", "l_shipdate", "l_returnflag"
    )
    cells = stats.two_window_cells(
        lines,
        ["feature_id"],
        F.col("l_suppkey").cast("string"),
        F.floor(F.col("l_suppkey") / 10).cast("string"),
        F.date_diff(F.lit(ASOF).cast("date"), F.to_date("l_shipdate")),
        LOOKBACK,
        (F.col("l_returnflag") == "R").cast("double"),
    )
    return stats.feature_stats(cells, ["feature_id", "window_id", "level"], 0.05)


def probes(spark, sf):
    parts = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"))
    means = (
        tables.table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.avg("l_discount").alias("gender"), F.avg("l_tax").alias("age_bucket"))
        .join(parts, "l_partkey", "left_semi")
    )
    return means.unpivot("l_partkey", ["gender", "age_bucket"], "attr", "m").select(
        F.concat(F.lit("f_"), "l_partkey").alias("feature_id"), "attr", (0.5 + 5 * F.col("m")).alias("auc")
    )


def scored(spark, sf):
    return ms.score_features(feature_defs(spark, sf), snapshots(spark, sf), probes(spark, sf), POLICY)


# ---- sub-scores -------------------------------------------------------------------------------------------------
@query("s_link", f"WITH {SUBSCORES} SELECT feature_id, {R('s_link')} AS s_link FROM lps")
def s_link(spark, sf):
    score, _ = ms.link_score(F.col("join_keys"), F.col("degree"), F.col("retention_days"), POLICY)
    return feature_defs(spark, sf).select("feature_id", r(score).alias("s_link"))


@query(
    "s_uniq_min_support",
    f"""WITH {SNAP} SELECT feature_id, window_id, level, {R('greatest(0.0, least(1.0, 1.0 - ln(1 + minsup) / ln(1 + greatest(1, n_obs))))')} AS s_uniq FROM snap""",
)
@sized
def s_uniq_min_support(spark, sf):
    s = ms.uniq_min_support(F.col("min_support_est"), F.col("n_obs"))
    return snapshots(spark, sf).select("feature_id", "window_id", "level", r(s).alias("s_uniq"))


@query(
    "s_uniq_distinct_ratio",
    f"""WITH {SNAP} SELECT feature_id, window_id, level, {R('greatest(0.0, least(1.0, (nd / greatest(1, n_obs) - 0.1) / (0.9 - 0.1)))')} AS s_uniq FROM snap""",
)
@sized
def s_uniq_distinct_ratio(spark, sf):
    s = ms.uniq_distinct_ratio(F.col("n_distinct_est"), F.col("n_obs"), 0.1, 0.9)
    return snapshots(spark, sf).select("feature_id", "window_id", "level", r(s).alias("s_uniq"))


@query(
    "s_uniq_tail_mass",
    f"""WITH {cm.LADDER}, c AS (SELECT event_type AS feature_id, window_id, level, cell, count(*) AS cnt FROM lad GROUP BY ALL),
 t AS (SELECT *, sum(cnt) OVER (PARTITION BY feature_id, window_id, level) AS n FROM c)
SELECT feature_id, window_id, level, {R('greatest(0.0, least(1.0, (sum(CASE WHEN cnt < 0.05 * n THEN cnt ELSE 0 END) / max(n)) / 0.5))')} AS s_uniq
FROM t GROUP BY ALL""",
)
def s_uniq_tail_mass(spark, sf):
    st = stats.feature_stats(cm.feature_cells(spark, sf), ["feature_id", "window_id", "level"], 0.05)
    return st.select("feature_id", "window_id", "level", r(ms.uniq_tail_mass(F.col("tail_mass_est"), 0.5)).alias("s_uniq"))


@query("conservative_defaults", f"WITH {SUBSCORES} SELECT feature_id, {R('s_link')} AS s_link, {R('s_uniq')} AS s_uniq, {R('s_infer')} AS s_infer, reason_codes FROM lps WHERE reason_codes LIKE '%CONSERVATIVE%'")
@sized
def conservative_defaults(spark, sf):
    return scored(spark, sf).select(
        "feature_id", *[r(F.col(c)).alias(c) for c in ("s_link", "s_uniq", "s_infer")],
        F.array_join("reason_codes", ",").alias("reason_codes"),
    ).filter("reason_codes LIKE '%CONSERVATIVE%'")


@query("s_infer", f"WITH {SUBSCORES} SELECT feature_id, {R('s')} AS s_infer, coalesce(why, '') AS infer_reasons FROM inf")
def s_infer(spark, sf):
    return ms.infer_by_feature(probes(spark, sf), POLICY).select(
        "feature_id", r(F.col("s_infer")).alias("s_infer"), F.array_join("infer_reasons", ",").alias("infer_reasons")
    )


@query(
    "s_policy",
    f"WITH {SUBSCORES} SELECT feature_id, {R('s_policy')} AS s_policy, CASE WHEN list_contains(tags, 'precise_location') THEN 1.0 WHEN len(tags) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS s_policy_hard FROM lps",
)
def s_policy(spark, sf):
    defs = feature_defs(spark, sf)
    tags = F.col("sensitivity_tags")
    soft, _ = ms.policy_score(tags, POLICY)
    hard = ms.hard_policy_score(F.array_contains(tags, "precise_location"), F.size(tags) > 0, POLICY)
    return defs.select("feature_id", r(soft).alias("s_policy"), hard.cast("double").alias("s_policy_hard"))


@query(
    "policy_rules",
    f"""WITH {DEFS}, rules AS (SELECT * FROM (VALUES ('precise_location', 1.0, 'CENTRAL', 'CLUSTER', true), ('demographics', 0.5, NULL, 'AGGREGATE', false)) r(tag, penalty, db, mg, dj)),
 t AS (SELECT feature_id, unnest(tags) AS tag FROM defs), h AS (SELECT * FROM t JOIN rules USING (tag))
SELECT d.feature_id, coalesce(max(penalty), 0.0)::DOUBLE AS s_policy, coalesce(string_agg(DISTINCT db, ','), '') AS denied,
  CASE WHEN bool_or(mg = 'AGGREGATE') THEN 'AGGREGATE' WHEN bool_or(mg = 'CLUSTER') THEN 'CLUSTER' END AS min_granularity, coalesce(bool_or(dj), false) AS deny_join,
  coalesce(string_agg('POLICY_RULE:' || tag, ',' ORDER BY tag), '') AS reasons FROM defs d LEFT JOIN h ON d.feature_id = h.feature_id GROUP BY 1""",
)
def policy_rules(spark, sf):
    # declared rules, a fixed handful of rows
    rules = spark.createDataFrame(
        [("precise_location", 1.0, "CENTRAL", "CLUSTER", True), ("demographics", 0.5, None, "AGGREGATE", False)],
        "tag string, penalty double, deny_boundary string, min_granularity string, deny_join boolean",
    )
    out = ms.apply_policy_rules(feature_defs(spark, sf), F.broadcast(rules))
    return out.select(
        "feature_id", "s_policy", F.array_join("denied_boundaries", ",").alias("denied"), "min_granularity", "deny_join",
        F.array_join("policy_reasons", ",").alias("reasons"),
    )


@query(
    "lps_total",
    f"WITH {SUBSCORES} SELECT feature_id, {R('s_link')} AS s_link, {R('s_uniq')} AS s_uniq, {R('s_infer')} AS s_infer, {R('s_policy')} AS s_policy, {R('lps_total')} AS lps_total, reason_codes FROM lps",
)
@sized
def lps_total(spark, sf):
    return scored(spark, sf).select(
        "feature_id", *[r(F.col(c)).alias(c) for c in ("s_link", "s_uniq", "s_infer", "s_policy", "lps_total")],
        F.array_join("reason_codes", ",").alias("reason_codes"),
    )


@query("best_stats", f"WITH {SNAP} SELECT feature_id, window_id, level, n_obs, minsup AS min_support_est FROM best")
@sized
def best_stats(spark, sf):
    best = ms.best_stats(snapshots(spark, sf))
    return best.select("feature_id", "window_id", "snapshot.level", "snapshot.n_obs", "snapshot.min_support_est")


SEM = f"""{CAT}, {CAT_FIELDS}, sem AS (SELECT feature_id, max(CASE name WHEN 'age' THEN 0.8 WHEN 'brand' THEN 0.1 WHEN 'zip' THEN 0.7 ELSE 1.0 END) AS s_sem FROM fld GROUP BY 1)"""


@query("s_sem", f"WITH {SEM} SELECT feature_id, s_sem::DOUBLE AS s_sem FROM sem")
def s_sem(spark, sf):
    # taxonomy of known field classes, a fixed handful of rows
    taxonomy = spark.createDataFrame([("age", 0.8), ("brand", 0.1), ("zip", 0.7)], "field string, sensitivity double")
    fields = catalog(spark, sf).select("feature_id", F.explode("fields").alias("f")).select(
        "feature_id", F.col("f.name").alias("field")
    )
    return ms.semantic_score(fields, F.broadcast(taxonomy))


# ---- admissible set, tiers and selection ------------------------------------------------------------------------
ADMISSIBLE = f"""{SUBSCORES}, m AS (SELECT *, CASE WHEN round(lps_total, 12) >= 0.75 THEN 2 WHEN round(lps_total, 12) >= 0.45 THEN 1 ELSE 0 END AS band,
   CASE WHEN list_contains(tags, 'demographics') THEN 1 ELSE 0 END AS hard FROM lps),
 adm AS (SELECT m.feature_id, b, brk, g, lvl, query_type FROM m, (VALUES ('LOCAL', 0), ('SHUFFLE', 1), ('CENTRAL', 2)) bb(b, brk), (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) gg(g, lvl)
   WHERE lvl >= greatest(band, hard) AND NOT (b = 'CENTRAL' AND list_contains(tags, 'precise_location')))"""


def admissible(spark, sf):
    return ms.with_admissible_set(scored(spark, sf), POLICY)


@query(
    "admissible_set",
    f"""WITH {ADMISSIBLE} SELECT m.feature_id, CASE greatest(band, hard) WHEN 0 THEN 'ITEM' WHEN 1 THEN 'CLUSTER' ELSE 'AGGREGATE' END AS min_granularity,
  CASE WHEN hard = 1 THEN 'CLUSTER' ELSE CASE band WHEN 0 THEN 'ITEM' WHEN 1 THEN 'CLUSTER' ELSE 'AGGREGATE' END END AS replaced_minimum,
  s AS admissible FROM m JOIN (SELECT feature_id, string_agg(b || '/' || g, ',' ORDER BY b, g) AS s FROM adm GROUP BY 1) USING (feature_id)""",
)
@sized
def admissible_set(spark, sf):
    pairs = F.transform("admissible_set", lambda x: F.concat_ws("/", x["boundary"], x["granularity"]))
    base = scored(spark, sf)
    both = ms.with_admissible_set(base, POLICY, "replace").withColumnRenamed("min_granularity", "replaced_minimum")
    return ms.with_admissible_set(both.drop("admissible_set"), POLICY).select(
        "feature_id", "min_granularity", "replaced_minimum", F.array_join(pairs, ",").alias("admissible")
    )


@query(
    "routing_tiers",
    f"""WITH {SUBSCORES} SELECT feature_id, CASE WHEN lps_total >= 0.75 THEN 'AGGREGATE_ONLY' WHEN lps_total >= 0.40 THEN 'SHUFFLE'
  WHEN p_retailprice > 1000 THEN 'CENTRAL_ITEM' ELSE 'AGGREGATE_ONLY' END AS tier FROM lps""",
)
@sized
def routing_tiers(spark, sf):
    return scored(spark, sf).select(
        "feature_id", ms.routing_tier(F.col("lps_total"), F.col("p_retailprice") > 1000).alias("tier")
    )


EFFVAR = f"""{ADMISSIBLE}, ev1 AS (SELECT a.*, s.minsup, round(CASE WHEN query_type = 'COUNT' THEN 0.25 / greatest(1, n_eff)
     ELSE 0.25 / (greatest(1, n_eff) * greatest(1, n_eff)) + greatest(0.0, rate * (1 - rate) / n_eff) END, 15) AS effvar
   FROM adm a LEFT JOIN snap s ON s.feature_id = a.feature_id AND s.window_id = 'W1' AND s.level = a.g),
 pick AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY CASE WHEN minsup >= 3 THEN 0 ELSE 1 END,
     CASE WHEN minsup >= 3 THEN effvar END, CASE WHEN minsup >= 3 THEN lvl ELSE -lvl END, brk) AS rn FROM ev1),
 sel AS (SELECT feature_id, b AS selected_boundary, g AS selected_granularity, CASE WHEN minsup >= 3 THEN effvar END AS eff_var,
     CASE WHEN minsup >= 3 THEN 'MIN_EFFVAR_SELECTED,TIEBREAK_FINEST_THEN_SAFEST' ELSE 'NO_FEASIBLE_STATS_FALLBACK_COARSE' END AS why FROM pick WHERE rn = 1)"""


def selected(spark, sf):
    return routing.select_min_effvar(admissible(spark, sf), POLICY, n_col="n_eff")


@query("select_min_effvar", f"WITH {EFFVAR} SELECT feature_id, selected_boundary, selected_granularity, {R('eff_var')} AS eff_var, why AS reasons FROM sel")
@sized
def select_min_effvar(spark, sf):
    return selected(spark, sf).select(
        "feature_id", "selected_boundary", "selected_granularity", r(F.col("eff_var")).alias("eff_var"),
        F.array_join("decision_reason_codes", ",").alias("reasons"),
    )


@query(
    "routing_decision",
    f"""WITH {EFFVAR} SELECT feature_id, selected_boundary, selected_granularity, 'GAUSSIAN' AS dp_mechanism,
  CASE selected_granularity WHEN 'ITEM' THEN 'item_id' WHEN 'CLUSTER' THEN 'cluster_id' ELSE '' END AS aggregation_keys,
  selected_boundary = 'CENTRAL' AS allow_joins, retention_days, 0.5::DOUBLE AS sigma FROM sel JOIN defs USING (feature_id)""",
)
@sized
def routing_decision(spark, sf):
    return routing.routing_decision(selected(spark, sf), POLICY).select(
        "feature_id", "selected_boundary", "selected_granularity", "dp_mechanism",
        F.array_join("aggregation_keys", ",").alias("aggregation_keys"), "join_policy.allow_joins",
        "retention_policy.retention_days", "dp_parameters.sigma",
    )


@query(
    "issue_contracts",
    f"""WITH {EFFVAR} SELECT feature_id, 'c_' || feature_id || '_1706745600' AS contract_version, selected_boundary AS boundary, selected_granularity AS granularity,
  CASE selected_granularity WHEN 'ITEM' THEN selected_boundary || '/CLUSTER,' || selected_boundary || '/AGGREGATE'
    WHEN 'CLUSTER' THEN selected_boundary || '/AGGREGATE' ELSE '' END AS downgrades, true AS active FROM sel""",
)
@sized
def issue_contracts(spark, sf):
    issued = pc.issue_contracts(routing.routing_decision(selected(spark, sf), POLICY), "1706745600")
    steps = F.transform("allow_downgrade_to", lambda x: F.concat_ws("/", x["boundary"], x["granularity"]))
    return issued.select(
        "feature_id", "contract_version", F.col("selected_boundary").alias("boundary"),
        F.col("selected_granularity").alias("granularity"), F.array_join(steps, ",").alias("downgrades"), "active",
    )


@query(
    "compile_contract_bundle",
    f"""WITH {EFFVAR}, {CAT}, {CAT_FIELDS}, f AS (SELECT feature_id, string_agg(name, ',' ORDER BY pos) AS required,
   coalesce(string_agg(CASE WHEN NOT is_identifier THEN name END, ',' ORDER BY pos), '') AS staging FROM fld GROUP BY 1)
SELECT feature_id, required, staging, CASE selected_granularity WHEN 'ITEM' THEN 'item_id' WHEN 'CLUSTER' THEN 'cluster_id' ELSE '' END AS dims,
  2 AS cap, 20 AS k_min, selected_granularity AS preferred, selected_boundary AS boundary, 'GAUSSIAN' AS mechanism FROM sel JOIN f USING (feature_id)""",
)
@sized
def compile_contract_bundle(spark, sf):
    issued = pc.issue_contracts(routing.routing_decision(selected(spark, sf), POLICY), "1706745600")
    bundles = pc.contract_bundles(issued.drop("join_keys"), catalog(spark, sf).select("feature_id", "fields", "bucketizations"), cm.CONTRACT)
    return bundles.select(
        "feature_id",
        F.array_join("rfc.required_fields", ",").alias("required"),
        F.array_join("rfc.staging_fields", ",").alias("staging"),
        F.array_join("transform_plan.cell_dimensions", ",").alias("dims"),
        F.col("bounding_plan.cap_per_cell").alias("cap"),
        "granularity_plan.k_min",
        "granularity_plan.preferred",
        "dp_config.boundary",
        "dp_config.mechanism",
    )


@query(
    "probe_schedule",
    f"""WITH {SUBSCORES} SELECT feature_id, DATE '{ASOF}' + CASE WHEN len(tags) > 0 THEN 7 WHEN s_link > 0.5 OR s_uniq > 0.9 THEN 14 ELSE 30 END AS due FROM lps""",
)
@sized
def probe_schedule(spark, sf):
    rising = (F.col("s_link") > 0.5) | (F.col("s_uniq") > 0.9)
    due = ms.probe_due(F.lit(ASOF).cast("date"), F.size("sensitivity_tags") > 0, rising)
    return scored(spark, sf).select("feature_id", due.alias("due"))


# ---- selection rules over event levels --------------------------------------------------------------------------
LEVELS = (
    cm.LADDER
    + """, c AS (SELECT event_type || '@' || window_id AS feature_id, level, lvl, cell, count(*) AS cnt, sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS y FROM lad GROUP BY ALL),
 lev AS (SELECT feature_id, level, lvl, sum(cnt)::DOUBLE / count(*) AS n, sum(y) / sum(cnt) AS rate, var_pop(y / cnt) AS signal,
    sum(y - y * y / cnt) / sum(cnt) AS loss FROM c GROUP BY ALL)"""
)


def level_rows(spark, sf):
    cells = cm.feature_cells(spark, sf).withColumn("feature_id", F.concat_ws("@", "feature_id", "window_id"))
    return cells.groupBy("feature_id", "level", "lvl").agg(
        (F.sum("cnt") / F.count("*")).alias("n"),
        (F.sum("y") / F.sum("cnt")).alias("rate"),
        F.var_pop(F.col("y") / F.col("cnt")).alias("signal"),
        (F.sum(F.col("yy") - F.col("y") * F.col("y") / F.col("cnt")) / F.sum("cnt")).alias("loss"),
    )


@query(
    "select_finest_under_tau",
    f"""WITH {LEVELS}, s AS (SELECT feature_id, level, lvl, sqrt(rate * (1 - rate) / n + 16.0 / (n * n)) AS sd FROM lev)
SELECT feature_id, min_by(level, lvl) AS selected_granularity, {R('min_by(sd, lvl)')} AS std_total FROM s WHERE round(sd, 12) <= 0.15 GROUP BY 1""",
)
def select_finest_under_tau(spark, sf):
    out = routing.select_finest_under_tau(level_rows(spark, sf), 0.15, 4.0)
    return out.withColumn("std_total", r(F.col("std_total")))


@query(
    "select_snr",
    f"""WITH {LEVELS}, s AS (SELECT feature_id, level, lvl, sqrt(signal) / (4.0 / n) AS snr FROM lev)
SELECT feature_id, level AS selected_granularity, {R('snr')} AS snr FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(snr, 15) DESC, lvl) AS rn FROM s) WHERE rn = 1""",
)
def select_snr(spark, sf):
    rows = level_rows(spark, sf).withColumn("snr", F.sqrt("signal") / (4.0 / F.col("n")))
    return routing.select_best(rows, "snr").withColumn("snr", r(F.col("snr")))


@query(
    "select_lambda_loss",
    f"""WITH {LEVELS}, i AS (SELECT feature_id, loss AS base FROM lev WHERE lvl = 0),
 s AS (SELECT feature_id, level, lvl, 0.5 * (n * (exp(e0) + 1) / pow(exp(e0) - 1, 2)) / (n * n) + (loss - base) AS objective
   FROM (SELECT *, 1.0 * sqrt(n) / ln(1.0 / 0.01) AS e0 FROM lev) JOIN i USING (feature_id))
SELECT feature_id, level AS selected_granularity, {R('objective')} AS objective FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY round(objective, 15), lvl) AS rn FROM s) WHERE rn = 1""",
)
def select_lambda_loss(spark, sf):
    rows = level_rows(spark, sf)
    item = rows.filter("lvl = 0").select("feature_id", F.col("loss").alias("base"))
    scored_rows = rows.join(item, "feature_id").withColumn(
        "objective", routing.noise_loss(F.col("n"), F.col("loss") - F.col("base"), 0.5, 1.0, 0.01)
    )
    return routing.select_best(scored_rows, "objective", largest=False).withColumn("objective", r(F.col("objective")))


@query(
    "boundary_rule",
    f"""WITH {BASE}, w AS (SELECT feature_id, max(risk) FILTER (lvl = 0) AS ri, max(risk) FILTER (lvl = 1) AS rc, max(risk) FILTER (lvl = 2) AS ra FROM sc GROUP BY 1)
SELECT feature_id, CASE WHEN round(rc, 12) <= 0.55 THEN 'CENTRAL' WHEN round(ri, 12) <= 0.70 THEN 'SHUFFLE' WHEN round(ri, 12) <= 0.90 THEN 'LOCAL' END AS selected_boundary FROM w""",
)
def boundary_rule(spark, sf):
    scored_rows = risk.scorecard(supported_catalog(spark, sf), TH)
    picked = routing.select_boundary(
        scored_rows,
        utility={"CENTRAL": 3.0, "SHUFFLE": 2.0, "LOCAL": 1.0},
        caps=TH.tau_boundary,
        finest={"CENTRAL": "CLUSTER", "SHUFFLE": "ITEM", "LOCAL": "ITEM"},
    )
    return picked.select("feature_id", "selected_boundary")


# ---- composite scores over events -------------------------------------------------------------------------------
SIX = f"""{cm.EV}, {LEDGER},
 seen AS (SELECT DISTINCT event_type, contributor, CAST(ts AS DATE) AS d FROM ev),
 stab AS (SELECT event_type, avg(p) AS s_stab FROM (SELECT a.event_type, a.d, count(b.d) / count(*) AS p FROM seen a LEFT JOIN seen b
    ON a.event_type = b.event_type AND a.contributor = b.contributor AND b.d = a.d + 1 GROUP BY ALL) GROUP BY 1),
 uq AS (SELECT event_type, greatest(0.0, least(1.0, (count(DISTINCT k) / count(*) - 0.01) / 0.09)) AS s_uniq FROM ev GROUP BY 1),
 lk AS (SELECT event_type, least(1.0, 0.5 + 0.3 * least(1.0, ln(1 + count(DISTINCT c_mktsegment)) / ln(11)) + 0.2 * 30 / 365.0) AS s_link FROM ev JOIN customer ON contributor = c_custkey GROUP BY 1),
 au AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v, c_mktsegment = 'BUILDING' AS pos FROM ev JOIN customer ON contributor = c_custkey),
 ar AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY v) + (count(*) OVER (PARTITION BY event_type, v) - 1) / 2.0 AS rnk FROM au),
 ac AS (SELECT event_type, greatest(0.0, least(1.0, 2 * ((sum(rnk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) - 0.5))) AS s_inf FROM ar GROUP BY 1),
 se AS (SELECT event_type, CASE WHEN max(value) > 400 THEN 0.8 ELSE 0.3 END AS s_sem FROM ev GROUP BY 1),
 ep AS (SELECT feature_id AS event_type, least(1.0, sum(epsilon_spend) / 1.5) AS s_eps FROM ledger GROUP BY 1)"""
SIX_TOTAL = "0.2 * s_sem + 0.2 * s_uniq + 0.2 * s_link + 0.2 * s_inf + 0.1 * s_eps + 0.1 * s_stab"


@query(
    "lps_six_component",
    f"""WITH {SIX} SELECT event_type AS feature_id, {', '.join(R(c) + ' AS ' + c for c in ('s_sem', 's_uniq', 's_link', 's_inf', 's_eps', 's_stab'))},
  {R(SIX_TOTAL)} AS lps, {R(f'1.0 / (1.0 + exp(-({SIX_TOTAL})))')} AS lps_logistic
FROM stab JOIN uq USING (event_type) JOIN lk USING (event_type) JOIN ac USING (event_type) JOIN se USING (event_type) JOIN ep USING (event_type)""",
)
def lps_six_component(spark, sf):
    ev = cm.weekly_events(spark, sf).withColumnRenamed("event_type", "feature_id")
    who = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("contributor"), "c_mktsegment")
    stab = joins.key_persistence(ev, "contributor", "day_id", ["feature_id"]).groupBy("feature_id").agg(
        F.avg("persistence").alias("s_stab")
    )
    # three passes over the events: keys of days, values of k, and a stored histogram of values by segment
    ratio = ms.uniq_distinct_ratio(F.col("d"), F.col("n"), 0.01, 0.10)
    uniq = (
        ev.groupBy("feature_id", "k").agg(F.count("*").alias("c"), F.max("value").alias("most")).groupBy("feature_id")
        .agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.max("most").alias("most"))
        .select("feature_id", ratio.alias("s_uniq"), F.when(F.col("most") > 400, 0.8).otherwise(0.3).alias("s_sem"))
    )
    cents = F.round(F.col("value") * 100).cast("bigint").alias("v")
    hist = store(ev.join(who, "contributor").groupBy("feature_id", cents, "c_mktsegment").agg(F.count("*").alias("n")), "value-histogram")
    link, _ = ms.link_score(F.array(F.lit("user_id")), F.col("deg"), F.lit(30), ScorePolicy())
    links = hist.groupBy("feature_id").agg(F.count_distinct("c_mktsegment").alias("deg")).select("feature_id", link.alias("s_link"))
    hit = F.coalesce(F.col("c_mktsegment") == "BUILDING", F.lit(False))
    labelled = hist.select("feature_id", "v", F.when(hit, F.col("n")).otherwise(0).alias("pos"), F.when(~hit, F.col("n")).otherwise(0).alias("neg"))
    inf = stats.binary_auc(labelled, ["feature_id"], "v").select("feature_id", auc_to_risk(F.col("auc")).alias("s_inf"))
    eps = lg.exposure(ledger(spark, sf), 1.5).select("feature_id", "s_eps")
    parts = uniq
    for other in (links, inf, eps, stab):
        parts = parts.join(other, "feature_id")
    weights = {"s_sem": 0.2, "s_uniq": 0.2, "s_link": 0.2, "s_inf": 0.2, "s_eps": 0.1, "s_stab": 0.1}
    return parts.select(
        "feature_id", *[r(F.col(c)).alias(c) for c in weights],
        r(ms.six_component_score(weights)).alias("lps"),
        r(ms.six_component_score(weights, logistic=True)).alias("lps_logistic"),
    )


@query(
    "formal_lps",
    f"""WITH {cm.LADDER}, {MI}, seen AS (SELECT DISTINCT contributor, CAST(ts AS DATE) AS d FROM ev),
 st AS (SELECT avg(p) AS stab FROM (SELECT a.d, count(b.d) / count(*) AS p FROM seen a LEFT JOIN seen b ON a.contributor = b.contributor AND b.d = a.d + 1 GROUP BY a.d)),
 sp AS (SELECT window_id, level, cell, count(DISTINCT contributor) AS s FROM lad GROUP BY ALL), u AS (SELECT level, avg(1.0 / s) AS u FROM sp GROUP BY 1),
 i AS (SELECT level, max(mi) AS mi, sum(CASE WHEN round(mi, 9) > 0.01 THEN 0.2 ELSE 0.0 END) AS pen FROM mi GROUP BY 1),
 x AS (SELECT level, 0.6 * stab AS L, u AS U, mi AS I, least(1.0, pen) AS R FROM u JOIN i USING (level), st)
SELECT level, {R('L')} AS L, {R('U')} AS U, {R('I')} AS I, {R('R')} AS R, {R('0.30 * L + 0.35 * U + 0.25 * least(1.0, I) + 0.10 * R')} AS risk FROM x""",
)
def formal_lps(spark, sf):
    """Linkability from measured key stability, uniqueness as E[1/support], inferability as the worst mutual information."""
    ev = cm.weekly_events(spark, sf)
    stab = joins.key_persistence(ev, "contributor", "day_id").agg(
        (0.6 * F.avg("persistence")).alias("L")
    )
    u = weekly_supports(spark, sf).groupBy("level").agg(F.avg(1.0 / F.col("support")).alias("U"))
    i = worst_mutual_information(spark, sf, penalty_above=0.01, penalty=0.2).select(
        "level", F.col("max_mi").alias("I"), F.least(F.lit(1.0), F.col("penalty")).alias("R")
    )
    x = u.join(i, "level").withColumn("L", stab.scalar())
    total = risk.total_risk(F.col("L"), F.col("U"), F.least(F.lit(1.0), F.col("I")), F.col("R"), TH)
    return x.select("level", *[r(F.col(c)).alias(c) for c in ("L", "U", "I", "R")], r(total).alias("risk"))


@query(
    "key_registry_check",
    f"""WITH {CAT}, k AS (SELECT feature_id, j.name AS key_name, j.stability AS st FROM (SELECT feature_id, unnest(join_keys) AS j FROM cat))
SELECT feature_id, key_name, CASE key_name WHEN 'uid' THEN 'user_id' END AS canonical,
  CASE WHEN key_name <> 'uid' THEN 'UNDECLARED_KEY_CONSERVATIVE' END AS flag FROM k""",
)
def key_registry_check(spark, sf):
    registry = spark.createDataFrame([("uid", "user_id"), ("did", "device_id")], "key_name string, canonical string")
    keys = catalog(spark, sf).select("feature_id", F.explode("join_keys").alias("k")).select(
        "feature_id", F.col("k.name").alias("key_name")
    )
    return ms.resolve_keys(keys, F.broadcast(registry))


@query(
    "amplified_epsilon",
    f"""WITH {cm.EV}, n AS (SELECT window_id, event_type, count(*) AS n FROM ev GROUP BY ALL)
SELECT window_id, event_type, n, {R('1.0 * sqrt(n) / ln(1.0 / 1e-6)')} AS planned_epsilon0,
  {R('''CASE WHEN 0.3 <= ln(n / (16.0 * ln(2.0 / 1e-6))) THEN ln(1.0 + (exp(0.3) - 1.0) / (exp(0.3) + 1.0) * (8.0 * sqrt(exp(0.3) * ln(4.0 / 1e-6)) / sqrt(n) + 8.0 * exp(0.3) / n)) END''')} AS amplified_epsilon FROM n""",
)
def amplified_epsilon(spark, sf):
    n = cm.weekly_events(spark, sf).groupBy("window_id", "event_type").agg(F.count("*").alias("n"))
    return n.withColumn(
        "planned_epsilon0", r(shuffle_dp.planned_local_epsilon(1.0, F.col("n"), 1e-6))
    ).withColumn("amplified_epsilon", r(shuffle_dp.amplified_epsilon(0.3, F.col("n"), 1e-6)))
