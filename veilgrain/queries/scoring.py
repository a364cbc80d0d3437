"""Catalog scorecards, decisions, edits and constraints plus metrics M1-M5."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.functions.scalar import lookup
from veilgrain.operators import governance as gov
from veilgrain.plans import contracts as pc
from veilgrain.plans import risk
from veilgrain.queries.catalog import CAT, CAT_FIELDS, CAT_KEYS, CAT_SUPPORT, catalog, supported_catalog
from veilgrain.queries.registry import R, query, r
from veilgrain.schema import Thresholds
from veilgrain.sources import tables

TH = Thresholds()

TAG_W = """CASE t WHEN 'health' THEN 0.5 WHEN 'precise_location' THEN 0.45 WHEN 'financial' THEN 0.4 WHEN 'children' THEN 0.6
  WHEN 'age' THEN 0.2 WHEN 'gender' THEN 0.15 WHEN 'location' THEN 0.2 ELSE 0.1 END"""
PRESSURE = """CASE WHEN is_identifier THEN 1.0 WHEN buckets IS NOT NULL THEN least(1.0, buckets / 200.0)
  WHEN cardinality_hint IS NOT NULL THEN least(1.0, sqrt(cardinality_hint) / 200.0) ELSE 0.15 END"""
SENS = "CASE WHEN buckets IS NULL THEN 0.25 ELSE least(1.0, 0.15 + buckets / 500.0) END"
STRENGTH = """0.8 * greatest(0.0, least(1.0, stability)) + 0.2 * CASE WHEN ndv_hint > 0 THEN least(1.0, sqrt(ndv_hint) / 1000.0) ELSE 0 END"""
BASE = f"""{CAT}, {CAT_FIELDS}, {CAT_KEYS}, {CAT_SUPPORT},
 lnk AS (SELECT feature_id, avg({STRENGTH}) AS c, avg(stability) AS stab FROM keys GROUP BY 1),
 tag AS (SELECT feature_id, sum({TAG_W})::DOUBLE AS w FROM (SELECT feature_id, unnest(policy_tags) AS t FROM cat) GROUP BY 1),
 prs AS (SELECT feature_id, sum({PRESSURE}) / count(*) AS p, count(*) FILTER (is_sensitive) AS ns,
         sum({SENS}) FILTER (is_sensitive) AS sc FROM fld GROUP BY 1),
 lir AS (SELECT cat.feature_id, p_type, p_size,
   CASE WHEN c IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, c * (0.7 + 0.3 * least(1.0, ttl_days / 90.0)))) END AS L,
   CASE WHEN ns = 0 THEN 0.05 ELSE least(1.0, 0.15 + 0.12 * least(5, ns) + 0.05 * sc + CASE WHEN stab IS NULL THEN 0.0 ELSE 0.15 * least(1.0, stab) END) END AS I,
   CASE WHEN w IS NULL THEN 0.0 ELSE least(1.0, w) END AS R, p, s_item, s_cluster, s_agg
   FROM cat JOIN prs USING (feature_id) JOIN sup USING (feature_id) LEFT JOIN lnk USING (feature_id) LEFT JOIN tag USING (feature_id)),
 g AS (SELECT * FROM (VALUES ('ITEM', 0, 1.0, 0.45), ('CLUSTER', 1, 0.6, 0.6), ('AGGREGATE', 2, 0.25, 0.75)) t(granularity, lvl, f, tau_g)),
 ug AS (SELECT lir.*, g.*, CASE lvl WHEN 0 THEN s_item WHEN 1 THEN s_cluster ELSE s_agg END AS support FROM lir, g),
 uu AS (SELECT *, CASE WHEN support > 0 THEN least(1.0, 1.0 / greatest(1.0, support / 100.0)) ELSE least(1.0, p * f) END AS U FROM ug),
 sc AS (SELECT *, greatest(0.0, least(1.0, 0.30 * L + 0.35 * U + 0.25 * I + 0.10 * R)) AS risk FROM uu)"""
DECIDE = f"""{BASE}, b AS (SELECT * FROM (VALUES ('CENTRAL', 0, 0.55), ('SHUFFLE', 1, 0.70), ('LOCAL', 2, 0.90)) t(boundary, bn, tau_b)),
 ok AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY bn, lvl) AS rn FROM sc, b
        WHERE round(risk, 12) <= tau_b AND round(risk, 12) <= tau_g),
 dec AS (SELECT s.feature_id, s.p_type, s.p_size, coalesce(ok.boundary, 'LOCAL') AS boundary, coalesce(ok.granularity, 'AGGREGATE') AS granularity,
   ok.feature_id IS NOT NULL AS feasible, CASE WHEN ok.feature_id IS NULL THEN 'no_feasible_option_under_thresholds' ELSE 'feasible' END AS reason,
   s.L, coalesce(ok.U, s.U) AS U, s.I, s.R, coalesce(ok.risk, s.risk) AS risk
   FROM (SELECT * FROM sc WHERE lvl = 0) s LEFT JOIN (SELECT * FROM ok WHERE rn = 1) ok USING (feature_id))"""


@query("score_linkability", f"WITH {BASE} SELECT feature_id, {R('L')} AS L FROM lir")
def score_linkability(spark, sf):
    return catalog(spark, sf).select("feature_id", r(risk.linkability(F.col("join_keys"), F.col("ttl_days"))).alias("L"))


@query("score_uniqueness", f"WITH {BASE} SELECT feature_id, granularity, {R('U')} AS U FROM sc")
def score_uniqueness(spark, sf):
    return risk.scorecard_rows(supported_catalog(spark, sf), TH).select("feature_id", "granularity", r(F.col("U")).alias("U"))


@query("score_inferability", f"WITH {BASE} SELECT feature_id, {R('I')} AS I FROM lir")
def score_inferability(spark, sf):
    i = risk.inferability(F.col("fields"), F.col("bucketizations"), F.col("join_keys"))
    return catalog(spark, sf).select("feature_id", r(i).alias("I"))


@query("score_policy_penalty", f"WITH {BASE} SELECT feature_id, {R('R')} AS R FROM lir")
def score_policy_penalty(spark, sf):
    return catalog(spark, sf).select("feature_id", r(risk.policy_penalty(F.col("policy_tags"))).alias("R"))


@query(
    "scorecard",
    f"WITH {BASE} SELECT feature_id, granularity, {R('L')} AS L, {R('U')} AS U, {R('I')} AS I, {R('R')} AS R, {R('risk')} AS risk FROM sc",
)
def scorecard(spark, sf):
    rows = risk.scorecard_rows(supported_catalog(spark, sf), TH)
    return rows.select("feature_id", "granularity", *[r(F.col(c)).alias(c) for c in ("L", "U", "I", "R", "risk")])


@query(
    "scorecard_contributors",
    f"""WITH {BASE}
SELECT feature_id, 'L' AS component, name AS field, {R(STRENGTH)} AS value FROM keys
UNION ALL SELECT feature_id, 'U', 'support_hint', {R('U')} FROM sc WHERE lvl = 0 AND support > 0
UNION ALL SELECT feature_id, 'U', name, {R(PRESSURE)} FROM fld JOIN sc USING (feature_id) WHERE lvl = 0 AND support IS NULL
UNION ALL SELECT feature_id, 'I', name, {R(SENS)} FROM fld WHERE is_sensitive
UNION ALL SELECT feature_id, 'I', 'no_sensitive_declared', 0.05 FROM prs WHERE ns = 0
UNION ALL SELECT feature_id, 'R', t, {R(TAG_W)} FROM (SELECT feature_id, unnest(policy_tags) AS t FROM cat)""",
)
def scorecard_contributors(spark, sf):
    rows = risk.contributors(supported_catalog(spark, sf), "ITEM", TH)
    return rows.withColumn("value", r(F.col("value")))


@query(
    "feasible_options",
    f"""WITH {DECIDE} SELECT feature_id, boundary, granularity, CAST(bn * 3 + lvl AS INT) AS place, {R('risk')} AS risk FROM ok""",
)
def feasible_options(spark, sf):
    scored = risk.scorecard(supported_catalog(spark, sf), TH)
    return risk.options(scored, TH).withColumn("risk", r(F.col("risk")))


DECISION_COLUMNS = ["feature_id", "boundary", "granularity", "feasible", "reason"]


@query(
    "decide",
    f"""WITH {DECIDE} SELECT feature_id, boundary, granularity, feasible, reason, {R('L')} AS L, {R('U')} AS U, {R('I')} AS I,
  {R('R')} AS R, {R('risk')} AS risk FROM dec""",
)
def decide(spark, sf):
    d = decisions(spark, sf)
    return d.select(*DECISION_COLUMNS, *[r(F.col(c)).alias(c) for c in ("L", "U", "I", "R", "risk")])


def decisions(spark, sf):
    return risk.decide(supported_catalog(spark, sf), TH)


def _edits(support: str, factor: str, cap: str) -> str:
    return f"""{BASE},
 ed AS (SELECT feature_id, 'bucketize:' || name || ':' || buckets || '->' || greatest(2, buckets // 2) AS edit, 0 AS kind, pos, name AS field, greatest(2, buckets // 2) AS nb
        FROM fld WHERE is_sensitive AND buckets IS NOT NULL AND greatest(2, buckets // 2) <> buckets
        UNION ALL SELECT feature_id, 'drop_field:' || name, 1, pos, name, NULL FROM fld WHERE is_identifier OR is_sensitive),
 ef AS (SELECT ed.feature_id, edit, kind, ed.pos, fld.is_sensitive, fld.is_identifier, fld.cardinality_hint,
        CASE WHEN fld.name = field THEN nb ELSE fld.buckets END AS buckets
        FROM ed JOIN fld ON ed.feature_id = fld.feature_id AND (kind = 0 OR fld.name <> field)),
 ep AS (SELECT feature_id, edit, kind, pos, sum({PRESSURE}) / count(*) AS p, count(*) FILTER (is_sensitive) AS ns,
        sum({SENS}) FILTER (is_sensitive) AS sc FROM ef GROUP BY ALL),
 es AS (SELECT ep.feature_id, edit, kind, pos, lir.L, lir.R,
        CASE WHEN {support} > 0 THEN least(1.0, 1.0 / greatest(1.0, {support} / 100.0)) ELSE least(1.0, ep.p * {factor}) END AS U,
        CASE WHEN ep.ns = 0 THEN 0.05 ELSE least(1.0, 0.15 + 0.12 * least(5, ep.ns) + 0.05 * ep.sc + CASE WHEN stab IS NULL THEN 0.0 ELSE 0.15 * least(1.0, stab) END) END AS I
        FROM ep JOIN lir USING (feature_id) LEFT JOIN lnk USING (feature_id)),
 er AS (SELECT *, least(1.0, 0.30 * L + 0.35 * U + 0.25 * I + 0.10 * R) AS risk FROM es),
 rk AS (SELECT *, round(risk, 12) <= {cap} AS ok, row_number() OVER (PARTITION BY feature_id
        ORDER BY CASE WHEN round(risk, 12) <= {cap} THEN 0 ELSE 1 END, round(risk, 12), kind, pos) AS rank FROM er)"""


@query(
    "counterfactuals",
    f"""WITH {_edits('s_cluster', '0.6', '0.6')}
SELECT feature_id, edit, ok AS feasible_at_target, {R('U')} AS U, {R('I')} AS I, {R('risk')} AS risk FROM rk""",
)
def counterfactuals(spark, sf):
    cf = risk.counterfactuals(supported_catalog(spark, sf), TH, "CLUSTER")
    return cf.select(
        "feature_id", "edit", "feasible_at_target", r(F.col("U")).alias("U"), r(F.col("I")).alias("I"),
        r(F.col("risk")).alias("risk"),
    )


@query(
    "counterfactual_rank",
    f"""WITH {_edits('s_item', '1.0', '0.45')}
SELECT feature_id, edit, ok AS feasible_at_target, {R('risk')} AS risk, rank FROM rk WHERE rank <= 5""",
)
def counterfactual_rank(spark, sf):
    """The five best edits of each feature for a release per item."""
    ranked = risk.rank_edits(risk.counterfactuals(supported_catalog(spark, sf), TH, "ITEM"), top=5)
    return ranked.select(
        "feature_id", "edit", "feasible_at_target", r(F.col("risk")).alias("risk"),
        F.col("rank").cast("bigint").alias("rank"),
    )


CONSTRAINTS = f"""{DECIDE}, con AS (SELECT dec.*, granularity = 'AGGREGATE' AS all_keys, granularity <> 'ITEM' AS pre,
   CASE granularity WHEN 'ITEM' THEN 1 ELSE 100 END AS k,
   CASE WHEN granularity = 'CLUSTER' AND p_type IN ('LARGE', 'PROMO') THEN ['device_id'] ELSE []::VARCHAR[] END AS ids,
   CASE WHEN granularity <> 'CLUSTER' OR p_type = 'MEDIUM' THEN []::VARCHAR[] WHEN p_type = 'STANDARD' THEN ['uid', 'zip'] ELSE ['uid'] END AS jk FROM dec)"""


@query(
    "planner_constraints",
    f"""WITH {CONSTRAINTS} SELECT feature_id, boundary, granularity, all_keys AS forbid_group_by_all, all_keys AS forbid_joins_all,
  array_to_string(ids, ',') AS forbid_group_by_keys, array_to_string(jk, ',') AS forbid_joins_on,
  CAST(k AS INT) AS min_group_cardinality, pre AS require_pre_aggregation FROM con""",
)
def planner_constraints(spark, sf):
    c = risk.planner_constraints(decisions(spark, sf), TH)
    return c.select(
        "feature_id", "boundary", "granularity", "forbid_group_by_all", "forbid_joins_all",
        F.array_join("forbid_group_by_keys", ",").alias("forbid_group_by_keys"),
        F.array_join("forbid_joins_on", ",").alias("forbid_joins_on"),
        "min_group_cardinality", "require_pre_aggregation",
    )


@query(
    "query_request_gate",
    f"""WITH {CONSTRAINTS}, req AS (SELECT 'f_' || l_partkey AS feature_id,
   CASE l_returnflag WHEN 'A' THEN ['device_id', 'brand'] WHEN 'N' THEN ['brand'] ELSE []::VARCHAR[] END AS gb,
   CASE WHEN l_discount > 0.05 THEN ['uid'] ELSE []::VARCHAR[] END AS jn, l_quantity * 4 AS mgs, l_linestatus = 'F' AS agg FROM lineitem),
 v AS (SELECT array_to_string(list_filter([
   CASE WHEN (all_keys AND len(gb) > 0) OR list_has_any(gb, ids) THEN 'GROUP_BY_FORBIDDEN' END,
   CASE WHEN (all_keys AND len(jn) > 0) OR list_has_any(jn, jk) THEN 'JOIN_FORBIDDEN' END,
   CASE WHEN mgs < k THEN 'GROUP_TOO_SMALL' END, CASE WHEN pre AND NOT agg THEN 'NOT_AGGREGATED' END], lambda x: x IS NOT NULL), ',') AS violations
   FROM req JOIN con USING (feature_id))
SELECT violations, count(*) AS n FROM v GROUP BY 1""",
)
def query_request_gate(spark, sf):
    empty = F.array().cast("array<string>")
    requests = tables.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f_"), "l_partkey").alias("feature_id"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("device_id"), F.lit("brand")))
        .when(F.col("l_returnflag") == "N", F.array(F.lit("brand")))
        .otherwise(empty)
        .alias("group_by"),
        F.when(F.col("l_discount") > 0.05, F.array(F.lit("uid"))).otherwise(empty).alias("join_keys"),
        (F.col("l_quantity") * 4).alias("min_group_size"),
        (F.col("l_linestatus") == "F").alias("aggregated"),
    )
    gated = risk.query_request_gate(requests, risk.planner_constraints(decisions(spark, sf), TH))
    return gated.groupBy(F.array_join("violations", ",").alias("violations")).agg(F.count("*").alias("n"))


# ---- plan records and fingerprints ------------------------------------------------------------------------------
FP_INPUT = """'{"feature_id":"' || feature_id || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}'"""
FP_PLAN = """'{"boundary":"' || boundary || '","feasible":' || feasible || ',"granularity":"' || granularity || '","input_fingerprint":"' ||
   input_fingerprint || '","policy_hash":"' || policy_hash || '","status":"' || CASE WHEN feasible THEN 'accepted' ELSE 'rejected' END || '"}'"""


@query(
    "fingerprints",
    f"""WITH cat AS (SELECT 'f_' || p_partkey AS feature_id, p_size, p_type FROM part)
SELECT feature_id, sha256({FP_INPUT}) AS input_fingerprint FROM cat""",
)
def fingerprints(spark, sf):
    return catalog(spark, sf).select(
        "feature_id", pc.fingerprint_of("p_type", "feature_id", "p_size").alias("input_fingerprint")
    )


@query(
    "plan_records",
    f"""WITH {DECIDE}, f AS (SELECT *, sha256({FP_INPUT}) AS input_fingerprint, sha256('{pc.policy_json(TH)}') AS policy_hash FROM dec)
SELECT feature_id, input_fingerprint, policy_hash, sha256({FP_PLAN}) AS plan_fingerprint,
  CASE WHEN feasible THEN 'accepted' ELSE 'rejected' END AS status,
  CAST(CASE WHEN feasible THEN 0 ELSE 1 END AS INT) AS n_reasons,
  CASE WHEN NOT feasible THEN 'NO_FEASIBLE_OPTION' END AS first_code FROM f""",
)
def plan_records(spark, sf):
    records = pc.plan_records(decisions(spark, sf), ["feature_id", "p_size", "p_type"], TH, F.lit("2024-02-01T00:00:00Z"))
    return records.select(
        "feature_id", "input_fingerprint", "policy_hash", "plan_fingerprint", "status",
        F.size("rejection_reasons").alias("n_reasons"), F.get("rejection_reasons", F.lit(0))["code"].alias("first_code"),
    )


@query(
    "explain_report",
    f"""WITH {DECIDE} SELECT feature_id, feature_id || ': ' || CASE WHEN feasible THEN 'routed to ' || boundary || '/' || granularity
   ELSE 'rejected, nothing fits the caps' END || '; main driver ' ||
   CASE greatest(round(0.30 * L, 9), round(0.35 * U, 9), round(0.25 * I, 9), round(0.10 * R, 9)) WHEN round(0.30 * L, 9) THEN 'linkability'
     WHEN round(0.35 * U, 9) THEN 'uniqueness' WHEN round(0.25 * I, 9) THEN 'inferability' ELSE 'policy' END AS report FROM dec""",
)
def explain_report(spark, sf):
    return pc.explain(decisions(spark, sf), TH).select("feature_id", "report")


# ---- evaluation metrics -----------------------------------------------------------------------------------------
BAND = "CASE WHEN risk >= 0.75 THEN 'high' WHEN risk >= 0.4 THEN 'medium' ELSE 'low' END"


@query(
    "m1_score_distribution",
    f"""WITH {BASE} SELECT granularity, {BAND} AS band, count(*) AS n, bool_and(risk BETWEEN 0 AND 1) AS in_range FROM sc GROUP BY ALL""",
)
def m1_score_distribution(spark, sf):
    return gov.score_distribution(risk.scorecard_rows(supported_catalog(spark, sf), TH), "risk", ["granularity"])


@query(
    "m2_threshold_hit_rate",
    f"""WITH {BASE} SELECT granularity, {R('avg(CASE WHEN round(risk, 12) > tau_g THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM sc GROUP BY 1""",
)
def m2_threshold_hit_rate(spark, sf):
    rows = risk.scorecard_rows(supported_catalog(spark, sf), TH)
    hit = F.round("risk", risk.RISK_DIGITS) > lookup(TH.tau_granularity, F.col("granularity"))
    return rows.groupBy("granularity").agg(r(F.avg(hit.cast("double"))).alias("hit_rate"))


@query(
    "m3_enforcement_consistency",
    f"""WITH {DECIDE}, i AS (SELECT p_type, p_size, count(*) AS evaluations, count(DISTINCT boundary || granularity) AS outcomes FROM dec GROUP BY ALL)
SELECT p_type, sum(evaluations)::BIGINT AS evaluations, {R('avg(CASE WHEN outcomes = 1 THEN 1.0 ELSE 0.0 END)')} AS consistency FROM i GROUP BY 1""",
)
def m3_enforcement_consistency(spark, sf):
    """Parts of one type and size count as repeated evaluations of one input."""
    d = decisions(spark, sf).withColumn("outcome", F.concat("boundary", "granularity"))
    per_input = gov.consistency(d, ["p_type", "p_size"], "outcome")
    return per_input.groupBy("p_type").agg(
        F.sum("evaluations").alias("evaluations"), r(F.avg((F.col("outcomes") == 1).cast("double"))).alias("consistency")
    )


@query(
    "m5_granularity_reduction",
    f"""WITH {DECIDE}, x AS (SELECT p_type, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS a,
   CASE granularity WHEN 'ITEM' THEN 0 WHEN 'CLUSTER' THEN 1 ELSE 2 END AS b FROM dec)
SELECT p_type, {R('avg(greatest(b - a, 0) / (2 - a))')} AS reduction FROM x GROUP BY 1""",
)
def m5_granularity_reduction(spark, sf):
    requested = F.when(F.col("p_size") > 40, "CLUSTER").otherwise("ITEM")
    d = decisions(spark, sf).withColumn("reduction", gov.granularity_reduction(requested, F.col("granularity")))
    return d.groupBy("p_type").agg(r(F.avg("reduction")).alias("reduction"))
