"""Lineage, invariants, lifecycle and audit jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import gates, lineage, replay
from veilgrain.operators import governance as gov
from veilgrain.plans import contracts as pc
from veilgrain.queries import common as cm
from veilgrain.queries.aggregates import STAGED, staged_events
from veilgrain.queries.registry import R, query, r
from veilgrain.queries.scoring import DECIDE, TH, decisions
from veilgrain.session import delete_at_exit, run_folder
from veilgrain.sources import tables

# One hop per order and line number: flag = boundary, quantity = granularity, discount = retention.
HOPS = """hops AS (
  SELECT l_orderkey AS feature_id, l_linenumber AS hop, CASE f WHEN 'N' THEN 'LOCAL' WHEN 'R' THEN 'SHUFFLE' ELSE 'CENTRAL' END AS boundary,
    CASE WHEN q < 17 THEN 'ITEM' WHEN q < 34 THEN 'CLUSTER' ELSE 'AGGREGATE' END AS granularity, CAST(floor(q * 2) AS BIGINT) AS retention_days
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, max(l_quantity) AS q FROM lineitem GROUP BY ALL)),
 pairs AS (SELECT *, lag(boundary) OVER w AS pb, lag(granularity) OVER w AS pg, lag(retention_days) OVER w AS pr FROM hops
   WINDOW w AS (PARTITION BY feature_id ORDER BY hop)),
 rk AS (SELECT * FROM (VALUES ('LOCAL', 0), ('SHUFFLE', 1), ('CENTRAL', 2)) t(b, br)),
 gk AS (SELECT * FROM (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) t(g, gr))"""


def hops(spark, sf):
    per_hop = (
        tables.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("feature_id"), F.col("l_linenumber").alias("hop"))
        .agg(F.min("l_returnflag").alias("f"), F.max("l_quantity").alias("q"))
    )
    return per_hop.select(
        "feature_id",
        "hop",
        F.when(F.col("f") == "N", "LOCAL").when(F.col("f") == "R", "SHUFFLE").otherwise("CENTRAL").alias("boundary"),
        F.when(F.col("q") < 17, "ITEM").when(F.col("q") < 34, "CLUSTER").otherwise("AGGREGATE").alias("granularity"),
        F.floor(F.col("q") * 2).alias("retention_days"),
    )


@query(
    "lineage_records",
    """WITH rec AS (SELECT l_partkey AS feature_id, year(l_shipdate) AS contract_version, l_returnflag, l_linestatus, CASE WHEN l_quantity < 25 THEN 'ITEM' ELSE 'CLUSTER' END AS g FROM lineitem)
SELECT feature_id, contract_version::BIGINT AS contract_version, count(DISTINCT l_returnflag || l_linestatus || g) AS variants FROM rec GROUP BY ALL HAVING count(DISTINCT l_returnflag || l_linestatus || g) > 1""",
)
def lineage_records(spark, sf):
    """Contract versions (part and year) with more than one distinct lineage record."""
    records = tables.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("feature_id"),
        F.year("l_shipdate").cast("bigint").alias("contract_version"),
        F.col("l_returnflag").alias("source_boundary"),
        F.col("l_linestatus").alias("materialization_boundary"),
        F.when(F.col("l_quantity") < 25, "ITEM").otherwise("CLUSTER").alias("granularity"),
        F.lit(30).alias("retention_days"),
    )
    return gov.lineage_conflicts(records).filter("variants > 1")


@query(
    "inv_no_escalation",
    f"""WITH {HOPS}, permit AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT feature_id, hop, pb AS prev_boundary, boundary, CASE WHEN b.br < a.br THEN 'REVERSE_FLOW' ELSE 'NO_CONTRACT_FOR_HOP' END AS violation
FROM pairs JOIN rk a ON pb = a.b JOIN rk b ON boundary = b.b
WHERE b.br < a.br OR (b.br > a.br AND NOT (boundary = 'CENTRAL' AND feature_id IN (SELECT o_orderkey FROM permit)))""",
)
def inv_no_escalation(spark, sf):
    """Orders with status F hold a contract for every hop into CENTRAL."""
    orders = tables.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("feature_id"))
    permits = orders.withColumn("prev_boundary", F.explode(F.array(F.lit("LOCAL"), F.lit("SHUFFLE")))).withColumn(
        "boundary", F.lit("CENTRAL")
    )
    v = gov.boundary_escalations(gov.hop_pairs(hops(spark, sf)), permits)
    return v.select("feature_id", "hop", "prev_boundary", "boundary", "violation")


@query(
    "inv_granularity_monotone",
    f"WITH {HOPS} SELECT feature_id, hop, pg AS prev_granularity, granularity FROM pairs JOIN gk a ON pg = a.g JOIN gk b ON granularity = b.g WHERE b.gr < a.gr",
)
def inv_granularity_monotone(spark, sf):
    return gov.granularity_refinements(gov.hop_pairs(hops(spark, sf))).select(
        "feature_id", "hop", "prev_granularity", "granularity"
    )


@query("inv_retention", f"WITH {HOPS} SELECT feature_id, hop, pr AS prev_retention_days, retention_days FROM pairs WHERE retention_days > pr")
def inv_retention(spark, sf):
    return gov.retention_increases(gov.hop_pairs(hops(spark, sf))).select(
        "feature_id", "hop", "prev_retention_days", "retention_days"
    )


@query(
    "inv_join_safety",
    """WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linestatus = 'F' AS same_boundary, p_size <= 30 AS permitted FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT permitted, same_boundary, count(*) AS n FROM j WHERE NOT (permitted AND same_boundary) GROUP BY ALL""",
)
def inv_join_safety(spark, sf):
    """Joins of line items that their part's contract does not permit, or that leave the boundary."""
    permitted = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") <= 30).alias("permitted"))
    joined = tables.table(spark, sf, "lineitem").select(
        "l_partkey", (F.col("l_linestatus") == "F").alias("same_boundary")
    ).join(permitted, "l_partkey")
    bad = joined.filter(~(F.col("permitted") & F.col("same_boundary")))
    return bad.groupBy("permitted", "same_boundary").agg(F.count("*").alias("n"))


@query(
    "missing_lineage_block",
    "SELECT o_orderkey AS feature_id, o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS blocked FROM orders",
)
def missing_lineage_block(spark, sf):
    """Orders without a single lineage record are blocked from being materialised."""
    known = tables.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("feature_id"))
    return gov.lineage_block(tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("feature_id")), known)


@query(
    "emergency_downgrade_check",
    f"""WITH {HOPS} SELECT feature_id, hop, CASE WHEN b.gr <= a.gr THEN 'NOT_COARSER' WHEN d.br > c.br THEN 'HIGHER_BOUNDARY' ELSE 'ALLOWED' END AS verdict
FROM pairs JOIN gk a ON pg = a.g JOIN gk b ON granularity = b.g JOIN rk c ON pb = c.b JOIN rk d ON boundary = d.b""",
)
def emergency_downgrade_check(spark, sf):
    pairs = gov.hop_pairs(hops(spark, sf)).selectExpr(
        "feature_id", "hop", "prev_granularity AS from_granularity", "granularity AS to_granularity",
        "prev_boundary AS from_boundary", "boundary AS to_boundary",
    )
    return gov.emergency_downgrades(pairs).select("feature_id", "hop", "verdict")


@query(
    "traceability",
    f"""WITH {cm.CONTRACTS}, rel AS (SELECT DISTINCT event_type AS feature_id, window_id AS contract_version, day_id FROM ev),
 c AS (SELECT feature_id, contract_version, boundary, CASE WHEN boundary = 'CENTRAL' THEN 'GAUSSIAN' END AS mechanism FROM contracts)
SELECT day_id, feature_id, contract_version, CASE WHEN boundary IS NULL THEN 'boundary,mechanism,granularity' WHEN mechanism IS NULL THEN 'mechanism' ELSE '' END AS missing
FROM rel LEFT JOIN c USING (feature_id, contract_version)""",
)
def traceability(spark, sf):
    """Daily releases against the contracts of their feature and version; SHUFFLE contracts carry no mechanism here."""
    releases = cm.weekly_events(spark, sf).select(
        F.col("event_type").alias("feature_id"), F.col("window_id").alias("contract_version"), "day_id"
    ).distinct()
    contracts = cm.contracts(spark, sf).withColumn("mechanism", F.when(F.col("boundary") == "CENTRAL", "GAUSSIAN"))
    return gov.untraceable(releases, contracts).select(
        "day_id", "feature_id", "contract_version", F.array_join("missing", ",").alias("missing")
    )


@query(
    "ttl_expiry",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE date_diff('day', l_shipdate::DATE, DATE '2002-01-01') > 365 + l_quantity",
)
def ttl_expiry(spark, sf):
    lines = tables.table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    gone = gov.expired(lines, "day", "2002-01-01", 365 + F.col("l_quantity"))
    return gone.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "audit_completeness",
    f"""WITH {cm.MESSAGES}, a AS (SELECT event_type, CASE WHEN k < 50 THEN 'rule_' || (k // 10) END AS rule_id, CASE WHEN value < 150 THEN 120.0 END AS threshold,
   CASE WHEN value > 120 THEN 'REJECT' ELSE 'ACCEPT' END AS outcome, CASE WHEN format <> 'sketch' THEN format END AS reason,
   value > 120 AND c_custkey IS NOT NULL AS leaked FROM msg LEFT JOIN customer ON contributor = c_custkey)
SELECT event_type, count(*) AS n, {R('avg(CASE WHEN rule_id IS NOT NULL AND threshold IS NOT NULL AND outcome IS NOT NULL AND reason IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS completeness,
  count(*) FILTER (leaked) AS n_leaks FROM a GROUP BY 1""",
)
def audit_completeness(spark, sf):
    """Filled fields of audit records, and records whose JSON names a customer (rejected rows here name the actor)."""
    people = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("contributor"), "c_name")
    actor = F.when(F.col("value") > 120, F.col("c_name"))
    audit = cm.messages(spark, sf).join(people, "contributor", "left").select(
        "event_id",
        "event_type",
        F.when(F.col("k") < 50, F.concat(F.lit("rule_"), F.floor(F.col("k") / 10))).alias("rule_id"),
        F.when(F.col("value") < 150, 120.0).alias("threshold"),
        F.when(F.col("value") > 120, "REJECT").otherwise("ACCEPT").alias("outcome"),
        F.when(F.col("format") != "sketch", F.col("format")).alias("reason"),
        F.to_json(F.struct(F.col("format").alias("protocol"), F.struct(actor.alias("actor")).alias("seen"))).alias("details_json"),
    )
    salt = cm.CONTRACT.secret
    hits = gates.identifier_hits(audit, ["event_id"], ["rule_id", "reason", "details_json"], gates.identifier_hashes(people, "c_name", salt), salt)
    flagged = audit.join(hits.select("event_id").distinct().withColumn("_hit", F.lit(True)), "event_id", "left")
    marked = flagged.withColumn("leaked", F.coalesce("_hit", F.lit(False)))
    done = gov.audit_completeness(marked, ["rule_id", "threshold", "outcome", "reason"], ["event_type"])
    return done.withColumn("completeness", r(F.col("completeness")))


@query(
    "replay_check",
    f"""WITH {DECIDE} SELECT 'replay' AS comparison, 'MATCH' AS verdict, count(*) AS n, true AS same_plan FROM dec
UNION ALL SELECT 'tampered', CASE WHEN p_size = 50 AND boundary <> 'LOCAL' THEN 'MISMATCH' ELSE 'MATCH' END, count(*), true FROM dec GROUP BY ALL""",
)
def replay_check(spark, sf):
    """The decision job run twice, stored twice and compared by fingerprint; then against a run with changed rows."""
    folder = run_folder(spark, "replay")
    delete_at_exit(spark, folder)
    key, columns = ["feature_id"], ["feature_id", "boundary", "granularity", "feasible", "reason", "p_size"]
    plan = pc.policy_hash(TH)
    for run in ("first", "again"):
        replay.record_run(decisions(spark, sf).select(*columns), folder, run, key, plan)
    like = decisions(spark, sf).select(*columns)
    stored = replay.rows_of(spark, folder, "again", like).drop("part")
    changed = stored.withColumn("boundary", F.when(F.col("p_size") == 50, "LOCAL").otherwise(F.col("boundary")))
    replay.record_run(changed, folder, "changed", key, plan)
    out = None
    for name, second in (("replay", "again"), ("tampered", "changed")):
        parts = replay.compare_runs(spark, folder, "first", second).agg(F.sum("n_first").alias("n"), F.bool_and("same_plan").alias("same_plan"))
        odd = replay.differing_rows(spark, folder, "first", second, key, like).groupBy("verdict").agg(F.count("*").alias("n"))
        agreed = parts.select(F.lit("MATCH").alias("verdict"), (F.col("n") - F.coalesce(odd.agg(F.sum("n")).scalar(), F.lit(0))).alias("n"))
        rows = agreed.unionByName(odd).crossJoin(parts.select("same_plan"))  # a row beside a handful of verdicts
        rows = rows.select(F.lit(name).alias("comparison"), "verdict", "n", "same_plan").filter("n > 0")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "score_reproducibility",
    """SELECT l_partkey AS snapshot_id, l_suppkey AS policy_version, count(*) AS evaluations, count(DISTINCT l_returnflag) AS outcomes FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1""",
)
def score_reproducibility(spark, sf):
    """Inputs (snapshot, policy version) that led to more than one result."""
    runs = tables.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("snapshot_id"), F.col("l_suppkey").alias("policy_version"), "l_returnflag"
    )
    return gov.consistency(runs, ["snapshot_id", "policy_version"], "l_returnflag").filter("outcomes > 1")


@query(
    "contract_drift_reject",
    f"""WITH {cm.CONTRACTS} SELECT event_id FROM ev e WHERE NOT EXISTS (SELECT 1 FROM contracts c WHERE c.feature_id = e.event_type AND c.contract_version = e.window_id AND c.granularity <> 'AGGREGATE')""",
)
def contract_drift_reject(spark, sf):
    """Events whose version is not a registered contract above AGGREGATE."""
    live = cm.contracts(spark, sf).filter("granularity <> 'AGGREGATE'").select("feature_id", "contract_version")
    ev = cm.weekly_events(spark, sf).select(
        "event_id", F.col("event_type").alias("feature_id"), F.col("window_id").alias("contract_version")
    )
    return ev.join(live, ["feature_id", "contract_version"], "left_anti").select("event_id")


@query(
    "lineage_risk_floor",
    f"""WITH RECURSIVE own AS (SELECT p_partkey AS id, p_size / 50.0 AS risk, p_type FROM part),
 edge AS (SELECT id AS child, id // 3 AS parent FROM own WHERE id > 0 UNION SELECT id, id // 5 FROM own WHERE id > 4 AND p_type = 'PROMO'),
 anc AS (SELECT id, id AS a FROM own UNION SELECT anc.id, edge.parent FROM anc JOIN edge ON anc.a = edge.child)
SELECT anc.id AS feature_id, {R('max(risk)')} AS risk_floor FROM anc JOIN own ON own.id = anc.a GROUP BY 1""",
)
def lineage_risk_floor(spark, sf):
    """Each part derives from the part at a third of its key, promo parts also from the one at a fifth."""
    part = tables.table(spark, sf, "part")
    own = part.select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") / 50.0).alias("risk"))
    key = F.col("p_partkey")
    third = part.filter("p_partkey > 0").select(key.alias("child"), F.floor(key / 3).alias("parent"))
    fifth = part.filter("p_partkey > 4 AND p_type = 'PROMO'").select(key.alias("child"), F.floor(key / 5).alias("parent"))
    floors = lineage.inherit_floor(own, third.unionByName(fifth))
    return floors.select("feature_id", r(F.col("floor")).alias("risk_floor"))


@query(
    "family_penalty",
    f"""WITH s AS (SELECT p_partkey, p_brand, p_size / 100.0 AS risk, p_type IN ('PROMO', 'SMALL') AS sensitive FROM part),
 n AS (SELECT p_brand, count(*) FILTER (sensitive) AS n FROM s GROUP BY 1)
SELECT p_partkey, {R('least(1.0, risk + greatest(0, n - 1) * 0.005)')} AS risk FROM s JOIN n USING (p_brand)""",
)
def family_penalty(spark, sf):
    out = lineage.family_penalty(_families(spark, sf), "p_brand", 0.005)
    return out.select("p_partkey", r(F.col("risk")).alias("risk"))


def _families(spark, sf):
    return tables.table(spark, sf, "part").select(
        "p_partkey", "p_brand", "p_type", (F.col("p_size") / 100.0).alias("risk"), F.col("p_type").isin("PROMO", "SMALL").alias("sensitive")
    )


@query(
    "domain_budget",
    f"SELECT p_type, {R('sum(p_size / 100.0)', 2)} AS total_risk, round(sum(p_size / 100.0), 9) > 85 AS over_budget FROM part GROUP BY 1",
)
def domain_budget(spark, sf):
    return lineage.domain_budget(_families(spark, sf), "p_type", 85.0).withColumn("total_risk", r(F.col("total_risk"), 2))


@query("staging_ttl", f"WITH {STAGED} SELECT window_id, count(*) AS n_cells FROM staged WHERE date_diff('day', window_id::DATE, DATE '2024-02-01') > 14 GROUP BY 1")
def staging_ttl(spark, sf):
    """Staged windows past their two-week lifetime."""
    old = gov.expired(staged_events(spark, sf).withColumn("day", F.col("window_id").cast("date")), "day", "2024-02-01", F.lit(14))
    return old.groupBy("window_id").agg(F.count("*").alias("n_cells"))
