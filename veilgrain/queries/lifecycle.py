"""From the catalog to the ledger: parts are scored and routed, get contracts, and their shipments are released by them."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from veilgrain.operators import ledger as lg
from veilgrain.operators import lifecycle as lc
from veilgrain.plans import contracts as pc
from veilgrain.queries import common as cm
from veilgrain.queries.catalog import catalog
from veilgrain.queries.registry import GAUSS, R, U, query, r, sized
from veilgrain.queries.scoring import DECIDE, decisions
from veilgrain.session import store
from veilgrain.sources import tables

POLICY = dataclasses.replace(cm.CONTRACT, k_min=2, metrics=("COUNT",))
EPS_CAP, DELTA_CAP = 5.0, 1e-4
SECRET = f"'{POLICY.secret}'"

# years of returned shipments were released before at 0.1 each; items are a flag and a month, clusters a flag
PATH = f"""{DECIDE}, con AS (SELECT feature_id, boundary, CASE granularity WHEN 'ITEM' THEN 0 WHEN 'CLUSTER' THEN 1 ELSE 2 END AS g0,
   'c_' || feature_id || '_1706745600' AS contract_version FROM dec WHERE feasible),
 shp AS (SELECT 'f_' || l_partkey AS feature_id, o_custkey AS contributor, strftime(l_shipdate, '%Y') AS window_id,
   l_returnflag || '|' || strftime(l_shipdate, '%m') AS item, l_returnflag AS cluster FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 chk AS (SELECT shp.*, contract_version, g0, CASE WHEN con.feature_id IS NULL THEN 'NO_CONTRACT' WHEN boundary <> 'CENTRAL' THEN 'BOUNDARY_MISMATCH' END AS reason
   FROM shp LEFT JOIN con USING (feature_id)),
 per AS (SELECT feature_id, contract_version, g0, window_id, contributor, level, lvl,
   CASE lvl WHEN 0 THEN item WHEN 1 THEN cluster ELSE 'all' END AS cell, least(2, count(*)) AS n
   FROM chk, (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) l(level, lvl) WHERE reason IS NULL GROUP BY ALL),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, contributor, window_id, level
   ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM per) WHERE c0 <= 8),
 staged AS (SELECT feature_id, contract_version, g0, window_id, level, lvl, cell, sum(n) AS event_count, count(*) AS cc FROM l0 GROUP BY ALL),
 pick AS (SELECT feature_id, contract_version, window_id, g0, min(lvl) FILTER (lvl >= g0 AND m >= 2) AS lvl
   FROM (SELECT feature_id, contract_version, window_id, g0, lvl, min(cc) AS m FROM staged GROUP BY ALL) GROUP BY ALL),
 old AS (SELECT 'f_' || l_partkey AS feature_id, 0.1::DOUBLE * count(DISTINCT year(l_shipdate)) AS eps FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
 pri AS (SELECT pick.*, coalesce(eps, 0) + coalesce(count(lvl) OVER (PARTITION BY feature_id ORDER BY window_id
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM pick LEFT JOIN old USING (feature_id)),
 res AS (SELECT *, CASE WHEN lvl IS NULL OR round(spent + 1, 12) > {EPS_CAP} THEN 'BLOCK' WHEN lvl = g0 THEN 'MATERIALIZE' ELSE 'DOWNGRADE' END AS outcome,
   CASE WHEN lvl IS NULL THEN 'MIN_SUPPORT_FAIL' WHEN round(spent + 1, 12) > {EPS_CAP} THEN 'BUDGET_EXHAUSTED' WHEN lvl > g0 THEN 'MIN_SUPPORT_FAIL' END AS reason FROM pri)"""


def prior_spends(spark, sf):
    returned = tables.table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    years = returned.select(F.concat(F.lit("f_"), "l_partkey").alias("feature_id"), F.year("l_shipdate").alias("y")).distinct()
    return lg.ledger_rows(
        years.select(
            "feature_id", F.lit("c0").alias("contract_version"), F.lit("CENTRAL").alias("boundary"),
            F.lit("AGGREGATE").alias("granularity"), F.lit("user").alias("privacy_unit"),
            F.make_date("y", F.lit(12), F.lit(31)).alias("window_day"), F.lit(0.1).alias("epsilon_spend"),
        )
    )


def bundles(spark, sf):
    keys = F.when(F.col("granularity") == "ITEM", F.array(F.lit("item_id"))).when(
        F.col("granularity") == "CLUSTER", F.array(F.lit("cluster_id"))
    )
    # stored, as decisions are: read in one plan with the contracts, each use of a level would repeat all scores
    decided = store(decisions(spark, sf).select("feature_id", "boundary", "granularity", "feasible"), "decisions")
    routed = decided.filter("feasible").select(
        "feature_id", F.col("boundary").alias("selected_boundary"), F.col("granularity").alias("selected_granularity"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("aggregation_keys"),
    )
    specs = catalog(spark, sf).select("feature_id", "fields", "bucketizations")
    issued = pc.issue_contracts(routed, "1706745600").filter("active")
    return pc.contract_bundles(issued, specs, POLICY)


def path(spark, sf):
    """Checked items, staging and outcomes of all contracts."""
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    orders = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("contributor"))
    shipped = lines.join(orders, "l_orderkey").select(
        F.concat(F.lit("f_"), "l_partkey").alias("feature_id"), "contributor", "l_returnflag",
        F.date_format("l_shipdate", "yyyy").alias("window_id"), F.date_format("l_shipdate", "MM").alias("month"),
    )
    contracts = bundles(spark, sf)
    item = F.concat_ws("|", "l_returnflag", "month")
    checked = lc.checked_items(shipped, item, F.col("l_returnflag"), contracts, "CENTRAL")
    staged = lc.staging(checked, POLICY)
    return checked, staged, lc.outcomes(staged, contracts, prior_spends(spark, sf), EPS_CAP, DELTA_CAP)


SD = "(sqrt(2.0 * ln(1.25 / 1e-6)) * 2 * sqrt(8))"
NOISED = f"greatest(0.0, event_count + {SD} * {GAUSS(SECRET, 'feature_id', 'contract_version', 'window_id', 'level', 'cell', repr('COUNT'))})"


@query(
    "lifecycle_release",
    f"""WITH {PATH} SELECT feature_id, contract_version, window_id, level, cell, {R(NOISED)} AS dp_event_count, {R(f'{SD} * {SD}')} AS variance,
  1.0::DOUBLE AS epsilon FROM staged JOIN (SELECT feature_id, window_id, lvl FROM res WHERE outcome <> 'BLOCK') USING (feature_id, window_id, lvl)""",
)
@sized
def lifecycle_release(spark, sf):
    _, staged, decided = path(spark, sf)
    out = lc.released(staged, decided, POLICY)
    return out.select(
        *lc.CELL, "level", "cell", r(F.col("dp_event_count")).alias("dp_event_count"),
        r(F.col("variance")).alias("variance"), "epsilon",
    )


@query(
    "lifecycle_audit",
    f"""WITH {PATH} SELECT DISTINCT 'REJECT' AS event_type, feature_id, contract_version, window_id, reason FROM chk WHERE reason IS NOT NULL
UNION ALL SELECT outcome, feature_id, contract_version, window_id, reason FROM res""",
)
@sized
def lifecycle_audit(spark, sf):
    checked, _, decided = path(spark, sf)
    return lc.audit(checked, decided)


@query(
    "lifecycle_ledger",
    f"""WITH {PATH} SELECT feature_id, contract_version, CASE lvl WHEN 0 THEN 'ITEM' WHEN 1 THEN 'CLUSTER' ELSE 'AGGREGATE' END AS granularity,
  make_date(window_id::BIGINT, 12, 31) AS window_day, 1.0::DOUBLE AS epsilon_spend, 1e-6::DOUBLE AS delta_spend FROM res WHERE outcome <> 'BLOCK'""",
)
@sized
def lifecycle_ledger(spark, sf):
    _, _, decided = path(spark, sf)
    day = F.make_date(F.col("window_id").cast("int"), F.lit(12), F.lit(31))
    rows = lc.spends(decided, day, "CENTRAL")
    return rows.select("feature_id", "contract_version", "granularity", "window_day", "epsilon_spend", "delta_spend")
