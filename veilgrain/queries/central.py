"""Central release and contribution bounding (SURVEY 2.6)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from veilgrain.functions import noise
from veilgrain.operators import bounding, central
from veilgrain.operators import ledger as lg
from veilgrain.operators import transforms as tr
from veilgrain.queries import common as cm
from veilgrain.queries.aggregates import STAGED, click_cells, staged_events
from veilgrain.queries.registry import GAUSS, GEOM, LAPLACE, R, U, query, r, sized
from veilgrain.schema import ReleaseContract

C = cm.CONTRACT
SECRET = f"'{C.secret}'"
NAMED = (SECRET, f"'{C.contract_id}'", f"'{C.feature_id}'", "'v1'")
KEY = (*NAMED, "window_id", "level", "cell")
LEVELS = STAGED + """, pick AS (SELECT window_id, min(lvl) AS lvl FROM (SELECT window_id, lvl, min(contributors_count) AS m FROM staged GROUP BY ALL) WHERE m >= 20 GROUP BY 1),
 chosen AS (SELECT staged.* FROM staged JOIN pick USING (window_id, lvl))"""

# user-level bounding: at most 8 cells per contributor, week and level
BOUNDED = (
    cm.LADDER
    + f""", capped AS (SELECT *, greatest(0.0, least(200.0, value)) AS v FROM (SELECT *, row_number() OVER (
    PARTITION BY contributor, window_id, level, cell ORDER BY ts, event_id) AS rn FROM lad) WHERE rn <= 2),
 per AS (SELECT contributor, window_id, level, lvl, cell, count(*) AS n, sum(v) AS s FROM capped GROUP BY ALL),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level
    ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM per) WHERE c0 <= 8),
 staged AS (SELECT window_id, level, lvl, cell, sum(n)::BIGINT AS event_count, sum(s) AS value_sum, count(*) AS contributors_count FROM l0 GROUP BY ALL),
 pick AS (SELECT window_id, min(lvl) AS lvl FROM (SELECT window_id, lvl, min(contributors_count) AS m FROM staged GROUP BY ALL) WHERE m >= 20 GROUP BY 1),
 chosen AS (SELECT staged.* FROM staged JOIN pick USING (window_id, lvl))"""
)
L2 = "(2*sqrt(8))"
SIG = "sqrt(2 * ln(1.25 / 1e-6))"  # classic multiplier at epsilon 1, delta 1e-6
CTR_SIGMA = 4.0
MEAN_CAP = 1  # a contributor weighs one row in a cell's mean
CTR_SD = "(4.0 * sqrt(8))"  # noise multiplier times the sensitivity of means


def bounded(spark, sf):
    return central.bounded_staging(cm.weekly_events(spark, sf), cm.item_cell(), cm.cluster_cell(), C)


def chosen(spark, sf):
    return central.downgrade_feature(bounded(spark, sf), ["window_id"], C.k_min)


@query(
    "contribution_cap",
    f"""WITH {cm.LADDER}, c AS (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level, cell ORDER BY ts, event_id) AS rn FROM lad)
SELECT event_id, level, cell FROM c WHERE rn <= 2""",
)
def contribution_cap(spark, sf):
    return bounding.contribution_cap(cm.laddered_events(spark, sf), 2).select("event_id", "level", "cell")


@query("l0_cell_cap", f"WITH {BOUNDED} SELECT contributor, window_id, level, cell, n::BIGINT AS n, {R('s', 2)} AS s FROM l0")
def l0_cell_cap(spark, sf):
    capped = bounding.contribution_cap(cm.laddered_events(spark, sf), C.cap)
    partials = bounding.contributor_partials(capped, C.lo, C.hi)
    return bounding.l0_cell_cap(partials, C.max_cells, C.secret).select(
        "contributor", "window_id", "level", "cell", "n", r(F.col("s"), 2).alias("s")
    )


@query("k_gate", f"WITH {STAGED} SELECT window_id, level, cell, contributors_count, contributors_count >= 20 AS passes FROM staged")
def k_gate(spark, sf):
    return central.k_gate(staged_events(spark, sf), C.k_min).select(
        "window_id", "level", "cell", "contributors_count", "passes"
    )


@query(
    "downgrade_feature",
    f"WITH {LEVELS} SELECT window_id, level, cell, event_count, {R('value_sum', 2)} AS value_sum, contributors_count FROM chosen",
)
def downgrade_feature(spark, sf):
    return central.downgrade_feature(staged_events(spark, sf), ["window_id"], C.k_min).select(
        "window_id", "level", "cell", "event_count", r(F.col("value_sum"), 2).alias("value_sum"), "contributors_count"
    )


@query(
    "downgrade_cell",
    f"""WITH {cm.SHIP}, p0 AS (SELECT window_id, p_brand, l_partkey, count(*) AS event_count, sum(value) AS s, count(DISTINCT contributor) AS cc FROM ship GROUP BY ALL),
 r1 AS (SELECT ship.* FROM ship JOIN p0 USING (window_id, p_brand, l_partkey) WHERE cc < 4),
 p1 AS (SELECT window_id, p_brand, count(*) AS event_count, sum(value) AS s, count(DISTINCT contributor) AS cc FROM r1 GROUP BY ALL),
 r2 AS (SELECT r1.* FROM r1 JOIN p1 USING (window_id, p_brand) WHERE cc < 4),
 p2 AS (SELECT window_id, count(*) AS event_count, sum(value) AS s, count(DISTINCT contributor) AS cc FROM r2 GROUP BY ALL)
SELECT window_id, 0 AS lvl, false AS residual, l_partkey::VARCHAR AS cell, cc AS contributors_count, event_count, {R('s', 2)} AS value_sum FROM p0 WHERE cc >= 4
UNION ALL SELECT window_id, 1, true, p_brand, cc, event_count, {R('s', 2)} FROM p1 WHERE cc >= 4
UNION ALL SELECT window_id, 2, true, 'all', cc, event_count, {R('s', 2)} FROM p2 WHERE cc >= 4""",
)
def downgrade_cell(spark, sf):
    """Part, brand and total per month: parts below four customers fall back to their brand's residual cell."""
    rows = cm.monthly_shipments(spark, sf).withColumn("everything", F.lit("all"))
    cells = central.downgrade_cells(
        rows, ["l_partkey", "p_brand", "everything"], 4, ["window_id"], "contributor", F.col("value")
    )
    return cells.withColumn("value_sum", r(F.col("value_sum"), 2))


@query("suppress", f"WITH {STAGED} SELECT window_id, level, cell, 'SUPPRESSED_BELOW_K' AS reason FROM staged WHERE contributors_count < 20")
def suppress(spark, sf):
    return central.suppressed(staged_events(spark, sf), C.k_min)


@query(
    "blocked_windows",
    f"""WITH {STAGED} SELECT window_id, max(m) AS min_support, 'MIN_SUPPORT_FAIL' AS reason FROM (
  SELECT window_id, lvl, min(contributors_count) AS m FROM staged WHERE lvl <= 1 GROUP BY ALL) GROUP BY 1 HAVING max(m) < 20""",
)
def blocked_windows(spark, sf):
    """Windows nothing can be released for when the contract stops at CLUSTER."""
    return central.blocked(staged_events(spark, sf), ["window_id"], C.k_min, coarsest=1)


@query(
    "sensitivity",
    f"""WITH {BOUNDED} SELECT level, max(r) AS rows_bound, {R('max(v)', 2)} AS value_bound, 16.0::DOUBLE AS l1_count, {R(L2)} AS l2_count, 3200.0::DOUBLE AS l1_sum FROM (
  SELECT contributor, window_id, level, sum(n)::BIGINT AS r, sum(s) AS v FROM l0 GROUP BY ALL) GROUP BY level""",
)
def sensitivity(spark, sf):
    """Largest contribution of one person after bounding, next to the bound the noise is scaled to."""
    capped = bounding.contribution_cap(cm.laddered_events(spark, sf), C.cap)
    partials = bounding.l0_cell_cap(bounding.contributor_partials(capped, C.lo, C.hi), C.max_cells, C.secret)
    per_person = partials.groupBy("contributor", "window_id", "level").agg(F.sum("n").alias("r"), F.sum("s").alias("v"))
    l1c, l2c = central.sensitivity("COUNT", C.cap, C.max_cells, C.lo, C.hi)
    l1s, _ = central.sensitivity("SUM", C.cap, C.max_cells, C.lo, C.hi)
    return per_person.groupBy("level").agg(
        F.max("r").alias("rows_bound"), r(F.max("v"), 2).alias("value_bound")
    ).withColumns({"l1_count": F.lit(l1c), "l2_count": r(F.lit(l2c)), "l1_sum": F.lit(l1s)})


# ---- mechanisms -------------------------------------------------------------------------------------------------
G_COUNT = f"greatest(0.0, event_count + {SIG} * {L2} * {GAUSS(*KEY, repr('COUNT'))})"
G_SUM = f"(value_sum + {SIG} * {L2} * 200.0 * {GAUSS(*KEY, repr('SUM'))})"


@query("dp_count", f"WITH {BOUNDED} SELECT window_id, level, cell, {R(G_COUNT)} AS dp_event_count FROM chosen")
def dp_count(spark, sf):
    return central.dp_metrics(chosen(spark, sf), C).select(
        "window_id", "level", "cell", r(F.col("dp_event_count")).alias("dp_event_count")
    )


@query("dp_sum", f"WITH {BOUNDED} SELECT window_id, level, cell, {R(G_SUM, 4)} AS dp_value_sum FROM chosen")
def dp_sum(spark, sf):
    return central.dp_metrics(chosen(spark, sf), C).select(
        "window_id", "level", "cell", r(F.col("dp_value_sum"), 4).alias("dp_value_sum")
    )


@query("dp_mean", f"WITH {BOUNDED} SELECT window_id, level, cell, {R(f'{G_SUM} / greatest(1.0, {G_COUNT})', 4)} AS dp_value_mean FROM chosen")
def dp_mean(spark, sf):
    return central.dp_metrics(chosen(spark, sf), C).select(
        "window_id", "level", "cell", r(F.col("dp_value_mean"), 4).alias("dp_value_mean")
    )


CTR = f"""{cm.EV}, per AS (SELECT window_id, 'ITEM' AS level, k AS cell, contributor, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c,
  sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) AS n FROM ev GROUP BY ALL),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level
    ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM per) WHERE c0 <= 8),
 ctr AS (SELECT window_id, cell, sum(c * least(1, n) / greatest(1, n)::DOUBLE) AS c, sum(least(1, n)) AS n FROM l0 GROUP BY ALL)"""


@query(
    "dp_mean_bounded01",
    f"""WITH {CTR} SELECT window_id, cell, {R('greatest(0.0, least(1.0, c / greatest(1, n) + ' + CTR_SD + ' / greatest(1, n) * ' + GAUSS(*NAMED, 'window_id', 'cell', "'ctr'") + '))')} AS dp_ctr FROM ctr""",
)
def dp_mean_bounded01(spark, sf):
    """Click rate per week and item; a contributor weighs one impression in each of at most ``max_cells`` items."""
    per = click_cells(cm.weekly_events(spark, sf), ["window_id", F.lit("ITEM").alias("level"), F.col("k").alias("cell"), "contributor"])
    per = bounding.scaled_to_cap(per, MEAN_CAP, "impressions", ["clicks"])
    per = bounding.l0_cell_cap(per, C.max_cells, C.secret, digest=C.digest)
    cells = per.groupBy("window_id", "cell").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    mean = F.col("clicks") / F.greatest(F.lit(1), F.col("impressions"))
    sd = CTR_SIGMA * central.mean_sensitivity(MEAN_CAP, C.max_cells)
    key = (C.secret, C.contract_id, C.feature_id, C.contract_version, F.col("window_id"), F.col("cell"), "ctr")
    value = central.dp_mean_bounded01(mean, F.col("impressions"), sd, *key, digest=C.digest)
    return cells.select("window_id", "cell", r(value).alias("dp_ctr"))


@query(
    "dp_hist",
    f"""WITH {cm.EV}, per AS (SELECT day_id AS window_id, event_type, CAST(least(7, floor(value / 50)) AS INT)::VARCHAR AS bin, contributor, least(2, count(*)) AS m FROM ev GROUP BY ALL),
 named AS (SELECT *, 'BIN' AS level, event_type || '|' || bin AS cell FROM per),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level
    ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM named) WHERE c0 <= 8),
 n AS (SELECT window_id, event_type, bin AS cell, sum(m)::BIGINT AS c FROM l0 GROUP BY ALL),
 d AS (SELECT window_id, event_type, unnest(['0', '1', '2', '3', '4', '5', '6', '7']) AS cell FROM (SELECT DISTINCT window_id, event_type FROM n)),
 h AS (SELECT d.*, coalesce(c, 0) AS event_count FROM d LEFT JOIN n USING (window_id, event_type, cell))
SELECT window_id, event_type, cell, {R(f"greatest(0.0, event_count + {LAPLACE('16.0', *NAMED, 'window_id', 'event_type', 'cell', repr('HIST'))})")} AS dp_event_count FROM h""",
)
def dp_hist(spark, sf):
    """Daily histogram of the value in eight public bins; empty bins are noised as well."""
    bucket = tr.numeric_bucket(F.col("value"), 0, 400, 8).cast("string")
    per = (
        cm.weekly_events(spark, sf)
        .groupBy(F.col("day_id").alias("window_id"), "event_type", bucket.alias("bin"), "contributor")
        .agg(F.least(F.lit(C.cap), F.count("*")).alias("n"))
        .withColumns({"level": F.lit("BIN"), "cell": F.concat_ws("|", "event_type", "bin")})
    )
    bounded_bins = bounding.l0_cell_cap(per, C.max_cells, C.secret, digest=C.digest)
    counts = bounded_bins.groupBy("window_id", "event_type", F.col("bin").alias("cell")).agg(F.sum("n").alias("event_count"))
    keys = ["window_id", "event_type"]
    grid = central.full_domain(counts, keys, "cell", [str(i) for i in range(8)])
    noised = central.add_noise(F.col("event_count"), "LAPLACE", "HIST", C, [F.col(c) for c in (*keys, "cell")])
    return grid.select(*keys, "cell", r(F.greatest(F.lit(0.0), noised)).alias("dp_event_count"))


@query("mech_gaussian", f"WITH {cm.EV} SELECT event_id, {R('3.0 * ' + GAUSS(SECRET, 'event_id'))} AS noise FROM ev")
def mech_gaussian(spark, sf):
    return cm.weekly_events(spark, sf).select(
        "event_id", r(3.0 * noise.gaussian(C.secret, F.col("event_id"))).alias("noise")
    )


@query("mech_laplace", f"WITH {cm.EV} SELECT event_id, {R(LAPLACE('2.0', SECRET, 'event_id'))} AS noise FROM ev")
def mech_laplace(spark, sf):
    return cm.weekly_events(spark, sf).select(
        "event_id", r(noise.laplace(F.lit(2.0), C.secret, F.col("event_id"))).alias("noise")
    )


@query("mech_discrete", f"WITH {cm.EV} SELECT event_id, CAST({GEOM('exp(-0.5)', SECRET, 'event_id')} AS BIGINT) AS noise FROM ev")
def mech_discrete(spark, sf):
    alpha = F.exp(F.lit(-0.5))
    return cm.weekly_events(spark, sf).select(
        "event_id", noise.two_sided_geometric(alpha, C.secret, F.col("event_id")).alias("noise")
    )


@query(
    "calibrate_sigma",
    f"""WITH {BOUNDED} SELECT window_id, level, count(*) AS n_cells, {R('sqrt(2 * ln(1.25 / 1e-6)) / 1.0')} AS multiplier, {R(f'sqrt(2 * ln(1.25 / 1e-6)) / 1.0 * {L2}')} AS sd
FROM chosen GROUP BY ALL""",
)
def calibrate_sigma(spark, sf):
    multiplier = central.multiplier(C)
    sd = central.noise_sd("GAUSSIAN", "COUNT", C)
    return chosen(spark, sf).groupBy("window_id", "level").agg(F.count("*").alias("n_cells")).withColumns(
        {"multiplier": r(F.lit(multiplier)), "sd": r(F.lit(sd))}
    )


SD = f"({SIG} * {L2})"


@query(
    "uncertainty",
    f"""WITH {BOUNDED} SELECT window_id, level, cell, {R(f'{SD} * {SD}')} AS variance, {R(f'{G_COUNT} - 1.959964 * {SD}')} AS ci_lower, {R(f'{G_COUNT} + 1.959964 * {SD}')} AS ci_upper FROM chosen""",
)
def uncertainty(spark, sf):
    noised = central.dp_metrics(chosen(spark, sf), C)
    out = central.with_uncertainty(noised, "dp_event_count", central.noise_sd("GAUSSIAN", "COUNT", C))
    return out.select("window_id", "level", "cell", *[r(F.col(c)).alias(c) for c in ("variance", "ci_lower", "ci_upper")])


RELEASE = f"""SELECT window_id, level, cell, {R(G_COUNT)} AS dp_event_count, {R(G_SUM, 4)} AS dp_value_sum, 'c_events' AS contract_id, 'v1' AS contract_version,
  'events_weekly' AS feature_id, 'GAUSSIAN' AS mechanism_type, 1.0::DOUBLE AS epsilon, 1e-6::DOUBLE AS delta, 16.0::DOUBLE AS sensitivity_l1, 1706745600000::BIGINT AS release_ts_ms FROM chosen"""


def released(spark, sf):
    return central.release(bounded(spark, sf), C, 1706745600000)


def published(df, dims=()):
    return df.select(
        "window_id", "level", "cell", *dims, r(F.col("dp_event_count")).alias("dp_event_count"),
        r(F.col("dp_value_sum"), 4).alias("dp_value_sum"), "contract_id", "contract_version", "feature_id",
        "mechanism_type", "epsilon", "delta", "sensitivity_l1", "release_ts_ms",
    )


@query("release_provenance", f"WITH {BOUNDED} {RELEASE}")
def release_provenance(spark, sf):
    return published(released(spark, sf))


@query(
    "materialize_active",
    f"""WITH {cm.CONTRACTS}, act AS (SELECT feature_id, max(contract_version) AS contract_version, max_by(boundary, contract_version) AS boundary,
    CASE max_by(granularity, contract_version) WHEN 'ITEM' THEN 0 WHEN 'CLUSTER' THEN 1 ELSE 2 END AS pref FROM contracts GROUP BY 1),
 lad AS (SELECT ev.*, l.level, l.lvl, CASE lvl WHEN 0 THEN event_type || '|' || k WHEN 1 THEN event_type || '|' || (k // 10) ELSE 'all' END AS cell
   FROM ev, (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) l(level, lvl)),
 per AS (SELECT event_type AS feature_id, window_id, level, lvl, cell, contributor, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS y FROM lad GROUP BY ALL),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_id, contributor, window_id, level
    ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM per) WHERE c0 <= 8),
 c AS (SELECT feature_id, window_id, level, lvl, cell, sum(y) AS clicks, count(*) AS impressions, count(*) AS cc FROM l0 GROUP BY ALL),
 j AS (SELECT c.*, contract_version, pref FROM c JOIN act USING (feature_id) WHERE boundary = 'CENTRAL' AND lvl >= pref),
 p AS (SELECT feature_id, window_id, min(lvl) AS lvl FROM (SELECT feature_id, window_id, lvl FROM j GROUP BY ALL HAVING min(cc) >= 20) GROUP BY ALL)
SELECT feature_id, contract_version, window_id, level, cell,
  {R('greatest(0.0, least(1.0, clicks / greatest(1, impressions) + ' + CTR_SD + ' / greatest(1, impressions) * ' + GAUSS(SECRET, 'feature_id', 'contract_version', 'window_id', 'level', 'cell', "'ctr'") + '))')} AS ctr
FROM j JOIN p USING (feature_id, window_id, lvl)""",
)
def materialize_active(spark, sf):
    """High-value rate of every event type under its own contract, all in one job."""
    ev = cm.weekly_events(spark, sf).withColumn("feature_id", F.col("event_type"))
    keys = ["feature_id", "window_id"]
    items = ev.groupBy(*keys, cm.item_cell().alias("_item"), cm.cluster_cell().alias("_cluster"), "contributor").agg(
        F.count("*").alias("n"), F.sum(cm.high_value()).alias("y")
    )
    per = bounding.scaled_to_cap(tr.roll_up(items, [*keys, "contributor"], ["n", "y"]), MEAN_CAP, "n", ["y"])
    per = bounding.l0_cell_cap(per, C.max_cells, C.secret, ["feature_id"], C.digest)
    cells = per.groupBy(*keys, "level", "lvl", "cell").agg(
        F.sum("y").alias("clicks"), F.sum("n").alias("impressions"), F.count("*").alias("contributors")
    )
    latest = cm.contracts(spark, sf).groupBy("feature_id").agg(
        F.max_by(F.struct("boundary", "granularity", "contract_version"), "contract_version").alias("c")
    ).select("feature_id", "c.*")
    contracts = latest.withColumns(
        {
            "active": F.lit(True),
            "sigma": F.lit(CTR_SIGMA),
            "lvl_preferred": F.when(F.col("granularity") == "ITEM", 0).when(F.col("granularity") == "CLUSTER", 1).otherwise(2),
        }
    )
    out = central.materialize_active(cells, contracts, "CENTRAL", C.k_min, C.secret, MEAN_CAP, C.max_cells, C.digest)
    return out.withColumn("ctr", r(F.col("ctr")))


@query(
    "commit_spend",
    f"""WITH {BOUNDED} SELECT DISTINCT 'events_weekly' AS feature_id, 'v1' AS contract_version, 'CENTRAL' AS boundary, level AS granularity, 'user' AS privacy_unit,
  CAST(window_id AS DATE) AS window_day, 'BASIC' AS accountant, 2.0::DOUBLE AS epsilon_spend, 2e-6::DOUBLE AS delta_spend, 'COMMITTED' AS status FROM chosen""",
)
def commit_spend(spark, sf):
    """Ledger rows of the released weeks; count and sum each spend the contract's epsilon and delta."""
    rel = released(spark, sf).select(
        "feature_id", F.col("level").alias("granularity"), F.col("window_id").cast("date").alias("window_day")
    )
    return lg.commit_spend(rel, C.epsilon * len(C.metrics), C.delta * len(C.metrics), "CENTRAL", C.contract_version).drop("created_at")


# ---- the same release over shipments, the larger table ----------------------------------------------------------
SHIP_C = ReleaseContract(
    secret=C.secret, digest=C.digest, contract_id="c_shipments", feature_id="shipments_monthly", cap=2, max_cells=8,
    lo=0.0, hi=50000.0, k_min=25,
)
SHIP_STAGED = f"""{cm.SHIP}, lad AS (SELECT ship.*, level, lvl, CASE lvl WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN p_brand ELSE 'all' END AS cell
   FROM ship, (VALUES ('ITEM', 0), ('CLUSTER', 1), ('AGGREGATE', 2)) l(level, lvl)),
 capped AS (SELECT * FROM (SELECT *, greatest(0.0, least(50000.0, value)) AS v, row_number() OVER (PARTITION BY contributor, window_id, level, cell
   ORDER BY l_shipdate, l_orderkey, l_linenumber, value, l_partkey) AS rn FROM lad) WHERE rn <= 2),
 per AS (SELECT contributor, window_id, level, lvl, cell, count(*) AS n, sum(v) AS s FROM capped GROUP BY ALL),
 l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level
    ORDER BY {U(SECRET, 'contributor', 'window_id', 'level', 'cell')}, cell) AS c0 FROM per) WHERE c0 <= 8),
 staged AS (SELECT window_id, level, lvl, cell, sum(n)::BIGINT AS event_count, sum(s) AS value_sum, count(*) AS contributors_count FROM l0 GROUP BY ALL),
 pick AS (SELECT window_id, min(lvl) AS lvl FROM (SELECT window_id, lvl, min(contributors_count) AS m FROM staged GROUP BY ALL) WHERE m >= 25 GROUP BY 1)"""
SHIP_KEY = (SECRET, f"'{SHIP_C.contract_id}'", f"'{SHIP_C.feature_id}'", "'v1'", "window_id", "level", "cell")
SHIP_COUNT = R(f"greatest(0.0, event_count + {SIG} * {L2} * {GAUSS(*SHIP_KEY, repr('COUNT'))})")
SHIP_SUM = R(f"value_sum + {SIG} * {L2} * 50000.0 * {GAUSS(*SHIP_KEY, repr('SUM'))}", 2)


def _ship_cells():
    return F.col("l_partkey").cast("string"), F.col("p_brand")


@query(
    "release_shipments",
    f"WITH {SHIP_STAGED} SELECT window_id, level, cell, {SHIP_COUNT} AS dp_event_count FROM staged JOIN pick USING (window_id, lvl)",
)
@sized
def release_shipments(spark, sf):
    """Monthly shipment counts. Only counts are released, so nothing is ranked."""
    counts_only = dataclasses.replace(SHIP_C, metrics=("COUNT",))
    staged = central.bounded_staging(cm.monthly_shipments(spark, sf), *_ship_cells(), counts_only)
    out = central.release(staged, counts_only, 1706745600000)
    return out.select("window_id", "level", "cell", r(F.col("dp_event_count")).alias("dp_event_count"))


@query(
    "release_shipment_value",
    f"WITH {SHIP_STAGED} SELECT window_id, level, cell, {SHIP_COUNT} AS dp_event_count, {SHIP_SUM} AS dp_value_sum FROM staged JOIN pick USING (window_id, lvl)",
)
@sized
def release_shipment_value(spark, sf):
    """Counts and clipped values: the first two rows of a customer per cell decide, so rows are ranked."""
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "value", "l_partkey")
    staged = central.bounded_staging(cm.monthly_shipments(spark, sf), *_ship_cells(), SHIP_C, order)
    out = central.release(staged, SHIP_C, 1706745600000)
    return out.select(
        "window_id", "level", "cell", r(F.col("dp_event_count")).alias("dp_event_count"),
        r(F.col("dp_value_sum"), 2).alias("dp_value_sum"),
    )
