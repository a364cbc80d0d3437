"""Windows, ordering and drift over a monthly scorecard history of brands and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import bounding, gates, history, stats
from veilgrain.operators import transforms as tr
from veilgrain.queries import common as cm
from veilgrain.queries.registry import R, U, query, r
from veilgrain.sources import tables

HIST = """items AS (SELECT p_brand, strftime(l_shipdate, '%Y-%m') AS m, l_partkey, count(*) AS cnt, sum(l_discount) AS d,
    sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 h0 AS (SELECT p_brand AS feature_id, m AS computed_at, sum(cnt)::BIGINT AS n_obs, count(*) AS n_distinct, min(cnt) AS minsup,
    least(1.0, 10 * sum(d) / sum(cnt)) AS s_link, sum(ret) / sum(cnt) AS s_infer FROM items GROUP BY ALL),
 h AS (SELECT *, greatest(0.0, least(1.0, 1.0 - ln(1 + minsup) / ln(1 + n_obs))) AS s_uniq FROM h0),
 hist AS (SELECT *, 0.3 * s_link + 0.4 * s_uniq + 0.3 * s_infer AS lps_total FROM h)"""


def scorecards(spark, sf):
    """One scorecard per brand and month, measured on that month's line items."""
    parts = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    items = (
        tables.table(spark, sf, "lineitem")
        .groupBy("l_partkey", tr.month_id(F.col("l_shipdate")).alias("computed_at"))
        .agg(
            F.count("*").alias("cnt"),
            F.sum("l_discount").alias("d"),
            F.count_if(F.col("l_returnflag") == "R").alias("ret"),
        )
    )
    s_uniq = 1.0 - F.log1p("minsup") / F.log1p("n_obs")
    return (
        items.join(parts, "l_partkey")
        .groupBy(F.col("p_brand").alias("feature_id"), "computed_at")
        .agg(
            F.sum("cnt").alias("n_obs"),
            F.count("*").alias("n_distinct"),
            F.min("cnt").alias("minsup"),
            F.least(F.lit(1.0), 10 * F.sum("d") / F.sum("cnt")).alias("s_link"),
            (F.sum("ret") / F.sum("cnt")).alias("s_infer"),
        )
        .withColumn("s_uniq", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s_uniq)))
        .withColumn("lps_total", 0.3 * F.col("s_link") + 0.4 * F.col("s_uniq") + 0.3 * F.col("s_infer"))
    )


@query("latest_scorecard", f"WITH {HIST} SELECT feature_id, max(computed_at) AS computed_at, {R('max_by(lps_total, computed_at)')} AS lps_total FROM hist GROUP BY 1")
def latest_scorecard(spark, sf):
    return history.latest(scorecards(spark, sf), ["feature_id"], "computed_at").select(
        "feature_id", "computed_at", r(F.col("lps_total")).alias("lps_total")
    )


@query(
    "latest_routing_decision",
    f"""WITH {HIST} SELECT feature_id, max(computed_at) AS issued_at, max_by(CASE WHEN lps_total >= 0.75 THEN 'LOCAL' WHEN lps_total >= 0.6 THEN 'SHUFFLE' ELSE 'CENTRAL' END, computed_at) AS boundary FROM hist GROUP BY 1""",
)
def latest_routing_decision(spark, sf):
    boundary = F.when(F.col("lps_total") >= 0.75, "LOCAL").when(F.col("lps_total") >= 0.6, "SHUFFLE").otherwise("CENTRAL")
    decisions = scorecards(spark, sf).select("feature_id", F.col("computed_at").alias("issued_at"), boundary.alias("boundary"))
    return history.latest(decisions, ["feature_id"], "issued_at")


@query(
    "active_contract",
    f"""WITH {cm.CONTRACTS} SELECT feature_id, contract_version, boundary, granularity, contract_version = max(contract_version) OVER (PARTITION BY feature_id) AS active FROM contracts""",
)
def active_contract(spark, sf):
    return history.with_active_flag(cm.contracts(spark, sf)).select(
        "feature_id", "contract_version", "boundary", "granularity", "active"
    )


@query(
    "min_effvar_qualify",
    f"""WITH {cm.LADDER}, c AS (SELECT event_type AS feature_id, window_id, level, cell, count(*) AS cnt FROM lad GROUP BY ALL),
 e AS (SELECT feature_id, window_id, level, 16.0 / (sum(cnt)::DOUBLE / count(*)) AS ev, min(cnt) AS m FROM c GROUP BY ALL)
SELECT feature_id, window_id, level, {R('ev')} AS eff_var FROM e WHERE m >= 2 QUALIFY ev = min(ev) OVER (PARTITION BY feature_id, window_id)""",
)
def min_effvar_qualify(spark, sf):
    rows = (
        cm.feature_cells(spark, sf)
        .groupBy("feature_id", "window_id", "level")
        .agg((16.0 / (F.sum("cnt") / F.count("*"))).alias("eff_var"), F.min("cnt").alias("m"))
        .filter("m >= 2")
    )
    best = history.qualify_min(rows, ["feature_id", "window_id"], "eff_var")
    return best.select("feature_id", "window_id", "level", r(F.col("eff_var")).alias("eff_var"))


# ---- two look-back windows --------------------------------------------------------------------------------------
ASOF = "2024-01-30"
TWO = (
    cm.LADDER
    + f""", w AS (SELECT lad.*, ww.w AS win FROM lad, (VALUES ('W1', 7), ('W0', 28)) ww(w, d) WHERE date_diff('day', ts::DATE, DATE '{ASOF}') BETWEEN 0 AND d - 1),
 c AS (SELECT event_type AS feature_id, level, win, cell, count(*) AS cnt, sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS y FROM w GROUP BY ALL),
 s AS (SELECT feature_id, level, win, sum(cnt)::BIGINT AS n, count(*) AS nd, min(cnt) AS m, sum(y) / sum(cnt) AS rate FROM c GROUP BY ALL),
 two AS (SELECT a.feature_id, a.level, a.n AS n_obs_w1, b.n AS n_obs_w0, a.nd AS nd_w1, b.nd AS nd_w0, a.m AS m_w1, b.m AS m_w0, a.rate AS r1, b.rate AS r0
   FROM s a JOIN s b ON a.feature_id = b.feature_id AND a.level = b.level AND a.win = 'W1' AND b.win = 'W0')"""
)


def two_windows(spark, sf):
    ev = tables.events(spark, sf).withColumn("feature_id", F.col("event_type"))
    cells = stats.two_window_cells(
        ev, ["feature_id"], cm.item_cell(), cm.cluster_cell(), F.date_diff(F.lit(ASOF).cast("date"), F.to_date("ts")),
        {"W1": 7, "W0": 28}, cm.high_value(),
    )
    per_window = cells.groupBy("feature_id", "level", "window_id").agg(
        F.sum("cnt").alias("n_obs"),
        F.count("*").alias("nd"),
        F.min("cnt").alias("m"),
        (F.sum("y") / F.sum("cnt")).alias("rate"),
    )
    return history.side_by_side(per_window, ["feature_id", "level"], ["n_obs", "nd", "m", "rate"])


@query("two_window_stats", f"WITH {TWO} SELECT feature_id, level, n_obs_w1, n_obs_w0, nd_w1, nd_w0, m_w1, m_w0, {R('r1')} AS rate_w1, {R('r0')} AS rate_w0 FROM two")
def two_window_stats(spark, sf):
    t = two_windows(spark, sf)
    return t.withColumn("rate_w1", r(F.col("rate_w1"))).withColumn("rate_w0", r(F.col("rate_w0")))


@query("min_support_collapse", f"WITH {TWO} SELECT feature_id, level, m_w1, m_w0 FROM two WHERE m_w1 < m_w0 AND m_w1 < 50")
def min_support_collapse(spark, sf):
    return two_windows(spark, sf).filter("m_w1 < m_w0 AND m_w1 < 50").select("feature_id", "level", "m_w1", "m_w0")


@query("distinct_spike", f"WITH {TWO} SELECT feature_id, level, nd_w1, nd_w0 FROM two WHERE abs(nd_w1 - nd_w0) > 0")
def distinct_spike(spark, sf):
    return two_windows(spark, sf).filter(F.abs(F.col("nd_w1") - F.col("nd_w0")) > 0).select(
        "feature_id", "level", "nd_w1", "nd_w0"
    )


@query(
    "unstable_across_windows",
    f"WITH {TWO} SELECT feature_id, level, {R('abs(r1 - r0) / greatest(1e-12, abs(r0))')} AS change, abs(r1 - r0) / greatest(1e-12, abs(r0)) > 0.02 AS unstable FROM two",
)
def unstable_across_windows(spark, sf):
    change = history.relative_change(F.col("rate_w1"), F.col("rate_w0"))
    return two_windows(spark, sf).select("feature_id", "level", r(change).alias("change"), (change > 0.02).alias("unstable"))


# ---- drift over the scorecard history ---------------------------------------------------------------------------
@query(
    "lps_drift",
    f"""WITH {HIST}, l AS (SELECT *, lag(lps_total) OVER (PARTITION BY feature_id ORDER BY computed_at) AS p FROM hist)
SELECT feature_id, computed_at, {R('abs(lps_total - p)')} AS drift FROM l WHERE round(abs(lps_total - p), 12) > 0.02""",
)
def lps_drift(spark, sf):
    return history.score_drift(scorecards(spark, sf), "lps_total", 0.02).select(
        "feature_id", "computed_at", r(F.col("drift")).alias("drift")
    )


BAND = "CASE WHEN {c} >= 0.75 THEN 2 WHEN {c} >= 0.6 THEN 1 ELSE 0 END"
SUBDRIFT = f"""{HIST}, l AS (SELECT *, lag(lps_total) OVER w AS p, lag(s_link) OVER w AS pl, lag(s_uniq) OVER w AS pu, lag(s_infer) OVER w AS pi FROM hist WINDOW w AS (PARTITION BY feature_id ORDER BY computed_at)),
 al AS (SELECT feature_id, computed_at, concat_ws(',', CASE WHEN round(abs(s_link - pl), 12) > 0.08 THEN 'DRIFT:s_link' END, CASE WHEN round(abs(s_uniq - pu), 12) > 0.05 THEN 'DRIFT:s_uniq' END,
   CASE WHEN round(abs(s_infer - pi), 12) > 0.1 THEN 'DRIFT:s_infer' END, CASE WHEN {BAND.format(c='lps_total')} <> {BAND.format(c='p')} THEN 'BAND_CROSSED' END) AS alerts FROM l WHERE p IS NOT NULL)"""
TAUS = {"s_link": 0.08, "s_uniq": 0.05, "s_infer": 0.1}


@query("subscore_drift", f"WITH {SUBDRIFT} SELECT * FROM al WHERE alerts <> ''")
def subscore_drift(spark, sf):
    d = history.subscore_drift(scorecards(spark, sf), TAUS, "lps_total", mid=0.6, high=0.75)
    return d.select("feature_id", "computed_at", F.array_join("alerts", ",").alias("alerts"))


@query(
    "needs_review",
    f"""WITH {SUBDRIFT}, f AS (SELECT feature_id, max(computed_at) AS last_alert, count(*) AS n_alerts FROM al WHERE alerts <> '' GROUP BY 1)
SELECT p_partkey, n_alerts IS NOT NULL AS needs_review, last_alert FROM part LEFT JOIN f ON p_brand = feature_id""",
)
def needs_review(spark, sf):
    """Catalog rows whose brand ever drifted go back to routing, with the month of the last alert."""
    d = history.subscore_drift(scorecards(spark, sf), TAUS, "lps_total", mid=0.6, high=0.75)
    flags = d.groupBy(F.col("feature_id").alias("p_brand")).agg(
        F.max("computed_at").alias("last_alert")
    )
    parts = tables.table(spark, sf, "part").select("p_partkey", "p_brand")
    return parts.join(flags, "p_brand", "left").select(
        "p_partkey", F.col("last_alert").isNotNull().alias("needs_review"), "last_alert"
    )


VERS = """ver AS (SELECT p_brand AS feature_id, year(l_shipdate) AS version, count(DISTINCT l_suppkey) AS degree,
   CAST(floor(avg(l_quantity) * 10) AS BIGINT) AS retention_days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def catalog_versions(spark, sf):
    """Yearly catalog versions of a brand: suppliers as join degree, retention from order sizes."""
    parts = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    base = (
        tables.table(spark, sf, "lineitem")
        .select("l_partkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("version"))
        .join(parts, "l_partkey")
        .groupBy(F.col("p_brand").alias("feature_id"), "version", "l_suppkey")
        .agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    )
    return base.groupBy("feature_id", "version").agg(
        F.count("*").alias("degree"),
        F.floor(F.sum("q") / F.sum("n") * 10).alias("retention_days"),
    )


@query(
    "degree_spike",
    f"WITH {VERS}, l AS (SELECT *, lag(degree) OVER (PARTITION BY feature_id ORDER BY version) AS p FROM ver) SELECT feature_id, version::BIGINT AS version, degree, p AS prev_degree FROM l WHERE degree - p > 0",
)
def degree_spike(spark, sf):
    return history.spikes(catalog_versions(spark, sf), "degree", 0, "version").select(
        "feature_id", F.col("version").cast("bigint").alias("version"), "degree", "prev_degree"
    )


@query(
    "retention_change",
    f"WITH {VERS}, l AS (SELECT *, lag(retention_days) OVER (PARTITION BY feature_id ORDER BY version) AS p FROM ver) SELECT feature_id, version::BIGINT AS version, retention_days, p AS prev_retention_days FROM l WHERE retention_days <> p",
)
def retention_change(spark, sf):
    return history.changes(catalog_versions(spark, sf), "retention_days", "version").select(
        "feature_id", F.col("version").cast("bigint").alias("version"), "retention_days", "prev_retention_days"
    )


@query(
    "audit_tail",
    f"""WITH {cm.EV} SELECT ts, event_type AS feature_id, event_id FROM ev WHERE value > 120 ORDER BY ts DESC, event_id DESC LIMIT 20""",
)
def audit_tail(spark, sf):
    """The 20 newest rejects of the lateness rule."""
    late = gates.rejected(gates.label(cm.weekly_events(spark, sf), [("LATE", F.col("value") <= 120)]))
    return history.tail(late.select("ts", F.col("event_type").alias("feature_id"), "event_id"), 20, "ts", "event_id")


@query(
    "balanced_sample",
    """SELECT o_orderkey, label FROM (SELECT o_orderkey, c_mktsegment = 'BUILDING' AS label, row_number() OVER (
   PARTITION BY c_mktsegment = 'BUILDING' ORDER BY """
    + U("'order_total|lps_v1|W1'", "o_orderkey")
    + """, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey) WHERE rn <= 1000""",
)
def balanced_sample(spark, sf):
    customer = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = tables.table(spark, sf, "orders").join(customer, "o_custkey").select(
        "o_orderkey", (F.col("c_mktsegment") == "BUILDING").alias("label")
    )
    return bounding.balanced_sample(rows, "label", "o_orderkey", 1000, "order_total|lps_v1|W1")
