"""Aggregations: statistics, staging, shuffle sums and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import central, gates, probes, sketches, stats
from veilgrain.operators import shuffle_dp as sh
from veilgrain.queries import common as cm
from veilgrain.queries.registry import R, query, r
from veilgrain.sources import tables

KEYS = ["feature_id", "window_id", "level"]
CELLS = (
    cm.LADDER
    + """, cells AS (SELECT event_type AS feature_id, window_id, level, cell, count(*) AS cnt,
       sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS y FROM lad GROUP BY ALL),
  tot AS (SELECT feature_id, window_id, level, sum(cnt)::BIGINT AS n_obs, count(*) AS n_distinct_est, min(cnt) AS min_support_est,
          sum(y)::DOUBLE / sum(cnt) AS rate FROM cells GROUP BY ALL)"""
)


@query(
    "feature_stats",
    f"""WITH {CELLS}, tail AS (SELECT feature_id, window_id, level, sum(CASE WHEN cnt < 0.05 * n_obs THEN cnt ELSE 0 END) AS t
  FROM cells JOIN tot USING (feature_id, window_id, level) GROUP BY ALL)
SELECT feature_id, window_id, level, n_obs, n_distinct_est, min_support_est, {R('t / n_obs')} AS tail_mass_est,
  {R('n_obs / n_distinct_est')} AS n_eff, {R('rate * (1 - rate) / (n_obs / n_distinct_est)')} AS approx_variance
FROM tot JOIN tail USING (feature_id, window_id, level)""",
)
def feature_stats(spark, sf):
    st = stats.feature_stats(cm.feature_cells(spark, sf), KEYS, 0.05)
    for c in ("tail_mass_est", "n_eff", "approx_variance"):
        st = st.withColumn(c, r(F.col(c)))
    return st


@query(
    "n_distinct_hll",
    f"""WITH {cm.EV} SELECT window_id, event_type, count(DISTINCT contributor) AS n_distinct, true AS within_error FROM ev GROUP BY ALL""",
)
def n_distinct_hll(spark, sf):
    """Daily sketches of contributors, merged to weeks without touching events again; off by at most three standard errors."""
    daily = (
        cm.weekly_events(spark, sf)
        .groupBy("window_id", "day_id", "event_type")
        .agg(F.hll_sketch_agg("contributor", F.lit(12)).alias("sketch"))
    )
    weekly = daily.groupBy("window_id", "event_type").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct_est")
    )
    exact = cm.weekly_events(spark, sf).groupBy("window_id", "event_type").agg(
        F.count_distinct("contributor").alias("n_distinct")
    )
    error = F.abs(F.col("n_distinct_est") - F.col("n_distinct"))
    allowed = F.greatest(F.lit(1.0), F.col("n_distinct") * (3 * 1.04 / 64))  # 64 is the root of the 4096 registers
    return exact.join(weekly, ["window_id", "event_type"]).select(
        "window_id", "event_type", "n_distinct", (error <= allowed).alias("within_error")
    )


@query("min_support", f"WITH {CELLS} SELECT feature_id, window_id, level, min_support_est AS min_support FROM tot")
def min_support(spark, sf):
    return cm.feature_cells(spark, sf).groupBy(*KEYS).agg(F.min("cnt").alias("min_support"))


@query(
    "tail_mass",
    f"""WITH {CELLS}, rk AS (SELECT *, percent_rank() OVER (PARTITION BY feature_id, window_id, level ORDER BY cnt) AS pr FROM cells)
SELECT feature_id, window_id, level, {R('sum(CASE WHEN cnt < 0.05 * n_obs THEN cnt ELSE 0 END) / max(n_obs)')} AS tail_mass,
  {R('sum(CASE WHEN pr <= 0.25 THEN cnt ELSE 0 END) / max(n_obs)')} AS bottom_mass
FROM rk JOIN tot USING (feature_id, window_id, level) GROUP BY ALL""",
)
def tail_mass(spark, sf):
    masses = stats.tail_masses(cm.feature_cells(spark, sf), KEYS, 0.05, 0.25)
    return masses.withColumn("tail_mass", r(F.col("tail_mass"))).withColumn("bottom_mass", r(F.col("bottom_mass")))


COUNT_MIN, FREQUENT = sketches.CountMin(256, 4), sketches.FrequentItems(384)


@query(
    "heavy_hitters_sketch",
    f"""WITH {CELLS}, top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY feature_id, window_id, level ORDER BY cnt DESC, cell) AS rank FROM cells) WHERE rank <= 3),
 h AS (SELECT *, unnest(range(4)) AS row FROM cells),
 c AS (SELECT *, ('0x' || substr(md5(cell), 1 + 7 * row, 7))::BIGINT % 256 AS bucket FROM h),
 counters AS (SELECT feature_id, window_id, level, row, bucket, sum(cnt)::BIGINT AS n FROM c GROUP BY ALL),
 est AS (SELECT feature_id, window_id, level, cell, min(n) AS estimate FROM c JOIN counters USING (feature_id, window_id, level, row, bucket) GROUP BY ALL)
SELECT feature_id, window_id, level, cell, cnt, rank, estimate,
  estimate BETWEEN cnt AND cnt + {COUNT_MIN.error!r}::DOUBLE * n_obs AS within_bound, true AS in_frequent_items
FROM top JOIN est USING (feature_id, window_id, level, cell) JOIN tot USING (feature_id, window_id, level)""",
)
def heavy_hitters_sketch(spark, sf):
    """The three most frequent cells, exact, and what daily summaries merged to weeks say about them.

    ``in_frequent_items`` is false only where the frequent-items summary breaks its promise.
    """
    events = cm.laddered_events(spark, sf).withColumn("feature_id", F.col("event_type"))
    daily = [*KEYS, "day_id"]
    counters = COUNT_MIN.merged(COUNT_MIN.summary(events, daily, F.col("cell")), KEYS)
    frequent = FREQUENT.items(FREQUENT.merged(FREQUENT.summary(events, daily, F.col("cell")), KEYS), KEYS, 384)
    top = stats.heavy_hitters(cm.feature_cells(spark, sf), KEYS, 3).withColumn("rank", F.col("rank").cast("bigint"))
    met = COUNT_MIN.estimates(top, counters, KEYS, F.col("cell")).join(
        frequent.withColumnRenamed("item", "cell").drop("n_obs"), [*KEYS, "cell"], "left"
    )
    rows = counters.filter("row = 0").groupBy(*KEYS).agg(F.sum("n").alias("n_obs"))  # every event is in each row once
    over = F.col("estimate") - F.col("cnt")
    off = F.abs(F.col("summary_count") - F.col("cnt"))
    bound = FREQUENT.error * F.col("n_obs")
    return met.join(rows, KEYS).select(
        *KEYS, "cell", "cnt", "rank", "estimate",
        ((over >= 0) & (over <= COUNT_MIN.error * F.col("n_obs"))).alias("within_bound"),
        F.coalesce(off <= bound, F.col("cnt") <= bound).alias("in_frequent_items"),
    )


@query(
    "support_by_granularity",
    f"""WITH {cm.LADDER} SELECT window_id, level, cell, count(DISTINCT contributor) AS support, count(*) AS n_rows FROM lad GROUP BY ALL""",
)
def support_by_granularity(spark, sf):
    return weekly_supports(spark, sf).drop("lvl")


def weekly_supports(spark, sf):
    per_person = stats.ladder_contributors(cm.weekly_events(spark, sf), ["window_id"], cm.item_cell(), cm.cluster_cell())
    return stats.cell_supports(per_person, ["window_id"])


@query(
    "expected_inverse_support",
    f"""WITH {cm.LADDER}, s AS (SELECT window_id, level, cell, count(DISTINCT contributor) AS support, count(*) AS n FROM lad GROUP BY ALL)
SELECT window_id, level, {R('avg(1.0 / support)')} AS u_cells, {R('sum(n * (1.0 / support)) / sum(n)')} AS u_rows FROM s GROUP BY ALL""",
)
def expected_inverse_support(spark, sf):
    u = stats.expected_inverse_support(weekly_supports(spark, sf), ["window_id", "level"])
    return u.withColumn("u_cells", r(F.col("u_cells"))).withColumn("u_rows", r(F.col("u_rows")))


MI = """attrs AS (SELECT level, 'segment' AS attr, c_mktsegment AS a, cell FROM lad JOIN customer ON contributor = c_custkey
  UNION ALL SELECT level, 'nation', c_nationkey::VARCHAR, cell FROM lad JOIN customer ON contributor = c_custkey),
 j AS (SELECT level, attr, a, cell, count(*) AS n FROM attrs GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY level, attr, a) AS na, sum(n) OVER (PARTITION BY level, attr, cell) AS ns,
       sum(n) OVER (PARTITION BY level, attr) AS nt FROM j),
 mi AS (SELECT level, attr, sum(n / nt * ln(n * nt / (na * ns))) AS mi FROM m GROUP BY ALL)"""


@query(
    "mutual_information",
    f"""WITH {cm.LADDER}, {MI} SELECT level, {R('max(mi)')} AS max_mi, max_by(attr, (round(mi, 9), attr)) AS worst_attr FROM mi GROUP BY level""",
)
def mutual_information(spark, sf):
    return worst_mutual_information(spark, sf).drop("penalty").withColumn("max_mi", r(F.col("max_mi")))


def worst_mutual_information(spark, sf, penalty_above: float = 0.0, penalty: float = 0.0):
    """Largest mutual information per level between the cell and the contributor's segment or nation.

    ``penalty`` is added up for every attribute above ``penalty_above``.
    """
    who = tables.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("contributor"),
        F.explode(
            F.array(
                F.struct(F.lit("segment").alias("attr"), F.col("c_mktsegment").alias("a")),
                F.struct(F.lit("nation").alias("attr"), F.col("c_nationkey").cast("string").alias("a")),
            )
        ).alias("p"),
    )
    # one row per contributor and cell before the attributes multiply it
    pairs = stats.ladder_contributors(tables.events(spark, sf), [], cm.item_cell(), cm.cluster_cell())
    joined = pairs.join(who, "contributor").select("level", "p.attr", "p.a", "cell", "n")
    mi = stats.mutual_information_counts(joined, ["level", "attr"], "a", "cell", "n")
    rounded = F.round("mi", 9)
    return mi.groupBy("level").agg(
        F.max("mi").alias("max_mi"),
        F.max_by("attr", F.struct(rounded, F.col("attr"))).alias("worst_attr"),
        F.sum(F.when(rounded > penalty_above, penalty).otherwise(0.0)).alias("penalty"),
    )


AUC = """o AS (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS v, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey),
 lab AS (SELECT a.attr, v, seg = a.attr AS pos FROM o, (SELECT DISTINCT c_mktsegment AS attr FROM customer) a),
 rk AS (SELECT attr, pos, (rank() OVER (PARTITION BY attr ORDER BY v)) + (count(*) OVER (PARTITION BY attr, v) - 1) / 2.0 AS rnk FROM lab)"""


@query(
    "probe_auc",
    f"""WITH {AUC} SELECT attr, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg,
  {R('(sum(rnk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos))')} AS auc
FROM rk GROUP BY attr""",
)
def probe_auc(spark, sf):
    return order_value_auc(spark, sf).withColumn("auc", r(F.col("auc")))


def order_value_auc(spark, sf):
    """AUC of the order total (in cents) for membership in each market segment."""
    customer = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("attr"))
    orders = tables.table(spark, sf, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    return stats.label_auc(orders.join(customer, "o_custkey"), "attr", "v")


@query(
    "probe_logreg",
    """SELECT 'order_total' AS feature_id, 'segment' AS attr, count(*) AS n_rows, true AS as_good_as_chance FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def probe_logreg(spark, sf):
    """A logistic probe that predicts the BUILDING segment from order total and priority, which do not tell it.

    Every order is either fitted on or held out; the AUC of those held out lies within a band of 0.1 around chance.
    """
    customer = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    data = tables.table(spark, sf, "orders").join(customer, "o_custkey").select(
        "o_orderkey",
        (F.col("o_totalprice") / 1e5).alias("total"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("priority"),
        (F.col("c_mktsegment") == "BUILDING").cast("double").alias("label"),
    )
    probe = probes.logistic_probe(spark, data, ["total", "priority"], "label", "o_orderkey", "order_total", "segment", 2000)
    return probe.select(
        "feature_id", "attr", (F.col("n_train") + F.col("n_held_out")).alias("n_rows"),
        F.col("auc").between(0.4, 0.6).alias("as_good_as_chance"),
    )


@query(
    "value_persistence",
    f"""WITH {cm.EV}, d AS (SELECT contributor, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS v FROM ev GROUP BY ALL),
 l AS (SELECT *, lag(day) OVER w AS pd, lag(v) OVER w AS pv FROM d WINDOW w AS (PARTITION BY contributor ORDER BY day))
SELECT day, count(*) AS n_units, {R('avg(CASE WHEN v = pv THEN 1.0 ELSE 0.0 END)')} AS persistence FROM l WHERE pd = day - 1 GROUP BY day""",
)
def value_persistence(spark, sf):
    ev = cm.weekly_events(spark, sf)
    p = stats.value_persistence(ev, "contributor", "event_type", "day_id", ["ts", "event_id"])
    return p.withColumn("persistence", r(F.col("persistence")))


@query(
    "autocorrelation",
    f"""WITH {cm.EV}, d AS (SELECT event_type, day_id, count(*)::DOUBLE AS x FROM ev GROUP BY ALL),
 l AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY day_id) AS p FROM d)
SELECT event_type, {R('corr(x, p)')} AS autocorrelation FROM l WHERE p IS NOT NULL GROUP BY 1""",
)
def autocorrelation(spark, sf):
    a = stats.lag1_autocorrelation(cm.weekly_events(spark, sf), ["event_type"], "day_id")
    return a.withColumn("autocorrelation", r(F.col("autocorrelation")))


STAGED = (
    cm.LADDER
    + """, capped AS (SELECT *, greatest(0.0, least(200.0, value)) AS v FROM (SELECT *, row_number() OVER (
    PARTITION BY contributor, window_id, level, cell ORDER BY ts, event_id) AS rn FROM lad) WHERE rn <= 2),
 staged AS (SELECT window_id, level, lvl, cell, count(*) AS event_count, sum(v) AS value_sum, sum(v * v) AS value_sumsq,
            count(DISTINCT contributor) AS contributors_count FROM capped GROUP BY ALL)"""
)


@query(
    "preaggregate_staging",
    f"""WITH {STAGED} SELECT window_id, level, cell, event_count, {R('value_sum', 2)} AS value_sum, {R('value_sumsq', 3)} AS value_sumsq, contributors_count FROM staged""",
)
def preaggregate_staging(spark, sf):
    staged = staged_events(spark, sf)
    return staged.select(
        "window_id", "level", "cell", "event_count", r(F.col("value_sum"), 2).alias("value_sum"),
        r(F.col("value_sumsq"), 3).alias("value_sumsq"), "contributors_count",
    )


def staged_events(spark, sf):
    return central.bounded_staging(
        cm.weekly_events(spark, sf), cm.item_cell(), cm.cluster_cell(), cm.CONTRACT, cap_cells=False
    )


CLICKS = """sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT"""
IMPS = """sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END)::BIGINT"""


@query(
    "sum_clicks_impressions",
    f"""WITH {cm.EV}, c AS (SELECT window_id, k AS cell, {CLICKS} AS clicks, {IMPS} AS impressions FROM ev GROUP BY ALL)
SELECT *, {R('clicks / greatest(1, impressions)')} AS ctr FROM c""",
)
def sum_clicks_impressions(spark, sf):
    cells = click_cells(cm.weekly_events(spark, sf), ["window_id", F.col("k").alias("cell")])
    return cells.withColumn("ctr", r(F.col("clicks") / F.greatest(F.lit(1), F.col("impressions"))))


def click_cells(df, keys):
    return df.groupBy(*keys).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type").isin("click", "view")).alias("impressions"),
    )


@query(
    "ladder_grouping_sets",
    f"""WITH {cm.EV}, e AS (SELECT *, k // 10 AS cluster FROM ev)
SELECT window_id, k AS item, cluster, count(*) AS n, count(DISTINCT contributor) AS contributors
FROM e GROUP BY GROUPING SETS ((window_id, cluster, k), (window_id, cluster), (window_id))""",
)
def ladder_grouping_sets(spark, sf):
    """All three levels from one (window, cluster, item, contributor) table; contributors are recounted per level."""
    base = (
        cm.weekly_events(spark, sf)
        .groupBy("window_id", F.floor(F.col("k") / 10).alias("cluster"), F.col("k").alias("item"), "contributor")
        .agg(F.count("*").alias("n"))
    )
    per_person = base.groupingSets(
        [["window_id", "cluster", "item", "contributor"], ["window_id", "cluster", "contributor"], ["window_id", "contributor"]],
        "window_id", "cluster", "item", "contributor",
    ).agg(F.sum("n").alias("n"), F.grouping("cluster").alias("_gc"), F.grouping("item").alias("_gi"))
    return per_person.groupBy("window_id", "cluster", "item", "_gc", "_gi").agg(
        F.sum("n").alias("n"), F.count("*").alias("contributors")
    ).drop("_gc", "_gi")


@query(
    "shuffle_aggregate",
    f"""WITH {cm.MESSAGES}, ok AS (SELECT * FROM msg WHERE CASE format WHEN 'bounded_increment' THEN inc BETWEEN 0 AND 2
    WHEN 'category' THEN cat BETWEEN 0 AND 3 ELSE srow < 8 AND scol < 24 AND supd <= 4 END),
 v AS (SELECT window_id, event_type AS cell, format, 0 AS srow, 0 AS pos, inc AS y FROM ok WHERE format = 'bounded_increment'
  UNION ALL SELECT window_id, event_type, format, 0, cat, 1 FROM ok WHERE format = 'category'
  UNION ALL SELECT window_id, event_type, format, srow, scol, supd FROM ok WHERE format = 'sketch')
SELECT window_id, cell, format, CAST(srow AS INT) AS "row", CAST(pos AS INT) AS "pos", count(*) AS n, sum(y)::BIGINT AS y FROM v GROUP BY ALL""",
)
def shuffle_aggregate(spark, sf):
    gated = gates.payload_gate(cm.messages(spark, sf), cap=2, categories=4, width=24, depth=8, max_update=4)
    msgs = gates.passed(gated).withColumnRenamed("event_type", "cell")
    return sh.aggregate_messages(msgs, ["window_id", "cell"])


@query(
    "empirical_signal_power",
    f"""WITH {cm.LADDER}, m AS (SELECT level, cell, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS mu FROM lad GROUP BY ALL)
SELECT level, {R('var_pop(mu)')} AS signal_power FROM m GROUP BY level""",
)
def empirical_signal_power(spark, sf):
    cells = stats.ladder_cells(tables.events(spark, sf), [], cm.item_cell(), cm.cluster_cell(), cm.high_value())
    return cells.groupBy("level").agg(r(F.var_pop(F.col("y") / F.col("cnt"))).alias("signal_power"))


@query(
    "item_effect_dispersion",
    """WITH i AS (SELECT p_brand, l_partkey, count(*) AS n, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS b
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
 c AS (SELECT p_brand, sum(n)::BIGINT AS n, var_pop(b) AS v FROM i GROUP BY 1)
SELECT p_brand, n, """
    + R("v")
    + " AS dispersion, "
    + R("sum(n * v) OVER () / sum(n) OVER ()")
    + " AS overall FROM c",
)
def item_effect_dispersion(spark, sf):
    items = (
        tables.table(spark, sf, "lineitem")
        .groupBy("l_partkey")
        .agg(F.count("*").alias("n"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("b"))
    )
    parts = tables.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    per_brand = items.join(parts, "l_partkey").groupBy("p_brand").agg(F.sum("n").alias("n"), F.var_pop("b").alias("v"))
    overall = per_brand.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("o"))
    return per_brand.withColumn("o", overall.scalar()).select(
        "p_brand", "n", r(F.col("v")).alias("dispersion"), r(F.col("o")).alias("overall")
    )


@query(
    "oracle_ablation_loss",
    f"""WITH {cm.LADDER}, e AS (SELECT level, cell, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS y FROM lad),
 mu AS (SELECT level, cell, avg(y) AS mu FROM e GROUP BY ALL),
 l AS (SELECT level, avg((y - mu) * (y - mu)) AS loss FROM e JOIN mu USING (level, cell) GROUP BY level)
SELECT level, {R('loss')} AS loss, {R('loss - (SELECT loss FROM l WHERE level = $$ITEM$$)')} AS agg_loss FROM l""",
)
def oracle_ablation_loss(spark, sf):
    cells = stats.ladder_cells(tables.events(spark, sf), [], cm.item_cell(), cm.cluster_cell(), cm.high_value())
    loss = stats.within_cell_loss(cells, ["level"])
    item = loss.filter("level = 'ITEM'").select("loss")
    return loss.withColumn("base", item.scalar()).select(
        "level", r(F.col("loss")).alias("loss"), r(F.col("loss") - F.col("base")).alias("agg_loss")
    )
