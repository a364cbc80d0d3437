"""Structured Streaming queries. Each reads the whole event table as a stream; the SQL covers closed windows."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from veilgrain.operators import gates, sketches
from veilgrain.operators import transforms as tr
from veilgrain.queries import common as cm
from veilgrain.queries.registry import GAUSS, R, query, r
from veilgrain.session import delete_at_exit, run_folder
from veilgrain.sources import tables
from veilgrain.streaming import ingest, lateness, windows

SECRET = f"'{cm.CONTRACT.secret}'"
# windows that end no later than the watermark, one day behind the newest event
CLOSED = cm.EV + ", lim AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), cl AS (SELECT ev.* FROM ev, lim WHERE CAST(ts AS DATE) + 1 <= wm)"


def stream(spark, sf):
    return ingest.event_stream(spark, sf, "events.parquet")


def marked(spark, sf):
    return ingest.with_watermark(stream(spark, sf), "1 day")


@query("stream_events", f"WITH {cm.EV} SELECT event_id, contributor, event_type, k, value FROM ev")
def stream_events(spark, sf):
    table, _ = ingest.run_to_table(stream(spark, sf), "events")
    return table.drop("ts")


# events reach the stream in batches of five days; those of every eighth value of k come ten days later
ARRIVAL = "CAST((date_part('day', ts) - 1) // 5 + CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END AS BIGINT)"


@query(
    "stream_watermark_lateness",
    f"""WITH {cm.EV}, arr AS (SELECT *, {ARRIVAL} AS b FROM ev), newest AS (SELECT b, max(ts) AS t FROM arr GROUP BY b),
 marks AS (SELECT b, max(t) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS wm FROM newest),
 marked AS (SELECT arr.*, coalesce(CAST(ts AS DATE) + 1 <= wm, false) AS late FROM arr JOIN marks USING (b))
SELECT day_id AS window_id, event_type, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS n_late,
  CAST(day_id AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM ev) AS closed FROM marked GROUP BY ALL""",
)
def stream_watermark_lateness(spark, sf):
    """Daily counts with one day of allowed lateness beside the late rows of each day, which are kept and not dropped."""
    k, day = F.col("k"), F.dayofmonth("ts")
    arriving = tables.events(spark, sf).select(
        "event_id", "ts", "event_type", (F.floor((day - 1) / 5) + F.when(k % 8 == 0, 2).otherwise(0)).alias("arrival")
    )
    folder = run_folder(spark, "arrivals")
    delete_at_exit(spark, folder)
    held = arriving.persist()
    for (arrival,) in held.select("arrival").distinct().orderBy("arrival").collect():  # at most nine
        held.filter(F.col("arrival") == arrival).coalesce(1).write.mode("append").parquet(folder)
    held.unpersist()
    schema = "event_id bigint, ts timestamp_ntz, event_type string"
    came = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    came = came.withColumn("ts", F.col("ts").cast("timestamp"))
    span = F.window("ts", "1 day")

    def daily(df):
        return df.groupBy(F.to_date("ts").cast("string").alias("window_id"), "event_type").agg(F.count("*").alias("n"))

    found = lateness.split_late(came, 86400, span.end, daily)
    on_time = found.parts.groupBy("window_id", "event_type").agg(F.sum("n").alias("n"))
    late = daily(found.late).withColumnRenamed("n", "n_late")
    closes = F.to_timestamp(F.date_add(F.to_date("window_id"), 1))
    return on_time.join(late, ["window_id", "event_type"], "full").select(
        "window_id", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_late", F.lit(0)).alias("n_late"),
        (closes <= F.lit(found.watermark)).alias("closed"),
    )


@query(
    "stream_tumbling_staging",
    f"WITH {CLOSED} SELECT day_id AS window_id, event_type, count(*) AS event_count, {R('sum(greatest(0.0, least(200.0, value)))', 2)} AS value_sum, count(DISTINCT contributor) AS contributors_count FROM cl GROUP BY ALL",
)
def stream_tumbling_staging(spark, sf):
    staged = windows.tumbling_staging(marked(spark, sf), "1 day", ["event_type"], tr.clip_numeric(F.col("value"), 0, 200))
    table, _ = ingest.run_to_table(staged, "staging-stream")
    return table.withColumn("value_sum", r(F.col("value_sum"), 2))


@query(
    "stream_distinct_contributors",
    f"WITH {CLOSED} SELECT day_id AS window_id, k // 10 AS decade, count(DISTINCT contributor) AS contributors_count, count(DISTINCT contributor) >= 55 AS passes FROM cl GROUP BY ALL",
)
def stream_distinct_contributors(spark, sf):
    decade = marked(spark, sf).withColumn("decade", F.floor(F.col("k") / 10))
    staged = windows.tumbling_staging(decade, "1 day", ["decade"], F.lit(0.0))
    table, _ = ingest.run_to_table(staged, "contributors-stream")
    return table.select(
        "window_id", "decade", "contributors_count", (F.col("contributors_count") >= 55).alias("passes")
    )


@query(
    "stream_sliding_w1_w0",
    f"""WITH {cm.EV}, lim AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events), d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS y FROM ev GROUP BY ALL),
 s AS (SELECT w, len, event_type, sum(n)::BIGINT AS n_obs, sum(y) AS y FROM d, (VALUES (7), (28)) l(len), LATERAL (SELECT day - CAST(unnest(range(0, len)) AS INT) AS w) GROUP BY ALL)
SELECT CAST(w AS DATE) AS from_day, CAST(w AS DATE) + CAST(len AS INT) AS to_day, event_type, n_obs, {R('y / n_obs')} AS rate FROM s, lim WHERE CAST(w AS DATE) + CAST(len AS INT) <= wm""",
)
def stream_sliding_w1_w0(spark, sf):
    out = None
    for length in ("7 days", "28 days"):
        stats = windows.sliding_stats(marked(spark, sf), length, ["event_type"], cm.high_value())
        table, _ = ingest.run_to_table(stats, "sliding")
        part = table.withColumn("rate", r(F.col("rate")))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "stream_session_counts",
    f"""WITH {cm.EV}, lim AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY contributor ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM ev),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY contributor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
 ses AS (SELECT contributor, sid, min(ts) AS a, max(ts) + INTERVAL 4 HOUR AS b, count(*) AS n FROM s GROUP BY ALL)
SELECT strftime(a, '%Y-%m-%d') AS day, n AS session_rows, count(*) AS sessions FROM ses, lim WHERE b <= wm GROUP BY ALL""",
)
def stream_session_counts(spark, sf):
    table, _ = ingest.run_to_table(windows.session_counts(marked(spark, sf), "4 hours"), "sessions")
    return (
        table
        .groupBy(F.to_date("started").cast("string").alias("day"), F.col("n").alias("session_rows"))
        .agg(F.count("*").alias("sessions"))
    )


@query("stream_dedupe", f"WITH {cm.EV} SELECT event_id, event_type, contributor FROM ev")
def stream_dedupe(spark, sf):
    """Every event arrives twice; one delivery of each id is kept."""
    ev = stream(spark, sf)
    twice = ev.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    table, _ = ingest.run_to_table(ingest.dedupe_stream(twice, "event_id", "1 day"), "dedupe")
    return table.select("event_id", "event_type", "contributor")


@query(
    "stream_contribution_cap",
    f"""WITH {cm.LADDER}, c AS (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, level, cell ORDER BY ts, event_id) AS rn FROM lad)
SELECT window_id, level, cell, event_id FROM c WHERE rn <= 2""",
)
def stream_contribution_cap(spark, sf):
    ev = stream(spark, sf).withColumn("window_id", tr.week_id(F.col("ts")))
    parts = ingest.capped_ingest(tr.ladder(ev, cm.item_cell(), cm.cluster_cell()), 2)
    return ingest.merge_capped(parts, 2).select("window_id", "level", "cell", "event_id")


@query(
    "stream_gate_ingest",
    f"""WITH {cm.CONTRACTS}, a AS (SELECT feature_id, max_by(boundary, contract_version) AS cb, list(contract_version) AS v FROM (
   SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY contract_version DESC) AS rn FROM contracts) WHERE rn <= 3 GROUP BY 1)
SELECT event_id, CASE WHEN cb IS NULL THEN 'REJECT_CONTRACT:NO_ACTIVE_CONTRACT' WHEN cb <> 'CENTRAL' THEN 'REJECT_CONTRACT:BOUNDARY'
  WHEN NOT list_contains(v, window_id) THEN 'REJECT_CONTRACT:VERSION' ELSE 'PASSED' END AS outcome FROM ev LEFT JOIN a ON event_type = feature_id""",
)
def stream_gate_ingest(spark, sf):
    ev = stream(spark, sf).select(
        "event_id", "ts", F.col("event_type").alias("feature_id"), tr.week_id(F.col("ts")).alias("contract_version")
    )
    passed, rejected = ingest.gated_ingest(ev, gates.allowed_contracts(cm.contracts(spark, sf), 3), "CENTRAL")
    good = passed.select("event_id", F.lit("PASSED").alias("outcome"))
    bad = rejected.select("event_id", F.col("reject_reason").alias("outcome"))
    return good.unionByName(bad)


STREAM_C = dataclasses.replace(cm.CONTRACT, contract_id="c_stream", feature_id="events_daily", k_min=30)


@query(
    "stream_release",
    f"""WITH {CLOSED}, p AS (SELECT day_id AS window_id, event_type AS cell, contributor, least(2, count(*)) AS m FROM cl WHERE event_type IN {cm.EVENT_TYPES} GROUP BY ALL),
 c AS (SELECT window_id, 'CLUSTER' AS level, cell, sum(m)::BIGINT AS n, count(*) AS cc FROM p GROUP BY ALL)
SELECT window_id, cell, {R(f"greatest(0.0, n + sqrt(2 * ln(1.25 / 1e-6)) * (2*sqrt(8)) * {GAUSS(SECRET, repr(STREAM_C.contract_id), repr(STREAM_C.feature_id), repr('v1'), 'window_id', 'level', 'cell', repr('COUNT'))})")} AS dp_event_count, 'v1' AS contract_version FROM c WHERE cc >= 30""",
)
def stream_release(spark, sf):
    staged = windows.bounded_tumbling_staging(marked(spark, sf), "1 day", F.col("event_type"), cm.EVENT_TYPES, STREAM_C)
    return windows.release_stream(staged.withColumn("level", F.lit("CLUSTER")), STREAM_C, 1706745600000).select(
        "window_id", "cell",
        r(F.col("dp_event_count")).alias("dp_event_count"), "contract_version",
    )


DOMAIN = ("click", "purchase", "signup", "view")


@query(
    "stream_domain_gate",
    f"""WITH {cm.EV} SELECT event_type, CASE WHEN event_type NOT IN {DOMAIN} OR event_type IS NULL THEN 'REJECT_DOMAIN' ELSE 'PASSED' END AS outcome, count(*) AS n FROM ev GROUP BY ALL""",
)
def stream_domain_gate(spark, sf):
    """Stream rows outside a public domain of four event types are kept as rejects, not lost."""
    passed, rejected = ingest.domain_ingest(stream(spark, sf).select("event_id", "event_type"), F.col("event_type"), DOMAIN)
    rows = passed.select("event_type", F.lit("PASSED").alias("outcome"))
    rows = rows.unionByName(rejected.select("event_type", F.col(gates.REASON).alias("outcome")))
    return rows.groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


@query(
    "stream_sketch_stats",
    f"""WITH {CLOSED}, smp AS (SELECT event_type, event_id, md5('sample|' || event_id) AS h FROM ev
   QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY h, event_id) <= 5)
SELECT event_type, (SELECT count(*) FROM cl WHERE cl.event_type = smp.event_type) AS n_obs, true AS contributors_within_error,
  true AS quantiles_within_error, string_agg(event_id, ',' ORDER BY h, event_id) AS sample FROM smp GROUP BY event_type""",
)
def stream_sketch_stats(spark, sf):
    """Daily sketches from the stream merged into estimates over the whole period, and a sample of each event type.

    Contributors are within three standard errors, and the ranks of the quartiles within ``RANK_ERROR`` of what they should be,
    both compared with the events themselves.
    """
    daily = windows.sketch_stats(marked(spark, sf), "1 day", ["event_type"], "contributor", "value")
    table, _ = ingest.run_to_table(daily, "sketches")
    ranks = (0.25, 0.5, 0.75)
    merged = windows.merged_sketches(table, ["event_type"], ranks)
    closed = cm.weekly_events(spark, sf).join(
        table.select("event_type", F.col("window_id").alias("day_id")), ["event_type", "day_id"], "left_semi"
    )
    value, q = F.col("value"), F.col("quantiles")
    exact = (
        closed.join(merged, "event_type")
        .groupBy("event_type", "n_obs", "contributors_est", "quantiles")
        .agg(
            F.count_distinct("contributor").alias("people"),
            *[F.count_if(value < q[i]).alias(f"below{i}") for i in range(3)],
            *[F.count_if(value <= q[i]).alias(f"upto{i}") for i in range(3)],
        )
    )
    slack = windows.RANK_ERROR * F.col("n_obs")
    right = F.lit(True)
    for i, rank in enumerate(ranks):
        right &= (F.col(f"below{i}") - slack <= rank * F.col("n_obs")) & (rank * F.col("n_obs") <= F.col(f"upto{i}") + slack)
    error = F.abs(F.col("contributors_est") - F.col("people"))
    parts = ingest.sampled_ingest(stream(spark, sf).select("event_id", "event_type"), ["event_type"], "event_id", 5)
    chosen = sketches.bottom_k(parts, ["event_type"], F.col("event_id"), 5)
    place = F.struct(F.md5(F.concat_ws("|", F.lit("sample"), F.col("event_id").cast("string"))), "event_id")
    ids = F.transform(F.sort_array(F.collect_list(place)), lambda x: x["event_id"].cast("string"))
    sample = chosen.groupBy("event_type").agg(F.array_join(ids, ",").alias("sample"))
    return sample.join(exact, "event_type").select(
        "event_type", "n_obs",
        (error <= F.greatest(F.lit(1.0), F.col("people") * (3 * 1.04 / 64))).alias("contributors_within_error"),
        right.alias("quantiles_within_error"), "sample",
    )
