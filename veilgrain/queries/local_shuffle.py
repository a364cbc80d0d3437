"""Local randomizers and the shuffle path."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import bounding, gates
from veilgrain.operators import local_dp as ld
from veilgrain.operators import shuffle_dp as sh
from veilgrain.operators import shuffle_path as path
from veilgrain.operators import transforms as tr
from veilgrain.queries import common as cm
from veilgrain.queries.registry import GAUSS, R, U, W, query, r
from veilgrain.schema import RANDOMIZED_REPORT
from veilgrain.session import delete_at_exit, run_folder, store
from veilgrain.sources import sinks, tables

SECRET = f"'{cm.CONTRACT.secret}'"
EPS = 1.0
P = ld.keep_probability(EPS)
EVENTS_IN = "['click', 'error', 'purchase', 'signup', 'view']"


def _key():
    return cm.CONTRACT.secret, F.col("event_id")


def _bit():
    return (F.col("event_type") == "click").cast("int")


RR = f"""{cm.EV}, rr AS (SELECT ev.*, CASE WHEN {U(SECRET, 'event_id', "'rr'")} < {P!r} THEN (event_type = 'click')::INT ELSE 1 - (event_type = 'click')::INT END AS bit FROM ev)"""


@query("rr_binary", f"WITH {RR} SELECT event_id, bit FROM rr")
def rr_binary(spark, sf):
    return cm.weekly_events(spark, sf).select("event_id", ld.rr_binary(_bit(), EPS, *_key()).alias("bit"))


@query(
    "rr_binary_estimate",
    f"""WITH {RR}, a AS (SELECT window_id, count(*) AS n, sum(bit)::BIGINT AS y FROM rr GROUP BY 1)
SELECT window_id, n, y, {R(f'(y - n * {1 - P!r}) / {2 * P - 1!r}')} AS estimate, {R(f'n * {P * (1 - P) / (2 * P - 1) ** 2!r}')} AS variance FROM a""",
)
def rr_binary_estimate(spark, sf):
    reports = cm.weekly_events(spark, sf).withColumn("bit", ld.rr_binary(_bit(), EPS, *_key()))
    est = ld.rr_estimate(reports, ["window_id"], "bit", EPS)
    return est.withColumn("estimate", r(F.col("estimate"))).withColumn("variance", r(F.col("variance")))


PU, QU = ld.unary_probabilities(EPS)
UE = f"""{cm.EV}, ue AS (SELECT window_id, v, CASE WHEN list_position({EVENTS_IN}, event_type) - 1 = v THEN ({W('v', SECRET, 'event_id')} < {PU!r})::INT
   ELSE ({W('v', SECRET, 'event_id')} < {QU!r})::INT END AS bit FROM ev, range(0, 5) t(v)),
 us AS (SELECT window_id, v, count(*) AS n, sum(bit)::BIGINT AS y FROM ue GROUP BY ALL)"""


def unary_sums(spark, sf):
    index = tr.category_index(F.col("event_type"), cm.EVENT_TYPES)
    return ld.unary_sums(cm.weekly_events(spark, sf), ["window_id"], index, 5, EPS, *_key())


@query("ue_k", f"WITH {UE} SELECT window_id, CAST(v AS INT) AS v, n, y FROM us")
def ue_k(spark, sf):
    return unary_sums(spark, sf)


@query(
    "ue_k_estimate",
    f"WITH {UE} SELECT window_id, CAST(v AS INT) AS v, {R(f'(y - n * {QU!r}) / {PU - QU!r}')} AS estimate, {R(f'n * {QU * (1 - QU) / (PU - QU) ** 2!r}')} AS variance FROM us",
)
def ue_k_estimate(spark, sf):
    est = ld.unary_estimate(unary_sums(spark, sf), EPS)
    return est.select("window_id", "v", r(F.col("estimate")).alias("estimate"), r(F.col("variance")).alias("variance"))


HR = f"""{cm.EV}, h0 AS (SELECT window_id, k, event_id, CAST(floor({U(SECRET, 'event_id', "'hrow'")} * 128) AS BIGINT) AS rw FROM ev),
 hr AS (SELECT event_id, window_id, rw, CASE WHEN {U(SECRET, 'event_id', "'hbit'")} < {P!r} THEN 1 ELSE -1 END * (1 - 2 * (bit_count(rw & k) % 2)) AS bit FROM h0)"""


def hadamard_reports(spark, sf):
    row, bit = ld.hadamard_report(F.col("k"), 100, EPS, *_key())
    return cm.weekly_events(spark, sf).withColumn("row", row).withColumn("bit", bit)


@query("hr_k", f'WITH {HR} SELECT event_id, CAST(rw AS INT) AS "row", CAST(bit AS INT) AS bit FROM hr')
def hr_k(spark, sf):
    return hadamard_reports(spark, sf).select("event_id", "row", "bit")


@query(
    "hr_k_estimate",
    f"""WITH {HR}, s AS (SELECT window_id, rw, sum(bit) AS s, count(*) AS n FROM hr GROUP BY ALL)
SELECT window_id, CAST(v AS INT) AS v, sum(n)::BIGINT AS n, {R(f'sum(s * (1 - 2 * (bit_count(rw & v) % 2))) / {2 * P - 1!r}')} AS estimate, {R(f'sum(n) / {(2 * P - 1) ** 2!r}')} AS variance FROM s, range(0, 100) t(v) GROUP BY ALL""",
)
def hr_k_estimate(spark, sf):
    est = ld.hadamard_estimate(hadamard_reports(spark, sf), ["window_id"], "row", "bit", 100, EPS)
    return est.withColumn("estimate", r(F.col("estimate"))).withColumn("variance", r(F.col("variance")))


D, WID = 4, 16
PS = ld.keep_probability(EPS / 2)


def _col(row: str, value: str) -> str:
    return f"(('0x' || substr(md5('sketch' || '|' || {row} || '|' || {value}), 1, 12))::BIGINT % {WID})"


SK = f"""{cm.EV}, k0 AS (SELECT window_id, event_id, k, CAST(floor({U(SECRET, 'event_id', "'srow'")} * {D}) AS BIGINT) AS rw FROM ev),
 k1 AS (SELECT *, {_col('rw', 'k')} AS cl FROM k0),
 kb AS (SELECT window_id, rw, w, CASE WHEN {W('w', SECRET, 'event_id')} < {PS!r} THEN (cl = w)::INT ELSE 1 - (cl = w)::INT END AS bit FROM k1, range(0, {WID}) t(w)),
 ks AS (SELECT window_id, rw, w, count(*) AS nj, sum(bit)::BIGINT AS y FROM kb GROUP BY ALL)"""


def sketch_sums(spark, sf):
    return ld.sketch_sums(cm.weekly_events(spark, sf), ["window_id"], F.col("k"), D, WID, EPS, *_key())


@query("sketch_wxd", f'WITH {SK} SELECT window_id, CAST(rw AS INT) AS "row", CAST(w AS INT) AS col, nj, y FROM ks')
def sketch_wxd(spark, sf):
    return sketch_sums(spark, sf)


@query(
    "sketch_wxd_estimate",
    f"""WITH {SK}, dom AS (SELECT unnest(range(100)) AS k), c AS (SELECT *, (y - nj * {1 - PS!r}) / {2 * PS - 1!r} AS c FROM ks),
 t AS (SELECT window_id, k, sum(c) AS t FROM dom, c WHERE {_col('rw', 'k')} = w GROUP BY ALL), nn AS (SELECT window_id, sum(nj)::BIGINT AS n FROM ks WHERE w = 0 GROUP BY 1)
SELECT window_id, k, n, {R(f'(t - n / {WID}) * {WID / (WID - 1.0)!r}')} AS estimate, {R(f'n * {PS * (1 - PS) / (2 * PS - 1) ** 2 * (WID / (WID - 1.0)) ** 2!r}')} AS variance FROM t JOIN nn USING (window_id)""",
)
def sketch_wxd_estimate(spark, sf):
    domain = spark.range(100).select(F.col("id").alias("k"))  # public: the reports' own values would give them away
    est = ld.sketch_estimate(sketch_sums(spark, sf), ["window_id"], domain, "k", D, WID, EPS)
    return est.withColumn("estimate", r(F.col("estimate"))).withColumn("variance", r(F.col("variance")))


@query(
    "sample_rate_scale",
    f"WITH {cm.EV} SELECT window_id, {R(f'''count(*) FILTER ({U(repr('s1'), 'event_id')} < 0.25) / 0.25''')} AS scaled FROM ev GROUP BY 1",
)
def sample_rate_scale(spark, sf):
    kept = gates.sampling_gate(cm.weekly_events(spark, sf), 0.25, "s1", ["event_id"])
    return kept.groupBy("window_id").agg(r(ld.scale_by_sample_rate(F.count("*"), 0.25)).alias("scaled"))


# ---- wire messages ----------------------------------------------------------------------------------------------
def reports(spark, sf):
    """Randomized reports: approved dimensions and payload only."""
    row, bit = ld.hadamard_report(F.col("k"), 100, EPS, *_key())
    cell = F.struct(
        F.lit(None).cast("string").alias("geo_bucket"), F.col("event_type").alias("cluster_id"),
        F.lit(None).cast("string").alias("age_bucket"),
    )
    return cm.weekly_events(spark, sf).select(
        F.lit("c_local").alias("contract_id"),
        F.lit("v1").alias("contract_version"),
        F.lit("events_k").alias("feature_id"),
        "window_id",
        cell.alias("cell_key"),
        F.lit("HR_K").alias("mechanism_type"),
        F.struct(F.lit("vector").alias("format"), F.array(row, bit).alias("data")).alias("payload"),
        F.struct(F.unix_millis(F.to_timestamp("day_id")).alias("client_ts_ms"), F.lit(1.0).alias("sample_rate")).alias("metadata"),
    )


REPORT_JSON = """'{"contract_id":"c_local","contract_version":"v1","feature_id":"events_k","window_id":"' || window_id || '","cell_key":{"cluster_id":"' || event_type ||
   '"},"mechanism_type":"HR_K","payload":{"format":"vector","data":[' || rw || ',' || bit || ']}}'"""


@query(
    "randomized_report",
    f"""WITH {HR} SELECT {REPORT_JSON} AS report, count(*) AS n FROM hr JOIN (SELECT event_id, event_type FROM ev) USING (event_id) GROUP BY 1""",
)
def randomized_report(spark, sf):
    rep = reports(spark, sf).drop("metadata")
    return rep.select(F.to_json(F.struct("*")).alias("report")).groupBy("report").agg(F.count("*").alias("n"))


@query(
    "sink_reports_json",
    f"""WITH {HR} SELECT window_id, event_type AS cluster_id, CAST(rw AS INT) AS "row", sum(bit)::BIGINT AS s, count(*) AS n FROM hr JOIN (SELECT event_id, event_type FROM ev) USING (event_id) GROUP BY ALL""",
)
def sink_reports_json(spark, sf):
    """Reports written as JSON lines, read back with the fixed schema, then summed per row."""
    folder = sinks.write_json_lines(reports(spark, sf), "reports")
    back = sinks.read_json_lines(spark, folder, RANDOMIZED_REPORT)
    data = F.col("payload.data")
    return back.groupBy("window_id", F.col("cell_key.cluster_id").alias("cluster_id"), data[0].alias("row")).agg(
        F.sum(data[1]).alias("s"), F.count("*").alias("n")
    )


# ---- shuffle path -----------------------------------------------------------------------------------------------
EPS_LIGHT = 2.0
PL = ld.keep_probability(EPS_LIGHT)
LIGHT = f"""{cm.EV}, cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, event_type ORDER BY ts, event_id) AS rn FROM ev) WHERE rn <= 3),
 msg AS (SELECT event_id, window_id, event_type AS cell, CASE WHEN {U(SECRET, 'event_id', "'rr'")} < {PL!r} THEN (value > 50)::INT ELSE 1 - (value > 50)::INT END AS bit FROM cap)"""


def bounded_bits(spark, sf):
    """Bounded events with a lightly randomized high-value bit."""
    ev = cm.weekly_events(spark, sf).withColumn("cell", F.col("event_type"))
    capped = bounding.contribution_cap(ev, 3, ("contributor", "window_id", "cell"))
    return capped.withColumn("bit", ld.rr_binary(cm.high_value().cast("int"), EPS_LIGHT, *_key()))


def messages(spark, sf):
    return sh.shufflable_messages(
        bounded_bits(spark, sf), F.lit("SHUFFLE_COUNT"), F.lit("bounded_increment"), F.array("bit"), EPS_LIGHT, 1.0
    )


@query("light_local_randomization", f"WITH {LIGHT} SELECT event_id, window_id, cell, bit FROM msg")
def light_local_randomization(spark, sf):
    return bounded_bits(spark, sf).select("event_id", "window_id", "cell", "bit")


@query(
    "shufflable_message",
    f"""WITH {LIGHT} SELECT window_id, cell, 'SHUFFLE_COUNT' AS protocol_type, true AS local_randomization_enabled, 2.0::DOUBLE AS epsilon_local, 'bounded_increment' AS format, bit AS data, 1.0::DOUBLE AS sample_rate FROM msg""",
)
def shufflable_message(spark, sf):
    return messages(spark, sf).withColumn("data", F.col("data")[0])


def run_segments(size: int) -> str:
    """SQL: the run (window) in which the messages of each window of ``msg`` go out, null while they wait."""
    return f"""w AS (SELECT window_id, count(*) AS n, row_number() OVER (ORDER BY window_id) AS i FROM msg GROUP BY 1),
 pools AS (SELECT i, n AS pool, i AS since FROM w WHERE i = 1 UNION ALL
   SELECT w.i, CASE WHEN pool >= {size} THEN w.n ELSE pool + w.n END, CASE WHEN pool >= {size} THEN w.i ELSE since END FROM pools JOIN w ON w.i = pools.i + 1),
 runs AS (SELECT w.window_id, min(p.i) - 1 AS run FROM w LEFT JOIN pools p ON p.pool >= {size} AND w.i BETWEEN p.since AND p.i GROUP BY 1)"""


MIX = 2500


@query(
    "shuffle_mix",
    f"""WITH RECURSIVE {LIGHT}, {run_segments(MIX)},
 m AS (SELECT msg.*, run, count(*) OVER (PARTITION BY run) AS n,
   row_number() OVER (PARTITION BY run ORDER BY {U(SECRET, 'event_id', "'batch'")}, event_id) - 1 AS place FROM msg JOIN runs USING (window_id))
SELECT window_id, run, CASE WHEN run IS NOT NULL THEN place * greatest(1, n // {MIX}) // n END AS batch_id, cell, bit FROM m""",
)
def shuffle_mix(spark, sf):
    """A run a week: messages of weeks that are too short wait and join a later run; what still waits has no batch."""
    bits = bounded_bits(spark, sf).select("event_id", "window_id", "cell", "bit").persist()  # every week reads it
    folder = run_folder(spark, "mixing")
    delete_at_exit(spark, folder)
    mixer = sh.Mixer(folder, MIX, MIX, cm.CONTRACT.secret, ("window_id", "cell", "bit"))
    weeks = [w for (w,) in bits.select("window_id").distinct().orderBy("window_id").collect()]  # a row per run
    for number, week in enumerate(weeks):
        mixer.run(bits.filter(F.col("window_id") == week), number, ["event_id"])
    bits.unpersist()
    fields = bits.select("window_id", "cell", "bit").schema
    out = mixer.mixed(spark, fields).select("window_id", "run", "batch_id", "cell", "bit")
    none = F.lit(None).cast("bigint")
    waiting = mixer.held(spark, fields).filter(F.col("run") == len(weeks) - 1)
    return out.unionByName(waiting.select("window_id", none.alias("run"), none.alias("batch_id"), "cell", "bit"))


SUMS = f"{LIGHT}, a AS (SELECT window_id, cell, count(*) AS n, sum(bit)::BIGINT AS y FROM msg GROUP BY ALL)"
EST = f"((y - n * {1 - PL!r}) / {2 * PL - 1!r})"
VAR = f"(n * {PL * (1 - PL) / (2 * PL - 1) ** 2!r})"


def estimated(spark, sf):
    sums = sh.aggregate_messages(messages(spark, sf), ["window_id", "cell"]).drop("format", "row", "pos")
    return sh.estimate(sums, EPS_LIGHT)


@query("shuffle_estimate", f"WITH {SUMS} SELECT window_id, cell, n, y, {R(EST)} AS estimate_value, {R(VAR)} AS variance FROM a")
def shuffle_estimate(spark, sf):
    e = estimated(spark, sf)
    return e.withColumn("estimate_value", r(F.col("estimate_value"))).withColumn("variance", r(F.col("variance")))


HARD = f"({EST} + 3.0 * {GAUSS(SECRET, 'window_id', 'cell', repr('harden'))})"


@query("shuffle_central_noise", f"WITH {SUMS} SELECT window_id, cell, {R(HARD)} AS estimate_value, {R(VAR + ' + 9.0')} AS variance FROM a")
def shuffle_central_noise(spark, sf):
    h = sh.harden(estimated(spark, sf), 3.0, cm.CONTRACT.secret, ["window_id", "cell"])
    return h.select("window_id", "cell", r(F.col("estimate_value")).alias("estimate_value"), r(F.col("variance")).alias("variance"))


# ---- the whole path ---------------------------------------------------------------------------------------------
RATE, PATH_MIN, RELEASE_TS = 0.5, 300, 1706745600000
PATH = path.ShuffleConfig("c_shuffle", "v1", "events_high_value", cm.CONTRACT.secret, EPS_LIGHT, RATE, noise_sd=3.0)
# dimensions: region of the contributor, kind of event; customers of one segment have not consented, and error events
# belong to a deprecated policy in one region
CLIENT = f"""{cm.EV}, geo AS (SELECT ev.*, coalesce(r_name, 'UNKNOWN') AS geo_bucket, c_mktsegment,
   CASE WHEN r_name IS NULL THEN 'POLICY_DISABLED' WHEN r_name = 'ASIA' THEN 'POLICY_DEPRECATED'
        WHEN c_mktsegment IS NULL OR c_mktsegment = 'MACHINERY' THEN 'POLICY_NO_CONSENT' END AS reason
   FROM ev LEFT JOIN customer ON contributor = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
 smp AS (SELECT * FROM geo WHERE reason IS NULL AND {U(SECRET, 'event_id')} < {RATE}),
 c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id, geo_bucket, event_type ORDER BY ts, event_id) AS a FROM smp) WHERE a <= 3),
 c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contributor, window_id ORDER BY ts, event_id) AS b FROM c1) WHERE b <= 5),
 msg AS (SELECT event_id, window_id, geo_bucket, event_type AS cluster_id, CASE WHEN {U(SECRET, 'event_id', "'rr'")} < {PL!r} THEN (value > 50)::INT ELSE 1 - (value > 50)::INT END AS bit FROM c2)"""


def shuffled(spark, sf):
    """(mixed, held, rejects) of the client and shuffler stages over all weeks, a run a week."""
    people = (
        tables.table(spark, sf, "customer")
        .join(tables.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(tables.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(F.col("c_custkey").alias("contributor"), F.col("r_name").alias("region"), "c_mktsegment")
    )
    events = cm.weekly_events(spark, sf).join(people.drop("c_mktsegment"), "contributor", "left").select(
        "event_id", "contributor", "ts", "window_id", "value", F.coalesce("region", F.lit("UNKNOWN")).alias("region"),
        F.col("region").alias("geo_bucket"), F.col("event_type").alias("cluster_id"), F.lit(None).cast("string").alias("age_bucket"),
    )
    policies = tables.table(spark, sf, "region").select(
        F.lit(PATH.feature_id).alias("feature_id"), F.col("r_name").alias("region"), F.lit(True).alias("enabled"),
        (F.col("r_name") == "ASIA").alias("deprecated"),
    )
    consent = people.filter("c_mktsegment <> 'MACHINERY'").select("contributor")
    messages, rejects = path.client(events, policies, consent, PATH, F.col("value") > 50)
    messages = store(messages, "messages")  # counted per run and checked; the runs then read it
    folder = run_folder(spark, "mixing")
    delete_at_exit(spark, folder)
    mixer = sh.Mixer(folder, PATH_MIN, PATH_MIN, PATH.secret, path.PAYLOAD)
    weeks = [w for (w,) in messages.select("window_id").distinct().orderBy("window_id").collect()]  # a row per run
    mixed, held, bad = path.shuffler(messages, shuffle_contracts(spark), mixer, PATH, weeks)
    return mixed, held, rejects.unionByName(bad)


def shuffle_contracts(spark):
    row = (PATH.feature_id, "SHUFFLE", PATH.contract_version)
    contract = spark.createDataFrame([row], "feature_id string, boundary string, contract_version string")
    return gates.allowed_contracts(contract, 3)


HARD_PATH = f"({EST} / {RATE} + 3.0 * {GAUSS(SECRET, 'window_id', 'geo_bucket', 'cluster_id', repr('UNKNOWN'), repr('harden'))})"
VAR_PATH = f"({VAR} / {RATE * RATE} + 9.0)"


@query(
    "shuffle_release",
    f"""WITH RECURSIVE {CLIENT}, {run_segments(PATH_MIN)},
 a AS (SELECT window_id, geo_bucket, cluster_id, count(*) AS n, sum(bit)::BIGINT AS y FROM msg JOIN runs USING (window_id) WHERE run IS NOT NULL GROUP BY ALL)
SELECT 'c_shuffle' AS contract_id, 'v1' AS contract_version, 'events_high_value' AS feature_id, window_id, geo_bucket, cluster_id, 'UNKNOWN' AS age_bucket,
  {R(HARD_PATH)} AS estimate_value, {R(VAR_PATH)} AS variance, {R(f'{HARD_PATH} - 1.959964 * sqrt({VAR_PATH})')} AS ci_lower, {R(f'{HARD_PATH} + 1.959964 * sqrt({VAR_PATH})')} AS ci_upper,
  'SHUFFLE_COUNT' AS protocol_type, true AS local_randomization_enabled, 2.0::DOUBLE AS epsilon_local, {RATE}::DOUBLE AS sample_rate, {RELEASE_TS} AS release_ts_ms FROM a""",
)
def shuffle_release(spark, sf):
    """From events to released rows: client gates, sampling, caps, randomized bits, mixing over weeks, server checks, noise."""
    mixed, _, _ = shuffled(spark, sf)
    out = path.server(mixed, shuffle_contracts(spark), PATH, RELEASE_TS)
    return out.withColumns({c: r(F.col(c)) for c in ("estimate_value", "variance", "ci_lower", "ci_upper")})


@query(
    "shuffle_audit",
    f"""WITH RECURSIVE {CLIENT}, {run_segments(PATH_MIN)}
SELECT 'client' AS stage, reason, count(*) AS n FROM geo WHERE reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'shuffler', CASE WHEN run IS NULL THEN 'HELD' ELSE 'MIXED' END, count(*) FROM msg JOIN runs USING (window_id) GROUP BY ALL""",
)
def shuffle_audit(spark, sf):
    """What became of events that were not left out by sampling and caps: rejected with a reason, mixed, or still held."""
    mixed, held, rejects = shuffled(spark, sf)

    def at_shuffler(df, reason):
        return df.select(F.lit("shuffler").alias("stage"), F.lit(reason).alias("reason"))

    rows = rejects.select("stage", F.col(gates.REASON).alias("reason"))
    rows = rows.unionByName(at_shuffler(mixed, "MIXED")).unionByName(at_shuffler(held, "HELD"))
    return rows.groupBy("stage", "reason").agg(F.count("*").alias("n"))
