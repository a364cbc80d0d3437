"""Validation gates over events, messages, contracts and the part-derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import bounding, gates
from veilgrain.queries import common as cm
from veilgrain.queries.registry import U, query
from veilgrain.sources import tables

DEFS_SQL = """defs AS (
  SELECT CASE WHEN p_retailprice < 905 THEN '' ELSE 'f_' || p_partkey END AS feature_id,
         CASE WHEN p_size = 50 THEN '' ELSE 'v' || p_size END AS feature_version,
         CASE p_type WHEN 'ECONOMY' THEN 'COUNT' WHEN 'SMALL' THEN 'MEDIAN' ELSE 'MEAN_BOUNDED_0_1' END AS query_type,
         p_size * 7 - 14 AS retention_days,
         CASE WHEN p_type = 'LARGE' THEN ['LOCAL', 'EDGE'] ELSE ['LOCAL', 'SHUFFLE', 'CENTRAL'] END AS b,
         CASE WHEN p_brand = 'Brand#7' THEN ['ITEM', 'USER'] ELSE ['ITEM', 'CLUSTER'] END AS g, p_partkey
  FROM part)"""


def feature_defs(spark, sf):
    return tables.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_retailprice") < 905, "").otherwise(F.concat(F.lit("f_"), "p_partkey")).alias("feature_id"),
        F.when(F.col("p_size") == 50, "").otherwise(F.concat(F.lit("v"), "p_size")).alias("feature_version"),
        F.when(F.col("p_type") == "ECONOMY", "COUNT")
        .when(F.col("p_type") == "SMALL", "MEDIAN")
        .otherwise("MEAN_BOUNDED_0_1")
        .alias("query_type"),
        (F.col("p_size") * 7 - 14).alias("retention_days"),
        F.when(F.col("p_type") == "LARGE", F.array(F.lit("LOCAL"), F.lit("EDGE")))
        .otherwise(F.array(F.lit("LOCAL"), F.lit("SHUFFLE"), F.lit("CENTRAL")))
        .alias("boundary_capabilities"),
        F.when(F.col("p_brand") == "Brand#7", F.array(F.lit("ITEM"), F.lit("USER")))
        .otherwise(F.array(F.lit("ITEM"), F.lit("CLUSTER")))
        .alias("granularity_candidates"),
    )


@query(
    "validate_feature_rows",
    f"""WITH {DEFS_SQL}
SELECT p_partkey, array_to_string(list_sort(list_filter([
  CASE WHEN length(feature_id) = 0 THEN 'MISSING_ID' END,
  CASE WHEN length(feature_version) = 0 THEN 'MISSING_VERSION' END,
  CASE WHEN query_type NOT IN ('MEAN_BOUNDED_0_1', 'COUNT') THEN 'BAD_QUERY_TYPE' END,
  CASE WHEN retention_days < 0 THEN 'NEGATIVE_RETENTION' END,
  CASE WHEN NOT list_has_all(['LOCAL', 'SHUFFLE', 'CENTRAL'], b) THEN 'BAD_BOUNDARY' END,
  CASE WHEN NOT list_has_all(['ITEM', 'CLUSTER', 'AGGREGATE'], g) THEN 'BAD_GRANULARITY' END],
  lambda x: x IS NOT NULL)), ',') AS errors
FROM defs""",
)
def validate_feature_rows(spark, sf):
    return gates.validate_features(feature_defs(spark, sf)).select(
        "p_partkey", F.array_join("errors", ",").alias("errors")
    )


@query(
    "validate_policy_rows",
    """WITH pol AS (
  SELECT s_suppkey, s_acctbal / 10000 AS w_link, 0.25::DOUBLE AS w_uniq, 0.25::DOUBLE AS w_infer,
         CASE WHEN s_nationkey < 12 THEN 0.5 - s_acctbal / 10000 ELSE 0.25 END AS w_policy,
         CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey / 25.0 END::DOUBLE AS tau_low, 0.75::DOUBLE AS tau_high,
         s_nationkey AS k_min
  FROM supplier)
SELECT s_suppkey, array_to_string(list_sort(list_filter([
  CASE WHEN tau_low IS NULL THEN 'MISSING_THRESHOLDS' END,
  CASE WHEN least(w_link, w_uniq, w_infer, w_policy) < 0 THEN 'NEGATIVE_WEIGHT' END,
  CASE WHEN abs(w_link + w_uniq + w_infer + w_policy - 1.0) > 1e-9 THEN 'WEIGHTS_NOT_ONE' END,
  CASE WHEN tau_low IS NULL OR tau_low NOT BETWEEN 0 AND 1 THEN 'THRESHOLD_RANGE' END,
  CASE WHEN tau_low IS NULL OR tau_low > tau_high THEN 'BANDS_CROSSED' END,
  CASE WHEN k_min < 1 THEN 'BAD_K' END], lambda x: x IS NOT NULL)), ',') AS errors
FROM pol""",
)
def validate_policy_rows(spark, sf):
    w = F.col("s_acctbal") / 10000
    pol = tables.table(spark, sf, "supplier").select(
        "s_suppkey",
        w.alias("w_link"),
        F.lit(0.25).alias("w_uniq"),
        F.lit(0.25).alias("w_infer"),
        F.when(F.col("s_nationkey") < 12, 0.5 - w).otherwise(0.25).alias("w_policy"),
        F.when(F.col("s_nationkey") != 3, F.col("s_nationkey") / 25.0).alias("tau_low"),
        F.lit(0.75).alias("tau_high"),
        F.col("s_nationkey").alias("k_min"),
    )
    return gates.validate_policies(pol).select("s_suppkey", F.array_join("errors", ",").alias("errors"))


@query(
    "contract_gate",
    f"""WITH {cm.CONTRACTS}, allowed AS (
  SELECT feature_id, max_by(boundary, contract_version) AS cb, max(contract_version) AS active, list(contract_version) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY contract_version DESC) rn FROM contracts)
  WHERE rn <= 3 GROUP BY feature_id)
SELECT event_id, CASE WHEN active IS NULL THEN 'REJECT_CONTRACT:NO_ACTIVE_CONTRACT'
  WHEN cb <> 'CENTRAL' THEN 'REJECT_CONTRACT:BOUNDARY'
  WHEN NOT list_contains(v, window_id) THEN 'REJECT_CONTRACT:VERSION' END AS reject_reason
FROM ev LEFT JOIN allowed ON event_type = feature_id""",
)
def contract_gate(spark, sf):
    ev = cm.weekly_events(spark, sf).select(
        "event_id", F.col("event_type").alias("feature_id"), F.col("window_id").alias("contract_version")
    )
    allowed = gates.allowed_contracts(cm.contracts(spark, sf), keep=3)
    return gates.contract_gate(ev, allowed, "CENTRAL").select("event_id", "reject_reason")


@query(
    "lateness_gate",
    f"""WITH {cm.EV}
SELECT event_id, CASE WHEN NOT regexp_full_match(window_id, '2024-01-[0-9]{{2}}') THEN 'REJECT_CONTRACT:WINDOW_ID'
  WHEN value > 120 THEN 'REJECT_CONTRACT:LATE' END AS reject_reason
FROM ev""",
)
def lateness_gate(spark, sf):
    """The value column doubles as delivery delay in minutes; two hours are allowed."""
    ev = cm.weekly_events(spark, sf).withColumn(
        "ingest_ts", F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"), secs=F.lit(0))
        + F.when(F.col("value") > F.floor("value"), F.expr("INTERVAL 1 SECOND")).otherwise(F.expr("INTERVAL 0 SECOND"))
    )
    gated = gates.lateness_gate(ev, "ts", "ingest_ts", F.expr("INTERVAL 2 HOURS"), r"^2024-01-\d{2}$")
    return gated.select("event_id", "reject_reason")


@query(
    "schema_gate",
    """SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(props, '"k": *([^}]*)', 1) AS BIGINT) IS NULL
    THEN 'REJECT_SCHEMA:MISSING_k_text'
  WHEN event_type = 'signup' THEN 'REJECT_SCHEMA:FORBIDDEN_email'
  WHEN TRY_CAST(CASE WHEN value > 100 THEN value || 'USD' ELSE value::VARCHAR END AS DOUBLE) IS NULL
    THEN 'REJECT_SCHEMA:TYPE_amount' END AS reject_reason
FROM events""",
)
def schema_gate(spark, sf):
    raw = tables.table(spark, sf, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k_text"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("u"), "user_id", F.lit("@x"))).alias("email"),
        F.when(F.col("value") > 100, F.concat(F.col("value").cast("string"), F.lit("USD")))
        .otherwise(F.col("value").cast("string"))
        .alias("amount"),
    )
    return gates.schema_gate(raw, ["event_id", "k_text"], ["email"], {"k_text": "bigint", "amount": "double"}).select(
        "event_id", "reject_reason"
    )


@query(
    "dim_domain_gate",
    f"""WITH {cm.EV}
SELECT event_id, CASE WHEN value < 5 THEN 'UNKNOWN' ELSE CASE WHEN value > 300 THEN 'TV' ELSE 'WEB' END END AS device,
  CASE WHEN k < 3 THEN 'REJECT_DIM:item_id'
       WHEN event_type = 'error' THEN 'REJECT_DOMAIN:event_type'
       WHEN value >= 5 AND value > 300 THEN 'REJECT_DOMAIN:device'
       WHEN k >= 90 THEN 'REJECT_DOMAIN:item_id' END AS reject_reason
FROM ev""",
)
def dim_domain_gate(spark, sf):
    ev = cm.weekly_events(spark, sf).select(
        "event_id",
        "event_type",
        F.when(F.col("value") >= 5, F.when(F.col("value") > 300, "TV").otherwise("WEB")).alias("device"),
        F.when(F.col("k") >= 3, F.concat(F.when(F.col("k") >= 90, "x").otherwise("i"), F.col("k"))).alias("item_id"),
    )
    gated = gates.dim_domain_gate(
        ev,
        {"event_type": ["click", "purchase", "signup", "view"], "device": ["WEB", "APP"]},
        {"item_id": r"^i\d+$"},
        allow_unknown=["device"],
    )
    return gated.select("event_id", "device", "reject_reason")


PAYLOAD_REASON = """CASE WHEN format = 'bounded_increment' AND NOT inc BETWEEN 0 AND 2 THEN 'REJECT_PAYLOAD_INCREMENT'
  WHEN format = 'category' AND NOT cat BETWEEN 0 AND 3 THEN 'REJECT_PAYLOAD_CATEGORY'
  WHEN format = 'sketch' AND NOT (srow BETWEEN 0 AND 7 AND scol BETWEEN 0 AND 23 AND supd BETWEEN 0 AND 4)
    THEN 'REJECT_PAYLOAD_SKETCH' END"""


@query("payload_gate", f"WITH {cm.MESSAGES} SELECT event_id, {PAYLOAD_REASON} AS reject_reason FROM msg")
def payload_gate(spark, sf):
    gated = gates.payload_gate(cm.messages(spark, sf), cap=2, categories=4, width=24, depth=8, max_update=4)
    return gated.select("event_id", "reject_reason")


@query(
    "event_sanity_gate",
    f"""WITH {cm.EV}, cell AS (
  SELECT day_id, k, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS clicks,
         sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS impressions FROM ev GROUP BY 1, 2)
SELECT day_id, k, clicks::BIGINT AS clicks, impressions::BIGINT AS impressions,
  CASE WHEN clicks > impressions THEN 'INVALID_EVENT' END AS reject_reason FROM cell""",
)
def event_sanity_gate(spark, sf):
    """Views stand for impressions, so cells with more clicks than views are inconsistent reports."""
    cells = cm.weekly_events(spark, sf).groupBy("day_id", "k").agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "view").alias("impressions"),
    )
    return gates.event_sanity_gate(cells)


@query(
    "boundary_mismatch_gate",
    f"""WITH {cm.CONTRACTS}, act AS (
  SELECT feature_id, max_by(boundary, contract_version) AS boundary FROM contracts GROUP BY 1)
SELECT event_id, CASE WHEN boundary IS NULL THEN 'NO_CONTRACT'
  WHEN CASE WHEN value < 40 THEN 'CENTRAL' ELSE 'SHUFFLE' END <> boundary THEN 'BOUNDARY_MISMATCH' END AS reject_reason
FROM ev LEFT JOIN act ON event_type = feature_id""",
)
def boundary_mismatch_gate(spark, sf):
    requests = cm.weekly_events(spark, sf).select(
        "event_id",
        F.col("event_type").alias("feature_id"),
        F.when(F.col("value") < 40, "CENTRAL").otherwise("SHUFFLE").alias("boundary"),
    )
    active = (
        cm.contracts(spark, sf).groupBy("feature_id").agg(F.max_by("boundary", "contract_version").alias("boundary"))
    )
    return gates.boundary_mismatch_gate(requests, active).select("event_id", "reject_reason")


@query(
    "shuffle_ops_gate",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linestatus <> 'F' THEN NULL
  WHEN l_quantity > 40 THEN 'SHUFFLE_OP_NOT_ALLOWED' WHEN l_quantity > 24 THEN 'SHUFFLE_WINDOW_TOO_LONG'
  WHEN l_discount > 0.08 THEN 'SHUFFLE_USER_STATE' WHEN l_tax > 0.06 THEN 'SHUFFLE_LONGITUDINAL_JOIN' END AS reject_reason
FROM lineitem""",
)
def shuffle_ops_gate(spark, sf):
    requests = tables.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        F.when(F.col("l_linestatus") == "F", "SHUFFLE").otherwise("CENTRAL").alias("boundary"),
        F.when(F.col("l_quantity") > 40, "median").otherwise("count").alias("operation"),
        F.col("l_quantity").alias("window_hours"),
        (F.col("l_discount") > 0.08).alias("per_user_state"),
        (F.col("l_tax") > 0.06).alias("longitudinal_join"),
    )
    return gates.shuffle_ops_gate(requests, 24).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "reject_reason"
    )


@query(
    "policy_gate",
    f"""WITH {cm.EV}, geo AS (
  SELECT c_custkey, r_name AS region, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
used AS (SELECT ev.*, region FROM ev JOIN geo ON contributor = c_custkey),
pol AS (SELECT event_type, region, region <> 'ASIA' OR event_type <> 'signup' AS enabled,
               max(value) > 450 AS deprecated FROM used GROUP BY ALL)
SELECT event_id, CASE WHEN enabled IS NULL OR NOT enabled THEN 'POLICY_DISABLED' WHEN deprecated THEN 'POLICY_DEPRECATED'
  WHEN NOT EXISTS (SELECT 1 FROM geo WHERE c_custkey = contributor AND c_acctbal >= 0) THEN 'POLICY_NO_CONSENT' END AS reject_reason
FROM used LEFT JOIN pol USING (event_type, region)""",
)
def policy_gate(spark, sf):
    customer = tables.table(spark, sf, "customer")
    nation, region = tables.table(spark, sf, "nation"), tables.table(spark, sf, "region")
    geo = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("contributor"), F.col("r_name").alias("region"))
    )
    ev = cm.weekly_events(spark, sf).withColumnRenamed("event_type", "feature_id").join(geo, "contributor")
    policies = (
        ev.groupBy("feature_id", "region")
        .agg((F.max("value") > 450).alias("deprecated"))
        .withColumn("enabled", (F.col("region") != "ASIA") | (F.col("feature_id") != "signup"))
    )
    consent = customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("contributor"))
    return gates.policy_gate(ev, policies, consent).select("event_id", "reject_reason")


@query(
    "sampling_gate",
    f"WITH {cm.EV} SELECT event_id, window_id FROM ev "
    f"WHERE {U(repr('seed7'), 'contributor', 'event_type', 'window_id', 'event_id')} < 0.3",
)
def sampling_gate(spark, sf):
    keys = ["contributor", "event_type", "window_id", "event_id"]
    return gates.sampling_gate(cm.weekly_events(spark, sf), 0.3, "seed7", keys).select("event_id", "window_id")


@query(
    "frequency_cap",
    f"""WITH {cm.EV}, c AS (SELECT *, row_number() OVER (PARTITION BY contributor, day_id, event_type ORDER BY ts, event_id) a FROM ev),
d AS (SELECT *, row_number() OVER (PARTITION BY contributor, day_id ORDER BY ts, event_id) b FROM c WHERE a <= 1)
SELECT event_id, contributor, day_id AS window_id, event_type AS cell FROM d WHERE b <= 2""",
)
def frequency_cap(spark, sf):
    ev = cm.weekly_events(spark, sf).select(
        "event_id", "contributor", "ts", F.col("day_id").alias("window_id"), F.col("event_type").alias("cell")
    )
    return bounding.frequency_cap(ev, per_window=2, per_cell=1).drop("ts")


@query(
    "message_size_gate",
    f"""WITH {cm.EV} SELECT event_id, CASE WHEN length('{{"event_id":' || event_id || ',"event_type":"' || event_type ||
  '","k":' || k || '}}') > 42 THEN 'REJECT_SCHEMA:MESSAGE_TOO_LARGE' END AS reject_reason FROM ev""",
)
def message_size_gate(spark, sf):
    ev = cm.weekly_events(spark, sf).select("event_id", "event_type", "k")
    return gates.message_size_gate(ev, 42).select("event_id", "reject_reason")


@query(
    "identifier_elimination",
    f"WITH {cm.EV} SELECT event_type, k, value, window_id, day_id FROM ev",
)
def identifier_elimination(spark, sf):
    return gates.eliminate_identifiers(cm.weekly_events(spark, sf), ["event_id", "contributor", "ts"])


@query(
    "leak_guard",
    """SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'en')""",
)
def leak_guard(spark, sf):
    """Rows in which a released column carries a value of a protected id list (the sources of English text)."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "lang", "source")
    protected = docs.filter("lang = 'en'").select("source")
    gates.leak_guard(docs, ["user_id", "contributor"])
    return gates.leaked_values(docs, ["lang", "source"], protected, "source").select("doc_id")
