"""Transforms and set operations (SURVEY 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import bounding, gates
from veilgrain.operators import transforms as tr
from veilgrain.queries import common as cm
from veilgrain.queries.catalog import CAT, CAT_FIELDS, catalog
from veilgrain.queries.registry import query
from veilgrain.sources import tables


@query(
    "bucketize_time",
    """SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour_id, strftime(ts, '%Y-%m-%d') AS day_id,
  strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_id, strftime(ts, '%Y-%m') AS month_id FROM events""",
)
def bucketize_time(spark, sf):
    ev = tables.events(spark, sf)
    for g in ("hour", "day", "week", "month"):
        ev = tr.bucketize_time(ev, "ts", g, f"{g}_id")
    return ev.select("event_id", "hour_id", "day_id", "week_id", "month_id")


@query(
    "bucketize_geo",
    f"""WITH {cm.EV} SELECT event_id, coalesce(r_name, 'UNKNOWN') AS geo_bucket FROM ev
  LEFT JOIN customer ON contributor = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def bucketize_geo(spark, sf):
    """Region as the coarse bucket; a contributor without one shows up as UNKNOWN."""
    nation = tables.table(spark, sf, "nation")
    region = tables.table(spark, sf, "region")
    mapping = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("geo_bucket")
    )
    customer = tables.table(spark, sf, "customer").select(F.col("c_custkey").alias("contributor"), "c_nationkey")
    ev = tables.events(spark, sf).select("event_id", "contributor").join(customer, "contributor", "left")
    return tr.map_dimension(ev, mapping, "c_nationkey", "geo_bucket").select("event_id", "geo_bucket")


@query(
    "bucketize_numeric",
    """SELECT event_id, CAST(greatest(0, least(7, floor((value - 0) / 200.0 * 8))) AS INT) AS value_bucket FROM events""",
)
def bucketize_numeric(spark, sf):
    return tables.events(spark, sf).select("event_id", tr.numeric_bucket(F.col("value"), 0, 200, 8).alias("value_bucket"))


@query(
    "item_to_cluster",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_brand, 'UNKNOWN') AS cluster_id
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def item_to_cluster(spark, sf):
    mapping = tables.table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("cluster_id")
    )
    lines = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tr.map_dimension(lines, mapping, "l_partkey", "cluster_id")


@query(
    "clip_numeric",
    "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0.0, least(50000.0, l_extendedprice)) AS clipped FROM lineitem",
)
def clip_numeric(spark, sf):
    return tables.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", tr.clip_numeric(F.col("l_extendedprice"), 0, 50000).alias("clipped")
    )


@query("cell_key", f"WITH {cm.LADDER} SELECT event_id, level, lvl, cell, window_id || '|' || cell AS cell_key FROM lad")
def cell_key(spark, sf):
    return cm.laddered_events(spark, sf).select(
        "event_id", "level", "lvl", "cell", tr.cell_key("window_id", "cell").alias("cell_key")
    )


def _h(salt: str, expr: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5('{salt}' || '|' || {expr}), 1, 12))::BIGINT % {n} AS INT)"


@query(
    "encode_contribution",
    f"""WITH {cm.EV} SELECT event_id, 1 AS increment,
  CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS INT) AS category,
  array_to_string(list_transform(range(0, 5), lambda i: CASE WHEN i = list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 THEN 1 ELSE 0 END), '') AS one_hot,
  {_h('row', 'event_id', 4)} AS sketch_row, {_h('col', 'k', 16)} AS sketch_col
FROM ev""",
)
def encode_contribution(spark, sf):
    category = tr.category_index(F.col("event_type"), cm.EVENT_TYPES)
    return tables.events(spark, sf).select(
        "event_id",
        F.lit(1).alias("increment"),
        category.alias("category"),
        F.array_join(tr.one_hot(category, 5).cast("array<string>"), "").alias("one_hot"),
        tr.hash_bucket(F.col("event_id"), "row", 4).alias("sketch_row"),
        tr.hash_bucket(F.col("k"), "col", 16).alias("sketch_col"),
    )


@query(
    "policy_safe_schema",
    f"""WITH {CAT}, {CAT_FIELDS}, kept AS (
  SELECT feature_id, string_agg(name, ',' ORDER BY pos) AS safe_fields,
         string_agg(CASE WHEN dtype IN ('int', 'float') THEN name END, ',' ORDER BY pos) AS clipped_fields,
         string_agg(CASE WHEN buckets IS NOT NULL THEN name || '=' || greatest(2, buckets // 2) END, ',' ORDER BY name) AS safe_buckets
  FROM fld WHERE name NOT IN ('device_id', 'uid') GROUP BY feature_id)
SELECT cat.feature_id, coalesce(safe_fields, '') AS safe_fields, coalesce(clipped_fields, '') AS clipped_fields,
  coalesce(safe_buckets, '') AS safe_buckets, CASE WHEN p_size >= 15 AND p_type = 'STANDARD' THEN 'zip' ELSE '' END AS safe_join_keys
FROM cat LEFT JOIN kept USING (feature_id)""",
)
def policy_safe_schema(spark, sf):
    safe = tr.policy_safe_schema(catalog(spark, sf), ["device_id", "uid"])
    buckets = F.transform(
        F.array_sort(F.map_entries("safe_buckets")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))
    )
    return safe.select(
        "feature_id",
        F.array_join("safe_fields", ",").alias("safe_fields"),
        F.array_join("clipped_fields", ",").alias("clipped_fields"),
        F.array_join(buckets, ",").alias("safe_buckets"),
        F.array_join("safe_join_keys", ",").alias("safe_join_keys"),
    )


@query(
    "coarsen_buckets",
    f"""WITH {CAT}, {CAT_FIELDS} SELECT feature_id, name, CAST(greatest(2, buckets // 2) AS INT) AS buckets,
  CAST(buckets // 2 AS INT) AS merged FROM fld WHERE buckets IS NOT NULL""",
)
def coarsen_buckets(spark, sf):
    specs = catalog(spark, sf).select("feature_id", "bucketizations")
    halved = tr.coarsen_bucketizations(F.col("bucketizations"))
    return specs.select("feature_id", "bucketizations", F.explode(halved).alias("name", "buckets")).select(
        "feature_id", "name", "buckets", tr.coarsen_bucket(F.element_at("bucketizations", F.col("name"))).alias("merged")
    )


# ---- set operations ---------------------------------------------------------------------------------------------
@query(
    "except_identifiers",
    f"""WITH {CAT}, {CAT_FIELDS} SELECT feature_id, name FROM fld WHERE NOT is_identifier""",
)
def except_identifiers(spark, sf):
    named = catalog(spark, sf).select("feature_id", F.explode("fields").alias("f"))
    return named.select("feature_id", "f.name").exceptAll(named.filter("f.is_identifier").select("feature_id", "f.name"))


@query(
    "intersect_join_keys",
    f"""WITH {CAT}, {CAT_FIELDS}, jk AS (SELECT feature_id, unnest(join_keys).name AS name FROM cat)
SELECT feature_id, name FROM jk INTERSECT SELECT feature_id, name FROM fld""",
)
def intersect_join_keys(spark, sf):
    specs = catalog(spark, sf)
    keys = specs.select("feature_id", F.explode("join_keys").alias("k")).select("feature_id", "k.name")
    fields = specs.select("feature_id", F.explode("fields").alias("f")).select("feature_id", "f.name")
    return keys.intersect(fields)


@query(
    "union_audit",
    f"""WITH {cm.MESSAGES}, d AS (
  SELECT event_type AS feature_id, 'REJECT_PAYLOAD' AS audit_event,
         CASE WHEN format = 'bounded_increment' AND inc > 2 THEN 'REJECT_PAYLOAD_INCREMENT'
              WHEN format = 'category' AND cat > 3 THEN 'REJECT_PAYLOAD_CATEGORY'
              WHEN format = 'sketch' AND (srow > 7 OR scol > 23 OR supd > 4) THEN 'REJECT_PAYLOAD_SKETCH' END AS reason
  FROM msg
  UNION ALL SELECT event_type, 'REJECT_LATE', CASE WHEN value > 120 THEN 'REJECT_CONTRACT:LATE' END FROM ev)
SELECT feature_id, audit_event, '{{"reason":"' || reason || '"}}' AS details_json, count(*) AS n
FROM d WHERE reason IS NOT NULL GROUP BY ALL""",
)
def union_audit(spark, sf):
    payload = gates.payload_gate(cm.messages(spark, sf), cap=2, categories=4, width=24, depth=8, max_update=4)
    late = gates.label(cm.weekly_events(spark, sf), [("REJECT_CONTRACT:LATE", F.col("value") <= 120)])
    audit = gates.audit_rows(gates.rejected(payload), "REJECT_PAYLOAD", "event_type", "ts").unionByName(
        gates.audit_rows(gates.rejected(late), "REJECT_LATE", "event_type", "ts")
    )
    return audit.groupBy("feature_id", F.col("event_type").alias("audit_event"), "details_json").agg(
        F.count("*").alias("n")
    )


@query(
    "dedupe_events",
    f"""WITH {cm.EV}, twice AS (SELECT * FROM ev UNION ALL SELECT event_id, contributor, ts + INTERVAL 1 MINUTE, event_type, k, value, window_id, day_id FROM ev)
SELECT event_id, contributor, ts, event_type, k, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM twice) WHERE rn = 1""",
)
def dedupe_events(spark, sf):
    """Every event is delivered twice, a minute apart; the first delivery stays."""
    ev = tables.events(spark, sf)
    again = ev.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    return bounding.dedupe(ev.unionByName(again), "event_id", ["ts"])
