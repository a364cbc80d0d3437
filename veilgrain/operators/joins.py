"""Joins of the governance model: ledger ranges, as-of contracts, option products, join-graph degree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilgrain.operators import gates
from veilgrain.operators.ranking import with_global_rank
from veilgrain.schema import BOUNDARIES, GRANULARITIES


def ledger_range_join(asof: DataFrame, ledger: DataFrame, window_days: int) -> DataFrame:
    """Epsilon and delta spent in [asof - window_days + 1, asof] for every (feature_id, asof).

    The ledger is summed per day first. Days are cut into buckets of ``window_days``; each as-of date meets
    only the two buckets its range can touch, so the join stays an equi join.
    """
    day_no = F.unix_date("window_day")
    daily = ledger.groupBy("feature_id", "window_day").agg(
        F.sum("epsilon_spend").alias("eps"), F.sum("delta_spend").alias("dlt")
    )
    daily = daily.withColumn("bucket", F.floor(day_no / window_days))
    last = F.unix_date("asof")
    probes = asof.select("feature_id", "asof").distinct()
    probes = probes.withColumn(
        "bucket",
        F.explode(
            F.array_distinct(
                F.array(F.floor((last - (window_days - 1)) / window_days), F.floor(last / window_days))
            )
        ),
    )
    in_range = (F.col("window_day") <= F.col("asof")) & (F.col("window_day") > F.date_sub("asof", window_days))
    hits = probes.join(daily, ["feature_id", "bucket"], "left")
    return hits.groupBy("feature_id", "asof").agg(
        F.coalesce(F.sum(F.when(in_range, F.col("eps"))), F.lit(0.0)).alias("spent_epsilon"),
        F.coalesce(F.sum(F.when(in_range, F.col("dlt"))), F.lit(0.0)).alias("spent_delta"),
    )


def asof_contract_gate(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """Every event with the contract in force at its time: the newest one issued no later than the event.

    An event of a feature without contracts, before the first one, or without a time is rejected as NO_CONTRACT. Contracts are
    gathered to one row per feature with its versions in order of issue; an event meets that row once and finds its version by
    halving, in as many steps as the number of versions has bits. Of versions issued at once the greatest counts.
    """
    terms = [c for c in contracts.columns if c not in ("feature_id", "issued_at")]
    timed = contracts.filter("issued_at IS NOT NULL")
    versions = timed.groupBy("feature_id").agg(F.sort_array(F.collect_list(F.struct("issued_at", *terms))).alias("_versions"))
    steps = F.expr("sequence(1, length(bin(size(_versions))))")
    searched = versions.withColumn("_steps", steps)
    start = F.struct(F.lit(0).alias("lo"), F.size("_versions").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        early = F.get(F.col("_versions"), middle)["issued_at"] <= F.col("ts")
        lo = F.when((acc["lo"] < acc["hi"]) & early, middle + 1).otherwise(acc["lo"])
        hi = F.when((acc["lo"] < acc["hi"]) & ~early, middle).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    joined = events.join(searched, "feature_id", "left")
    place = F.when(F.col("ts").isNotNull(), F.aggregate("_steps", start, halve)["lo"] - 1)
    found = joined.withColumn("_found", F.when(place >= 0, F.get(F.col("_versions"), place)))
    named = found.select(*events.columns, F.col("_found.issued_at").alias("issued_at"), *[F.col(f"_found.{c}").alias(c) for c in terms])
    return gates.label(named, [("NO_CONTRACT", F.col("issued_at").isNotNull())])


def asof_contract(events: DataFrame, contracts: DataFrame) -> DataFrame:
    """The events that pass :func:`asof_contract_gate`, with their contracts."""
    return gates.passed(asof_contract_gate(events, contracts))


def with_options(features: DataFrame) -> DataFrame:
    """Each feature with all boundary x granularity options, from a literal array: nine rows per feature."""
    options = F.array(
        *[
            F.struct(F.lit(b).alias("boundary"), F.lit(g).alias("granularity"))
            for b in BOUNDARIES
            for g in GRANULARITIES
        ]
    )
    return features.withColumn("_o", F.explode(options)).select("*", "_o.*").drop("_o")


def candidate_pairs(features: DataFrame) -> DataFrame:
    """Boundary capabilities x granularity candidates of each feature."""
    return features.withColumn("boundary", F.explode("boundary_capabilities")).withColumn(
        "granularity", F.explode("granularity_candidates")
    )


def deny_pairs(pairs: DataFrame, denied: DataFrame) -> DataFrame:
    """Drop pairs whose boundary a policy denies to the feature."""
    return pairs.join(denied.select("feature_id", "boundary").distinct(), ["feature_id", "boundary"], "left_anti")


def join_degree(datasets: DataFrame, id_col: str, keys: str) -> DataFrame:
    """How many other datasets share at least one join key with each dataset.

    Datasets are numbered without gaps, and every key has a bitmap of the datasets that hold it, cut into pieces of 32,768
    numbers. The datasets that a key set meets are the union of its keys' bitmaps, so its degree is a count of bits, for few keys and for
    many; each distinct key set is looked up once. Null keys count as absent; a dataset without keys has degree 0.
    """
    tagged = datasets.withColumn("_keys", F.array_sort(F.array_distinct(F.array_compact(keys))))
    held = tagged.filter(F.size("_keys") > 0).select("_keys", F.xxhash64(id_col).alias("_h"))
    numbered = with_global_rank(held, [F.col("_keys"), F.col("_h")], "_no")  # datasets of one key set are neighbours
    number = F.col("_no") - 1
    postings = (
        numbered.select(F.explode("_keys").alias("_key"), F.bitmap_bucket_number(number).alias("_piece"), F.bitmap_bit_position(number).alias("_bit"))
        .groupBy("_key", "_piece")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    sets = numbered.select("_keys").distinct().withColumn("_key", F.explode("_keys"))
    met = sets.join(postings, "_key").groupBy("_keys", "_piece").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("d"))
    degree = met.groupBy("_keys").agg((F.sum("d") - 1).alias("degree"))  # without the dataset itself
    return tagged.join(degree, "_keys", "left").select(id_col, F.coalesce("degree", F.lit(0)).alias("degree"))


def key_persistence(df: DataFrame, key: str, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of a day's key values that are seen again the next day.

    The self join on the next day is taken as a look-ahead over distinct (key, day) rows: one scan, and a key has at
    most one row per day however often it occurs.
    """
    seen = df.select(*keys, F.col(key).alias("_k"), F.col(day).cast("date").alias("_d")).distinct()
    following = F.lead("_d").over(W.partitionBy(*keys, "_k").orderBy("_d"))
    return (
        seen.withColumn("_again", following == F.date_add("_d", 1))
        .groupBy(*keys, F.col("_d").alias("day"))
        .agg(F.count("*").alias("n_keys"), F.count_if("_again").alias("n_again"))
        .withColumn("persistence", F.col("n_again") / F.col("n_keys"))
    )


def join_gate(requests: DataFrame, constraints: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """A join request is legal only if the contract permits the key and both sides share the approved boundary."""
    c = constraints.select("feature_id", "forbid_joins_all", "forbid_joins_on", "boundary", *extra)
    joined = requests.join(c, "feature_id", "left")
    return joined.withColumn(
        "verdict",
        F.when(F.col("boundary").isNull(), "NO_CONTRACT")
        .when(F.col("forbid_joins_all") | F.array_contains("forbid_joins_on", F.col("join_key")), "JOIN_KEY_FORBIDDEN")
        .when((F.col("left_boundary") != F.col("boundary")) | (F.col("right_boundary") != F.col("boundary")),
              "JOIN_OUTSIDE_BOUNDARY")
        .otherwise("ALLOWED"),
    )
