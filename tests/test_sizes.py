"""Tasks of a bounded size whatever the size of the tables; nothing large through the driver; inputs read once."""

from conftest import SMALL
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from veilgrain.operators import bounding, central, lineage
from veilgrain.queries import load, local_shuffle
from veilgrain.schema import ReleaseContract
from veilgrain.session import TASK_BYTES, sized_session

QUERIES, _ = load()
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PARTITIONS = "spark.sql.shuffle.partitions"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sized_session_grows_tasks_and_leaves_the_caller_alone(spark):
    before = spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)
    small, large = (sized_session(spark, n) for n in (10, 36_000_000))
    assert small.conf.get(PARTITIONS) == before[0]
    assert int(large.conf.get(PARTITIONS)) == 360
    assert int(large.conf.get(ADVISORY)) == int(large.conf.get("spark.sql.files.maxPartitionBytes")) == TASK_BYTES
    assert large.conf.get("spark.sql.session.timeZone") == "UTC"
    assert (spark.conf.get(PARTITIONS), spark.conf.get(ADVISORY)) == before


def test_sized_session_keeps_finer_settings(spark):
    before = spark.conf.get(ADVISORY)
    spark.conf.set(ADVISORY, "64k")
    try:
        assert sized_session(spark, 10).conf.get(ADVISORY) == "64k"
    finally:
        spark.conf.set(ADVISORY, before)


def test_line_item_queries_run_sized(spark):
    for name in ("lifecycle_ledger", "s_uniq_min_support", "best_stats", "admissible_set", "release_shipment_value"):
        assert int(QUERIES[name](spark, SMALL).sparkSession.conf.get(ADVISORY)) == TASK_BYTES, name


def test_all_scored_and_audit_queries_run_sized(spark):
    for name in (
        "lifecycle_audit", "conservative_defaults", "issue_contracts", "lps_total", "select_min_effvar", "probe_schedule",
        "routing_decision", "routing_tiers", "release_shipments", "s_uniq_distinct_ratio",
    ):
        assert int(QUERIES[name](spark, SMALL).sparkSession.conf.get(ADVISORY)) == TASK_BYTES, name


def test_lineage_rounds_broadcast_nothing(spark):
    state = spark.createDataFrame([(1, 0.5), (2, 0.1)], "feature_id long, floor double").checkpoint()
    links = spark.createDataFrame([(2, 1)], "child long, parent long").checkpoint()
    step = lineage.raised(state, state, links)
    assert "Broadcast" not in plan(step)
    assert sorted(map(tuple, step.collect())) == [(1, 0.5, False), (2, 0.5, True)]


def test_ranked_rows_travel_without_the_name_of_their_level(spark):
    events = spark.createDataFrame(
        [("a", "w", i, i, 1.0, "x") for i in range(3)], "contributor string, window_id string, ts long, event_id long, value double, k string"
    )
    c = ReleaseContract(secret="s", cap=2, max_cells=8, lo=0, hi=10)
    out = central.ranked_partials(events, F.col("k"), F.col("k"), c, ("ts", "event_id"))
    exchange = next(line for line in plan(out).splitlines() if "hashpartitioning(contributor" in line)
    assert "lvl" in exchange and "level" not in exchange
    assert sorted((r.level, r.lvl, r.cell, r.n) for r in out.collect()) == [("AGGREGATE", 2, "all", 2), ("CLUSTER", 1, "x", 2), ("ITEM", 0, "x", 2)]


def test_the_single_cell_of_the_coarsest_level_is_not_ranked(spark):
    rows = [(f"c{i % 5}", "w", level, lvl, cell, 1, 1.0, 1.0) for i in range(5)
            for level, lvl, cells in (("ITEM", 0, "abcd"), ("CLUSTER", 1, "xy"), ("AGGREGATE", 2, ["all"])) for cell in cells]
    partials = spark.createDataFrame(
        rows, "contributor string, window_id string, level string, lvl int, cell string, n long, s double, ss double"
    )
    for max_cells in (1, 3):
        c = ReleaseContract(secret="s", max_cells=max_cells, digest="md5")
        want = bounding.l0_cell_cap(partials, max_cells, "s").collect()
        out = central.cell_capped(partials, c)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want))
        ranked = central.cell_capped(partials.filter("lvl = 2"), c)
        assert ranked.count() == 5
        assert "lvl" in plan(out).split("Window", 1)[1] and "Union" in plan(out)


def test_mixing_reads_its_messages_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(LongType())
    def bit(i):
        seen.add(1)
        return i % 2

    rows = [(i, f"w{i % 3}", "x") for i in range(30)]
    events = spark.createDataFrame(rows, "event_id long, window_id string, cell string")
    monkeypatch.setattr(local_shuffle, "bounded_bits", lambda *_: events.withColumn("bit", bit("event_id")))
    assert QUERIES["shuffle_mix"](spark, SMALL).count() == 30
    assert seen.value == 30


def test_rows_of_a_ranked_release_move_before_they_are_repeated_per_level(spark, monkeypatch):
    rows = [(f"c{i % 7}" if i % 7 else None, f"w{i % 2}" if i % 11 else None, i % 5, i, float(i), i % 13 or None, f"b{i % 3}" if i % 4 else None)
            for i in range(600)]
    events = spark.createDataFrame(
        rows, "contributor string, window_id string, ts int, event_id int, value double, item int, brand string"
    ).repartition(3)
    cells = F.col("item").cast("string"), F.col("brand")
    c = ReleaseContract(secret="s", cap=2, max_cells=4, lo=0, hi=300)
    staged = []
    monkeypatch.setattr(central, "store", lambda df, name: staged.append(df) or df)
    got = central.bounded_staging(events, *cells, c, ("ts", "event_id"))
    moved = [line for line in plan(staged[0]).splitlines() if "Exchange" in line and "contributor" in line]
    assert moved and not any("lvl" in line or "level" in line for line in moved)
    assert "WindowGroupLimit" in plan(staged[0]).split("hashpartitioning(contributor")[-1]  # trimmed before the first shuffle
    want = bounding.stage(central.cell_capped(central.ranked_partials(events, *cells, c, ("ts", "event_id")), c))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_a_release_does_not_shuffle_its_staging(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    schema = "window_id string, level string, lvl int, cell string, event_count long, contributors_count long, value_sum double, value_sumsq double"
    rows = [(f"w{i % 4}" if i % 5 else None, ("ITEM", "CLUSTER", "AGGREGATE")[i % 3], i % 3, f"c{i}", i, 20 + i * 7919 % 400 * (i % 3), i * 0.37, i * 0.73)
            for i in range(20000)]
    staged = central.store(spark.createDataFrame(rows, schema), "staging")
    c = ReleaseContract(secret="s", k_min=20)
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "16k")
    try:
        out = central.release(staged, c, 1)
        assert "Exchange hashpartitioning(window_id" not in plan(out) and "SortMergeJoin" not in plan(out)
        got = sorted(map(tuple, out.select("window_id", "level", "cell").collect()))
    finally:
        spark.conf.set(threshold, before)
    want = central.downgrade_feature(staged, ["window_id"], 20).select("window_id", "level", "cell").collect()
    assert got and got == sorted(map(tuple, want))
