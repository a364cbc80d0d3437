"""Streams over several files: late rows, replay-safe sinks and caps across batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilgrain.operators import bounding
from veilgrain.operators import transforms as tr
from veilgrain.schema import ReleaseContract
from veilgrain.streaming import ingest, lateness, windows

START = dt.datetime(2024, 1, 1)


def write_day(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    path = f"{folder}/{name}"
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    return path


@pytest.fixture
def folder(spark, tmp_path):
    out = str(tmp_path / "events")
    for day in range(5):
        rows = [
            (day * 100 + i, START + dt.timedelta(days=day, minutes=10 * i), i % 3, "click", float(i), '{"k": %d}' % (i % 4))
            for i in range(40)
        ]
        if day == 4:  # one row four days late, one within the allowed day
            rows.append((999, START, 1, "click", 1.0, '{"k": 1}'))
            rows.append((998, START + dt.timedelta(days=3, hours=20), 1, "click", 1.0, '{"k": 1}'))
        write_day(spark, out, f"d{day}", rows)
    return out


def test_late_rows_are_dropped_and_counted(spark, folder):
    stream = ingest.with_watermark(ingest.event_stream(spark, folder, files_per_trigger=1), "1 day")
    daily = stream.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    table, query = ingest.run_to_table(daily, "late")
    got = {r.d.isoformat(): r.n for r in table.select(F.to_date("window.start").alias("d"), "n").collect()}
    assert ingest.late_rows(query) == 1
    assert got["2024-01-01"] == 40 and got["2024-01-02"] == 40


def daily(df):
    return df.groupBy(F.to_date("ts").cast("string").alias("window_id")).agg(F.count("*").alias("n"))


def test_late_rows_are_a_second_output(spark, folder, monkeypatch):
    # Spark keeps two progress reports here, so counts from them would miss most batches
    monkeypatch.setattr(ingest, "_use_rocksdb", lambda s: s.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2"))
    for day in range(5, 9):
        rows = [(day * 100 + i, START + dt.timedelta(days=day, minutes=i), 1, "click", 1.0, '{"k": 1}') for i in range(5)]
        rows += [(5000 + day, START + dt.timedelta(days=day - 4), 1, "click", 1.0, '{"k": 1}'), (6000 + day, None, 1, "x", 1.0, "{}")]
        write_day(spark, folder, f"d{day}", rows)
    stream = ingest.event_stream(spark, folder, files_per_trigger=1)
    found = lateness.split_late(stream, 86400, F.window("ts", "1 day").end, daily)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    late = found.late.collect()
    assert sorted(r.event_id for r in late if r.reject_reason == "LATE") == [999, 5005, 5006, 5007, 5008]
    assert sorted(r.event_id for r in late if r.reject_reason == "NO_TIME") == [6005, 6006, 6007, 6008]
    on_time = {r.window_id: r.n for r in found.parts.groupBy("window_id").agg(F.sum("n").alias("n")).collect()}
    assert sum(on_time.values()) + len(late) == spark.read.parquet(folder).count()
    assert on_time["2024-01-04"] == 41  # the row within the allowed day counts
    assert found.watermark == START + dt.timedelta(days=7, minutes=4)


def test_a_replayed_batch_changes_nothing(spark, folder, tmp_path):
    out, batch = str(tmp_path / "out"), spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    closes = F.window("ts", "1 day").end

    def state():
        tables = [spark.read.schema(f"n long, {c} bigint").parquet(f"{out}/{t}") for t, c in (("parts", "batch_id"), ("late", "batch_id"))]
        return [sorted(map(str, t.groupBy("batch_id").agg(F.count("*"), F.sum("n")).collect())) for t in tables]

    days = [batch.filter(F.col("event_id").between(a, b)) for a, b in ((0, 199), (400, 999), (200, 399))]
    for number, df in enumerate(days):
        lateness.split_batch(df, number, out, 86400, closes, daily)
    first = state()
    for number in (2, 1, 2):
        lateness.split_batch(days[number], number, out, 86400, closes, daily)
    assert state() == first
    assert spark.read.parquet(f"{out}/late").filter("batch_id = 2").count() == 40  # the third day came after the fifth


def test_cap_over_batches_equals_batch_cap(spark, folder):
    stream = ingest.event_stream(spark, folder, files_per_trigger=1).withColumn("window_id", tr.week_id(F.col("ts")))
    item, cluster = F.col("k").cast("string"), F.col("event_type")
    parts = ingest.capped_ingest(tr.ladder(stream, item, cluster), 2)
    key = ("event_id", "level", "cell")
    got = sorted(map(tuple, ingest.merge_capped(parts, 2).select(*key).collect()))
    batch = spark.read.parquet(folder)
    shaped = tr.ladder(
        batch.select("event_id", F.col("user_id").alias("contributor"), "ts", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
        .withColumn("window_id", tr.week_id(F.col("ts"))),
        item, cluster,
    )
    want = sorted(map(tuple, bounding.contribution_cap(shaped, 2).select(*key).collect()))
    assert got == want
    assert parts.select("batch_id").distinct().count() == 5


def test_hourly_windows_keep_their_names_and_bounds(spark, folder):
    c = ReleaseContract(secret="s", cap=1, max_cells=2, lo=0.0, hi=5.0)
    stream = ingest.with_watermark(ingest.event_stream(spark, folder, files_per_trigger=1), "1 day")
    with pytest.raises(ValueError):
        windows.bounded_tumbling_staging(stream, "1 hour", F.col("event_type"), ["a", "b", "c"], c)
    staged = windows.bounded_tumbling_staging(stream, "1 hour", F.col("event_type"), ["click", "view"], c)
    table, _ = ingest.run_to_table(staged, "hourly")
    rows = table.filter("window_id < '2024-01-02'").collect()
    assert sorted(r.window_id for r in rows) == [f"2024-01-01T{h:02d}:00" for h in range(7)]
    # six rows of three people an hour (four in the last), of which each counts once and for at most 5
    assert all(r.event_count == r.contributors_count == 3 and r.value_sum <= 15 for r in rows)


def test_dedupe_across_batches(spark, folder):
    write_day(spark, folder, "again", [(1, START + dt.timedelta(days=4), 1, "click", 1.0, '{"k": 1}')])
    stream = ingest.event_stream(spark, folder, files_per_trigger=1)
    table, _ = ingest.run_to_table(ingest.dedupe_stream(stream, "event_id", "5 days"), "dedupe")
    ids = [r.event_id for r in table.select("event_id").collect()]
    assert len(ids) == len(set(ids)) == 202
