"""A stream over several files must end where the batch query ends."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsemart.operators.latest import latest_by, newest_first
from pulsemart.sources import bridge
from pulsemart.sources.versions import VersionedTable
from pulsemart.streaming import feeds, monitors


def _split(spark, df, folder, files, order):
    """Writes the rows as several files, oldest first, so that micro-batches arrive in order."""
    df.repartitionByRange(files, order).write.parquet(str(folder))
    for position, path in enumerate(sorted(folder.glob("part-*.parquet"))):
        os.utime(path, (1_700_000_000 + position, 1_700_000_000 + position))
    return feeds.read_feed(spark, str(folder), "*.parquet", files_per_batch=1)


def test_failure_spikes_equal_batch(spark, sf_dir, tmp_path):
    events = bridge.star(spark, sf_dir, "events")
    stream = _split(spark, events, tmp_path / "events", 3, "ts")
    got = monitors.failure_spikes(stream, "ts", F.col("event_type") == "error", 0)
    window = F.window(F.col("ts").cast("timestamp"), "15 minutes")
    want = events.filter("event_type = 'error'").groupBy(window).agg(F.count("*").alias("failures"))
    assert sorted(r.failures for r in got.collect()) == sorted(r.failures for r in want.collect())
    assert got.select(F.sum("failures")).first()[0] == events.filter("event_type = 'error'").count()


def test_newest_per_key_over_batches(spark, sf_dir, tmp_path):
    orders = bridge.star(spark, sf_dir, "orders")
    raw = bridge.raw_encounters(spark, sf_dir, orders)
    stream = _split(spark, raw, tmp_path / "encounters", 4, "record_id")
    got = monitors.newest_per_key(stream, "encounter_id", "load_timestamp", "record_id", str(tmp_path / "state"), files=3)
    stored = VersionedTable(spark, str(tmp_path / "state"), "encounter_id")
    assert len(stored.manifest()["files"]) <= 3 + 4 and stored.read().count() < raw.count()
    want = latest_by(raw, "encounter_id", newest_first("load_timestamp", "record_id"))
    columns = ["encounter_id", "record_id", "discharge_status"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_repeats_are_dropped(spark, sf_dir, tmp_path):
    events = bridge.star(spark, sf_dir, "events")
    stream = _split(spark, events.unionByName(events), tmp_path / "twice", 3, "ts")
    assert monitors.without_repeats(stream, ["event_id"], "ts").count() == events.count()


def test_rerun_continues_where_it_stopped(spark, sf_dir, tmp_path):
    events = bridge.star(spark, sf_dir, "events")
    stream = _split(spark, events, tmp_path / "feed", 2, "ts").select("event_id")
    folder = str(tmp_path / "state")
    assert feeds.run_to_table(stream, "append", folder=folder).count() == events.count()
    assert feeds.run_to_table(stream, "append", folder=folder).count() == events.count()


def test_empty_feed_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    stream = spark.readStream.schema("event_id long").parquet(str(tmp_path / "feed"))
    assert feeds.run_to_table(stream, "append").collect() == []


def test_rows_out_of_order_are_all_counted(spark, sf_dir, tmp_path):
    events = bridge.star(spark, sf_dir, "events")
    events.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "late"))
    for position, path in enumerate(sorted((tmp_path / "late").glob("part-*.parquet"), reverse=True)):  # newest first
        os.utime(path, (1_700_000_000 + position, 1_700_000_000 + position))
    stream = lambda: feeds.read_feed(spark, str(tmp_path / "late"), "*.parquet", files_per_batch=1)
    failed = F.col("event_type") == "error"
    got = monitors.failure_spikes(stream(), "ts", failed, 0)
    assert got.select(F.sum("failures")).first()[0] == events.filter(failed).count()
    assert monitors.without_repeats(stream(), ["event_id"], "ts").count() == events.count()


def test_monitors_go_on_where_they_stopped(spark, sf_dir, tmp_path):
    events = bridge.star(spark, sf_dir, "events").filter("event_id % 2 = 0")
    more = bridge.star(spark, sf_dir, "events").filter("event_id % 2 = 1")
    failed, feed, folder = F.col("event_type") == "error", str(tmp_path / "feed"), str(tmp_path / "state")

    def total():
        stream = feeds.read_feed(spark, feed, "*.parquet")
        return monitors.failure_spikes(stream, "ts", failed, 0, folder=folder).select(F.sum("failures")).first()[0]

    events.write.parquet(feed)
    first = total()
    assert first == events.filter(failed).count() and total() == first  # nothing new, nothing read twice
    more.write.mode("append").parquet(feed)
    assert total() == first + more.filter(failed).count()
    assert len(list((tmp_path / "state" / "out").glob("batch=*"))) == 2


def test_other_zones_are_refused(spark, sf_dir):
    stream = feeds.read_feed(spark, sf_dir, "events.parquet")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            monitors.failure_spikes(stream, "ts", F.col("event_type") == "error", 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("cuts, merged", [(1, 200), (5, 3)])
def test_daily_sessions_count_patients_exactly_over_any_cut(spark, sf_dir, tmp_path, cuts, merged):
    raw = bridge.raw_rehab_sessions(spark, bridge.lines_with_patient(spark, sf_dir))
    mixed = raw.unionByName(raw.where("session_number = 7")).withColumn("_at", F.xxhash64("record_id"))
    folder = tmp_path / "sessions"
    stream = _split(spark, mixed, folder, cuts, "_at")
    got = monitors.daily_sessions(stream.drop("_at"), str(tmp_path / "state"), files=merged)
    want = mixed.groupBy("session_date").agg(
        F.count("*").alias("sessions_conducted"), F.countDistinct("patient_id").alias("unique_patients"),
        F.avg("duration_minutes").alias("avg_duration"), F.avg("peak_hr").alias("avg_peak_hr"),
        F.count(F.when(F.col("exercise_terminated_early"), 1)).alias("early_terminations"),
        F.sum("ecg_monitor_minutes").alias("total_ecg_minutes"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    # Goes on where it stopped: nothing is counted twice, and what comes later is added.
    again = monitors.daily_sessions(feeds.read_feed(spark, str(folder), "*.parquet").drop("_at"), str(tmp_path / "state"))
    assert again.select(F.sum("sessions_conducted")).first()[0] == mixed.count()
    raw.where("session_number = 8").withColumn("_at", F.lit(0).cast("long")).coalesce(1).write.mode("append").parquet(str(folder))
    more = monitors.daily_sessions(feeds.read_feed(spark, str(folder), "*.parquet").drop("_at"), str(tmp_path / "state"))
    assert more.select(F.sum("sessions_conducted")).first()[0] == mixed.count() + raw.where("session_number = 8").count()
    assert more.select(F.sum("unique_patients")).first()[0] == want.select(F.sum("unique_patients")).first()[0]
