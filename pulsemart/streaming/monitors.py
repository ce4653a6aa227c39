"""Streaming monitors: failure spikes, daily session figures, newest record per key.

Each takes ``folder``: a later call with the same folder reads only what has arrived since and
returns the figures of all of it. Log times are zone-free and are read as UTC, so no hour is lost
or doubled where summer time begins or ends; the session's zone must be UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pulsemart.functions.numbers import count_where
from pulsemart.operators.latest import latest_by, newest_first
from pulsemart.sources.store import shared_folder
from pulsemart.sources.versions import VersionedTable
from pulsemart.streaming.feeds import MERGED_FILES, run_to_table, run_to_versions


def _in_utc(feed: DataFrame) -> None:
    if feed.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
        raise ValueError("streams over zone-free times need spark.sql.session.timeZone = UTC")


def _windowed_counts(counted: DataFrame, keys: list[str], folder: str | None) -> DataFrame:
    """Counts per window over all batches: each batch writes its own counts, the reader adds them up.

    No watermark is needed, so rows of any delay and any order are counted.
    """
    batches = run_to_table(
        counted, "append",
        lambda batch: batch.groupBy("window", *keys).agg(F.count("*").alias("failures")), folder,
    )
    return batches.groupBy(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"), *keys,
    ).agg(F.sum("failures").alias("failures"))


def failure_spikes(
    events: DataFrame, time: str, failed, above: int, width: str = "15 minutes", folder: str | None = None
) -> DataFrame:
    """Windows with more than ``above`` failures."""
    _in_utc(events)
    found = events.filter(failed).select(F.window(F.col(time).cast("timestamp"), width).alias("window"))
    return _windowed_counts(found, [], folder).filter(F.col("failures") > above)


def login_spikes(
    events: DataFrame, time: str, user: str, failed, at_least: int, width: str = "1 hour", slide: str = "15 minutes",
    folder: str | None = None,
) -> DataFrame:
    """Users with at least ``at_least`` failed logins in a sliding window."""
    _in_utc(events)
    window = F.window(F.col(time).cast("timestamp"), width, slide)
    found = events.filter(failed).select(window.alias("window"), F.col(user).alias("user_name"))
    return _windowed_counts(found, ["user_name"], folder).filter(F.col("failures") >= at_least)


def _patient_days(sessions: DataFrame) -> DataFrame:
    """Figures per day and patient that can be added up; their number is the exact count of patients of a day."""
    keyed = sessions.groupBy("session_date", "patient_id").agg(
        F.count("*").alias("n"), F.sum("duration_minutes").alias("duration"), F.count("duration_minutes").alias("n_duration"),
        F.sum("peak_hr").alias("peak_hr"), F.count("peak_hr").alias("n_peak_hr"),
        count_where(F.col("exercise_terminated_early")).alias("early"), F.sum("ecg_monitor_minutes").alias("ecg"),
    )
    return keyed.withColumn("state_key", F.xxhash64("session_date", "patient_id"))


def _put_together(state: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("n", "duration", "n_duration", "peak_hr", "n_peak_hr", "early", "ecg")]
    return state.groupBy("session_date", "patient_id").agg(*sums, F.first("state_key").alias("state_key"))


def daily_sessions(sessions: DataFrame, folder: str | None = None, files: int = MERGED_FILES) -> DataFrame:
    """Session figures per day, kept up to date, with the exact number of different patients.

    Batches store figures per day and patient, which add up in any order; state grows with the pairs of day and
    patient, not with batches or sessions. No watermark is needed, so rows of any delay are counted.
    """
    spark = sessions.sparkSession
    table = VersionedTable(spark, folder or f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}", "state_key")
    state = run_to_versions(sessions, table, _patient_days, _put_together, files)
    if state is None:
        state = _patient_days(spark.createDataFrame([], sessions.schema))
    return _put_together(state).groupBy("session_date").agg(
        F.sum("n").alias("sessions_conducted"), F.count("patient_id").alias("unique_patients"),
        (F.sum("duration") / F.nullif(F.sum("n_duration"), F.lit(0))).alias("avg_duration"),
        (F.sum("peak_hr") / F.nullif(F.sum("n_peak_hr"), F.lit(0))).alias("avg_peak_hr"),
        F.sum("early").alias("early_terminations"), F.sum("ecg").alias("total_ecg_minutes"),
    )


def newest_per_key(
    feed: DataFrame, key: str, load_time: str, record: str, folder: str | None = None, files: int = MERGED_FILES,
) -> DataFrame:
    """Newest row per key of a feed.

    Every micro-batch appends its own newest rows; above ``files`` files the newest of all are put together, so
    what is stored grows with the keys and not with the batches. The reader keeps the newest of what is stored.
    """
    spark = feed.sparkSession
    table = VersionedTable(spark, folder or f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}", key)

    def newest(rows: DataFrame) -> DataFrame:
        return latest_by(rows, key, newest_first(load_time, record))

    state = run_to_versions(feed, table, newest, newest, files)
    return newest(spark.createDataFrame([], feed.schema) if state is None else state)


def without_repeats(
    feed: DataFrame, keys: list[str], time: str, lateness: str | None = None, folder: str | None = None
) -> DataFrame:
    """Drops repeats of the keys.

    Without ``lateness`` repeats are found however late they arrive and no row is lost: the state
    holds every key. With it the state forgets keys older than the watermark; rows that arrive
    later than that are dropped, and Spark counts them in the progress of the query
    (``numRowsDroppedByWatermark``).
    """
    if lateness is None:
        unique = feed.dropDuplicates(keys)
    else:
        _in_utc(feed)
        timed = feed.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
        unique = timed.dropDuplicatesWithinWatermark(keys)
    return run_to_table(unique, "append", lambda batch: batch.drop("_time"), folder).drop("batch")
