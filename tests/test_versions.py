"""Versioned tables, merged history and the key registry."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pulsemart.operators.history import merge_versions, stored_versions, versions
from pulsemart.operators.surrogates import registered
from pulsemart.sources.versions import Conflict, VersionedTable

SCHEMA = "k string, record_id long, state string, load_timestamp timestamp_ntz"
DAY = dt.datetime(2020, 1, 1)


def observed(seed, keys=300, n=2500):
    rng = random.Random(seed)
    rows = [(f"K{rng.randrange(keys):05d}", i, rng.choice("xyz"), DAY + dt.timedelta(days=rng.randrange(60))) for i in range(n)]
    rows += [("K00007", 10_000 + i, rng.choice("xyz"), DAY + dt.timedelta(hours=i)) for i in range(800)]  # a hot key
    rows += [(f"K{i:05d}", 20_000 + i, None, None) for i in range(5)]
    rng.shuffle(rows)
    return rows


def text(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("hot_rows", [50, 10**6])
def test_three_merged_loads_equal_the_history_of_all_rows(spark, tmp_path, hot_rows):
    rows = observed(1)
    table = VersionedTable(spark, str(tmp_path / "dim"), "k", rows_per_file=100)
    for part in (rows[:1500], rows[1000:2600], rows[2600:]):  # overlapping, late, in no order
        merge_versions(table, spark.createDataFrame(part, SCHEMA), ["state"], hot_rows=hot_rows)
    expected = versions(spark.createDataFrame(rows, SCHEMA), "k", ["state"])
    assert text(stored_versions(table, ["state"])) == text(expected)
    assert table.read().count() == len(set(rows))
    again = merge_versions(table, spark.createDataFrame(rows[:50], SCHEMA), ["state"])
    assert again.version == 3 and text(stored_versions(table, ["state"])) == text(expected)


def test_a_small_load_rewrites_few_files(spark, tmp_path):
    rows = [(f"K{i:05d}", i, "x", DAY) for i in range(6000)]
    table = VersionedTable(spark, str(tmp_path / "dim"), "k", rows_per_file=50)
    table.overwrite(spark.createDataFrame(rows, SCHEMA).selectExpr("k", "state", "load_timestamp", "record_id", "load_timestamp effective_to", "true is_current", "true is_version"), "load_timestamp", files=100)
    before = {f["path"] for f in table.manifest()["files"]}
    assert len(before) >= 95
    load = spark.createDataFrame([(f"K{i:05d}", 10_000 + i, "y", DAY + dt.timedelta(days=1)) for i in range(3000, 3060)], SCHEMA)
    done = merge_versions(table, load, ["state"])  # one key in a hundred, as new ids lie side by side
    after = {f["path"] for f in table.manifest()["files"]}
    assert len(before - after) < 0.05 * len(before) and done.kept_files == len(before & after)
    assert stored_versions(table, ["state"]).where("k = 'K03030'").count() == 2
    assert table.read().count() == 6060
    files = table.manifest()["files"]
    assert all(a["high"] < b["low"] for a, b in zip(files, files[1:]))


def test_keys_outside_and_between_the_ranges(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k", rows_per_file=3)
    keep = lambda known, new: new if known is None else known.join(new.select("k"), "k", "left_anti").unionByName(new)
    stored = {}
    rng = random.Random(4)
    for load in range(6):
        part = {rng.randrange(-500, 500): load for _ in range(20)}
        table.merge(spark.createDataFrame(list(part.items()), "k long, v int"), keep)
        stored |= part
        assert {r.k: r.v for r in table.read().collect()} == stored
    assert table.read(0).count() == 20


def test_a_failing_write_leaves_the_table_as_it_was(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")
    table.overwrite(spark.range(10).withColumnRenamed("id", "k"))
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("k"))
    with pytest.raises(PySparkException):
        table.overwrite(broken)
    assert table.versions() == [0] and table.read().count() == 10


def test_reload_while_reading_and_removal(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")
    table.overwrite(spark.range(10).withColumnRenamed("id", "k"))
    reader = table.read()
    table.overwrite(reader.unionByName(reader))
    assert reader.count() == 10 and table.read().count() == 20
    with pytest.raises(Conflict):
        table._commit(1, [], reader.schema, {})
    assert table.remove_old() == 1 and table.versions() == [1] and table.read().count() == 20


def test_empty_tables(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "k")
    with pytest.raises(ValueError):
        table.read()
    merge_versions(table, spark.createDataFrame([], SCHEMA), ["state"])
    assert stored_versions(table, ["state"]).count() == 0
    merge_versions(table, spark.createDataFrame([("a", 1, "x", DAY)], SCHEMA), ["state"])
    assert stored_versions(table, ["state"]).count() == 1


def test_registry_numbers_are_dense_and_stay(spark, tmp_path):
    registry = VersionedTable(spark, str(tmp_path / "r"), "id")
    ids = lambda low, high: spark.createDataFrame([(f"P{i:04d}",) for i in range(low, high)] + [(None,)], "id string").repartition(5)
    first = {r.id: r.n for r in registered(registry, ids(100, 300), "id", "n").collect()}
    assert sorted(first.values()) == list(range(1, 201))
    second = {r.id: r.n for r in registered(registry, ids(0, 350), "id", "n").collect()}
    assert sorted(second.values()) == list(range(1, 351)) and all(second[i] == n for i, n in first.items())
    assert {r.id: r.n for r in registered(registry, ids(0, 350), "id", "n").collect()} == second
    assert registered(VersionedTable(spark, str(tmp_path / "e"), "id"), ids(5, 5), "id", "n").count() == 0
