"""Metrics over several tables: paths, states that add up, three steps against a plain join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pulsemart.plans.semantic import Partial, metrics_across, path

RELATIONS = [
    ("visit", "session", "session_id"), ("session", "referral", "referral_id"), ("referral", "patient", "patient_id"),
    ("note", "patient", "patient_id"),
]
MODEL = {
    "patient": {"dimensions": {"gender": "gender"}, "measures": {"patients": "count(DISTINCT patient_id)"}},
    "visit": {"measures": {
        "visits": "count(*)", "rooms": "count(DISTINCT room)", "pulse": "avg(pulse)", "minutes": "sum(minutes)", "timed": "count(minutes)",
    }},
    "note": {"measures": {"notes": "count(*)"}},
}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    some = lambda n: [None if rng.random() < 0.1 else rng.randrange(n) for _ in range(1)][0]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "patient": make([(i, rng.choice(["M", "F", None])) for i in range(30)], "patient_id int, gender string"),
        "referral": make([(i, some(35)) for i in range(60)], "referral_id int, patient_id int"),
        "session": make([(i, some(70)) for i in range(200)], "session_id int, referral_id int"),
        "visit": make([(some(220), rng.randrange(5), some(99), some(30)) for _ in range(900)], "session_id int, room int, pulse int, minutes int"),
        "note": make([(some(30),) for _ in range(50)], "patient_id int"),
    }


def test_three_steps_equal_a_join_of_rows(tables):
    got = metrics_across(
        tables, ("patient", "gender"),
        {"patient": ["patients"], "visit": ["visits", "rooms", "pulse", "minutes", "timed"], "note": ["notes"]}, MODEL, RELATIONS,
    )
    rows = tables["visit"].join(tables["session"], "session_id").join(tables["referral"], "referral_id").join(tables["patient"], "patient_id")
    want = rows.groupBy("gender").agg(
        F.count("*").alias("visits"), F.countDistinct("room").alias("rooms"), F.avg("pulse").alias("pulse"),
        F.sum("minutes").alias("minutes"), F.count("minutes").alias("timed"),
    )
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    notes = tables["note"].join(tables["patient"], "patient_id").groupBy("gender").count().collect()
    assert {r.gender: r.notes for r in got.collect() if r.notes} == {r.gender: r["count"] for r in notes}
    assert got.agg(F.sum("patients")).first()[0] == 30


def test_facts_are_added_up_before_they_are_joined(tables):
    plan = metrics_across(tables, ("patient", "gender"), {"visit": ["visits"]}, MODEL, RELATIONS)._jdf.queryExecution().optimizedPlan().toString()
    visit = plan[:plan.index("room")] if "room" in plan else plan
    assert visit.rindex("Aggregate") > visit.index("Join")  # the deepest operator above the fact is an aggregate


def test_paths():
    assert path("visit", "patient", RELATIONS) == [("session", "session_id"), ("referral", "referral_id"), ("patient", "patient_id")]
    assert path("patient", "patient", RELATIONS) == []
    with pytest.raises(ValueError):
        path("patient", "visit", RELATIONS)
    with pytest.raises(ValueError):
        Partial({"x": "max(y)"})
