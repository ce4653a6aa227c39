"""Operators against brute force on small inputs, including hot keys."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from pulsemart.functions.numbers import padded
from pulsemart.operators.history import versions
from pulsemart.operators.latest import latest_by, newest_first
from pulsemart.operators.neighbours import windowed
from pulsemart.operators.sampling import sample
from pulsemart.operators.vectors import nearest, text_vectors
from pulsemart.plans import alerts, dashboard, gold, notes
from pulsemart.plans.logs import Logs, recent, since_midnight
from pulsemart.sources import lookups


@pytest.mark.parametrize("spread", [False, True])
def test_unknown_load_time_is_newest(spark, spread):
    rows = [("a", 1, dt.datetime(2020, 1, 1)), ("a", 2, None), ("b", 1, dt.datetime(2020, 1, 1)),
            ("b", 2, dt.datetime(2021, 1, 1)), ("c", 1, dt.datetime(2020, 1, 1)), ("c", 2, dt.datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "k string, record_id long, load_timestamp timestamp_ntz")
    kept = latest_by(df, "k", newest_first("load_timestamp", "record_id"), spread=spread).collect()
    assert {r.k: r.record_id for r in kept} == {"a": 2, "b": 2, "c": 2}


def test_newest_row_is_cut_before_the_exchange(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = latest_by(df, "k", [F.desc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def _hot_rows(seed):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(6), f"s{i:04d}", rng.choice([None, *range(50)])) for i in range(400)]
    rows += [(f"p{i % 40}", rng.randrange(6), f"t{i:04d}", rng.choice([None, *range(50)])) for i in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot_rows", [(1, 30), (2, 7), (3, 399), (4, 10_000)])
def test_split_windows_equal_plain_windows(spark, seed, hot_rows):
    df = spark.createDataFrame(_hot_rows(seed), "k string, n int, s string, v int").repartition(5)

    def columns(window):
        return {
            "mean": F.avg("v").over(window.rowsBetween(-2, 0)), "change": F.col("v") - F.lag("v").over(window),
            "first": F.lag("s").over(window).isNull(),
        }

    split = windowed(df, "k", ["n", "s"], 2, columns, hot_rows)
    plain = df.withColumns(columns(Window.partitionBy("k").orderBy("n", "s")))
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("hot_rows", [5, 1000])
def test_history_periods(spark, hot_rows):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rows = [("a", 1, "x", day(0)), ("a", 2, "x", day(1)), ("a", 3, "y", day(2)), ("a", 4, "x", None),
            ("b", 1, None, day(5))]
    rows += [("hot", i, f"v{i // 3}", day(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, record_id long, state string, load_timestamp timestamp_ntz")
    got = versions(df, "k", ["state"], hot_rows=hot_rows).collect()
    a = sorted((r.effective_from or dt.datetime.max, r.state, r.effective_to, r.is_current) for r in got if r.k == "a")
    assert a == [(day(0), "x", day(2), False), (day(2), "y", None, False), (dt.datetime.max, "x", dt.datetime(9999, 12, 31), True)]
    hot = sorted((r.effective_from, r.effective_to, r.is_current) for r in got if r.k == "hot")
    assert len(hot) == 20
    assert all(one[1] == two[0] for one, two in zip(hot, hot[1:]))
    assert [r[2] for r in hot] == [False] * 19 + [True]


def test_sample_is_repeatable_and_complete(spark):
    df = spark.range(1000).repartition(7)
    first = [r.id for r in sample(df, F.col("id"), 10).collect()]
    assert sorted(first) == sorted(r.id for r in sample(df.repartition(3), F.col("id"), 10).collect())
    assert len(set(first)) == 10


def test_ids_wider_than_the_padding_stay_whole(spark):
    got = spark.createDataFrame([(7,), (123456789,)], "id long").select(padded("P-", F.col("id"), 6).alias("p"))
    assert [r.p for r in got.collect()] == ["P-000007", "P-123456789"]


def test_vectors_have_unit_length_and_equal_texts_agree(spark):
    texts = [("a", "acute chest pain"), ("b", "Acute, chest PAIN!"), ("c", "stable"), ("d", "a " * 500)]
    got = {r.k: r.embedding for r in text_vectors(spark.createDataFrame(texts, "k string, t string"), "k", "t").collect()}
    assert set(got) == {"a", "b", "c", "d"} and all(len(v) == 768 for v in got.values())
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in got.values())
    assert got["a"] == got["b"] != got["c"]


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    got = nearest(spark.createDataFrame(data, "id long, v array<float>"), [0, 1], "id", "v", 3).collect()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5
    for probe in (0, 1):
        want = sorted((i for i, _ in data if i != probe), key=lambda i: -cos(data[probe][1], data[i][1]))[:3]
        assert {r.neighbour_id for r in got if r.probe_id == probe} == set(want)


def test_comorbidity_counts_a_patient_once(spark):
    rows = [("p1", "HEART_FAILURE"), ("p1", "HEART_FAILURE"), ("p1", "ACUTE_MI"), ("p2", "ACUTE_MI")]
    pairs = dashboard.comorbidity_pairs(spark.createDataFrame(rows, "patient_id string, cardiac_category string"), 0)
    assert [tuple(r) for r in pairs.collect()] == [("ACUTE_MI", "HEART_FAILURE", 1)]


def test_cost_alert_needs_a_previous_month(spark):
    rows = [("HEALTH_AI_WH", dt.datetime(2024, 1, 5), 5.0, 5.0, 0.0)]
    metering = spark.createDataFrame(
        rows, "warehouse_name string, start_time timestamp_ntz, credits_used double, credits_used_compute double, "
        "credits_used_cloud_services double",
    )
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    assert alerts.monthly_cost_spike(metering, as_of).first().fired is False


def test_note_summary_keeps_reading_order(spark):
    text = "Pain pain pain. Nothing else here. Pain in pain. The end of it! Pain again?"
    got = notes.summaries(spark.createDataFrame([("n", text)], "note_id string, note_text string"), 2).first().summary
    assert got == "Pain pain pain. Pain in pain."


def test_sentiment_bounds_and_labels(spark):
    rows = [("a", "stable and improved"), ("b", "severe pain, acute dyspnea"), ("c", "nothing to say"),
            ("d", "painful unstable")]
    df = spark.createDataFrame([(*r, "T", "P") for r in rows], "note_id string, note_text string, note_type string, patient_id string")
    got = {r.note_id: (r.sentiment_score, r.sentiment_label) for r in notes.sentiment(df).collect()}
    assert got == {"a": (1.0, "POSITIVE"), "b": (-1.0, "NEGATIVE"), "c": (0.0, "NEUTRAL"), "d": (0.0, "NEUTRAL")}


def test_sample_takes_very_large_ids(spark):
    df = spark.range(10**12, 10**12 + 200).withColumn("id", F.col("id") * 1000)
    assert sample(df, F.col("id"), 10).count() == 10


def test_look_back_by_days_starts_at_midnight(spark, sf_dir):
    noon, midnight = (Logs(spark, sf_dir, f"2024-01-31 {t}") for t in ("15:30:00", "00:00:00"))
    counted = [since_midnight(x.query_history, "start_time", x.as_of, 30, "DAY").count() for x in (noon, midnight)]
    from_instant = recent(noon.query_history, "start_time", noon.as_of, 30, "DAY").count()
    assert counted[0] == counted[1] >= from_instant


def test_nearest_takes_probes_in_blocks(spark, monkeypatch):
    corpus = spark.createDataFrame([(i, [1.0, i / 10, (i * i % 7) / 7]) for i in range(12)], "id long, v array<float>")
    whole = sorted(map(str, nearest(corpus, list(range(5)), "id", "v", 3).collect()))
    monkeypatch.setattr("pulsemart.operators.vectors.MAX_PROBES", 2)
    blocks = sorted(map(str, nearest(corpus, list(range(5)), "id", "v", 3).collect()))
    assert len(whole) == 15 and blocks == whole


def test_building_look_back_frames_starts_no_job(spark):
    df = spark.createDataFrame(_hot_rows(5), "k string, n int, s string, v int")
    loads = df.selectExpr("k", "n AS record_id", "s AS state", "timestamp_seconds(n) AS load_timestamp")
    spark.sparkContext.setJobGroup("look-back", "building")
    try:
        windowed(df, "k", ["n", "s"], 2, lambda w: {"change": F.col("v") - F.lag("v").over(w)}, 7)
        versions(loads, "k", ["state"], hot_rows=7)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("look-back")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _tfidf_by_hand(texts, keep=3):
    """note_id -> summary of notes without repeated ids; sentences as the plan cuts them."""
    words = {i: [re.findall("[a-z0-9]+", s.lower()) for s in cut] for i, (_, cut) in texts.items()}
    having = Counter(w for said in words.values() for w in {w for s in said for w in s})
    out = {}
    for i, (_, cut) in texts.items():
        f = Counter(w for s in words[i] for w in s)
        weight = {w: int(math.log(len(texts) / having[w]) * 1000 + 0.5) * n for w, n in f.items()}
        score = {p: sum(weight[w] for w in s) // len(s) for p, s in enumerate(words[i]) if s}
        chosen = []
        for _ in range(min(keep, len(score))):
            def left(p):
                shared = max((len(set(words[i][p]) & set(words[i][q])) * 100 // len(set(words[i][p])) for q in chosen), default=0)
                return score[p] * (100 - shared), -p

            chosen.append(max((p for p in score if p not in chosen), key=left))
        if score:
            out[i] = " ".join(cut[p] for p in sorted(chosen))
    return out


def test_words_of_a_note_stay_with_it(spark, monkeypatch):
    monkeypatch.setattr(notes, "WIDESPREAD_WORDS", 4)  # the other words take the exchange
    rng = random.Random(4)
    texts = {}
    for i in range(60):
        cut = [" ".join(f"w{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(rng.randint(1, 8))) + "." for _ in range(rng.randint(1, 7))]
        texts[f"n{i}"] = (" ".join(cut), cut)
    rows = [(i, t) for i, (t, _) in texts.items()]
    df = spark.createDataFrame(rows + [("empty", ". !"), ("none", None)], "note_id string, note_text string")
    found = notes.tfidf_summaries(df, notes.document_frequencies(df.where("note_id <> 'empty'")), F.lit(len(texts)))
    assert {r.note_id: r.summary for r in found.collect()} == _tfidf_by_hand(texts)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    texts_dealt, texts_reused = plan.count("REPARTITION_BY_COL"), len(re.findall("ReusedExchange \\[note_id#\\d+, note_text", plan))
    assert texts_dealt - texts_reused == 1


def test_look_back_reads_its_input_once(spark):
    rows = spark.range(200).select("id", (F.col("id") % 9).cast("string").alias("k"), (F.col("id") * 7 % 200).alias("n"))
    values = spark.range(200).select("id", (F.col("id") * 3).alias("v"))
    df = rows.join(values.hint("merge"), "id")
    found = windowed(df, "k", ["n", "id"], 2, lambda w: {"change": F.col("v") - F.lag("v").over(w)}, 1000, sized_by=rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is whole before it runs
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(id#" in line and "ReusedExchange" not in line]
    assert len(dealt) == 2  # one for each side of the join


def test_keys_without_a_value_keep_their_rows(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", 2, 3), ("a", 3, 4), ("a", 4, 9)]
    df = spark.createDataFrame(rows, "k string, n long, v long")
    found = windowed(df, "k", ["n"], 2, lambda w: {"change": F.col("v") - F.lag("v").over(w)}, 1)
    got = sorted((r.k or "", r.n, r.change or 0) for r in found.collect())
    assert got == [("", 1, 0), ("", 2, 2), ("a", 1, 0), ("a", 2, 2), ("a", 3, 1), ("a", 4, 5)]


def _star_rows(spark):
    """Encounters with none, one and several rows in each branch; ids that are missing, repeated or found nowhere."""
    days = (dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 3), 2, "HOME")
    stays = [("e1", "p1"), ("e2", "p1"), ("e3", "p2"), ("e4", "p3"), (None, "p1"), ("e6", None), ("e7", "gone"), ("e2", "p1")]
    encounters = [(e, p, "INPATIENT", "CARDIO", "DR", *days) for e, p in stays]
    patients = [("p1", "A", "B", 50, "F", "X", True), ("p2", "C", "D", None, "M", "Y", True), ("p3", "E", None, 9, "F", "Z", True), ("p2", "old", "row", 1, "M", "Y", False)]
    diagnoses = [("e1", "I10", "high", "C", "PRIMARY"), ("e1", "I11", None, None, "PRIMARY"), ("e1", "I12", "x", "C", "OTHER"), (None, "I13", "n", "C", "PRIMARY"), ("e3", "I14", "y", "C", "PRIMARY"), ("e3", "I14", "y", "C", "PRIMARY")]
    medications = [("e1", "asa", "PLATELET"), ("e1", "bb", None), ("e2", None, None), (None, "cc", "C"), ("e9", "dd", "D")]
    referrals = [("p1", "r1", "MI", "HIGH", 40.5), ("p1", "r2", "HF", "LOW", None), ("p3", None, "HF", "LOW", 1.0), (None, "r4", "HF", "LOW", 2.0)]
    sessions = [("r1", 1, 55.25, True), ("r1", 2, None, None), ("r4", 1, 1.0, False), (None, 3, 2.0, True), ("r9", 1, 1.0, True)]
    tables = {
        "encounter_id string, patient_id string, encounter_type string, department string, attending_provider string, "
        "admit_date timestamp_ntz, discharge_date timestamp_ntz, length_of_stay_days int, discharge_status string": encounters,
        "patient_id string, first_name string, last_name string, age int, gender string, ethnicity string, is_current boolean": patients,
        "encounter_id string, icd_code string, description string, cardiac_category string, diagnosis_type string": diagnoses,
        "encounter_id string, medication_name string, drug_class string": medications,
        "patient_id string, referral_id string, qualifying_diagnosis string, computed_risk string, lvef_percent double": referrals,
        "referral_id string, session_number int, achieved_hrr_percent double, safety_flag boolean": sessions,
    }
    return [spark.createDataFrame(rows, schema) for schema, rows in tables.items()]


def test_rows_of_the_clinical_summary_are_not_exchanged(spark):
    star = _star_rows(spark)
    view = gold.clinical_summary(*star)
    digest = gold.row_digest(view.columns, dict(view.dtypes))
    expected = view.select("encounter_id", "patient_id", digest.alias("d")).groupBy("encounter_id", "patient_id").agg(F.count("*"), F.sum("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = gold.clinical_summary_checksums(*star)
        got, plan = Counter(map(tuple, found.collect())), found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == Counter(map(tuple, expected.collect())) and sum(n for _, _, n, _ in got) == view.count()
    assert not re.search("Exchange hashpartitioning\\(encounter_id#\\d+, patient_id", plan)


def test_tables_that_pick_by_other_columns_share_an_exchange(spark):
    lines = spark.range(100).select("id", (F.col("id") * 3).alias("pk"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("sk"))
    joined = lines.join(spark.range(100).hint("merge"), "id")
    table = lookups.lookup(spark, [("a", 1), ("b", 2)], ["name", "code"])
    one, two = (lookups.cyclic_pick(joined, table, "name", F.col(c), 2).select("id", "name", "pk", "sk") for c in ("pk", "sk"))
    both = one.unionByName(two)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan is whole before it runs
    try:
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(id#" in line and "ReusedExchange" not in line]
    assert len(dealt) == 2 and both.count() == 100 + lines.where("sk is not null").count()
