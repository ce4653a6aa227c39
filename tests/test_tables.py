"""Stores, governance, generators and invariants over the small data set."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pulsemart.functions.dates import moment
from pulsemart.plans import features, gold, governance, quality
from pulsemart.plans.health import Health
from pulsemart.sources import generators, store
from pulsemart.sources.schemas import DDL, schema


@pytest.fixture(scope="module")
def health(spark, sf_dir):
    return Health(spark, sf_dir)


def test_every_declared_schema_parses(spark):
    assert len(DDL) == 30 and all(schema(name).fields for name in DDL)


def test_append_fills_defaults_and_refresh_is_idempotent(spark, tmp_path):
    target = schema("model_catalog")
    rows = spark.createDataFrame([("M1", "name")], "model_id string, model_name string")
    path = str(tmp_path / "catalog")
    store.append(rows, path, target, {"status": F.lit("ACTIVE")})
    both = store.append(rows, path, target)
    assert sorted(str(r.status) for r in both.collect()) == ["ACTIVE", "None"]
    assert both.schema == target
    table = str(tmp_path / "table")
    store.refresh(rows, table)
    assert store.refresh(rows, table).count() == 1


def test_dedupe_leaves_unique_keys(health):
    for table, key in [("fact_diagnosis", "diagnosis_id"), ("fact_rehab_session", "session_id"),
                       ("dim_patient", "patient_id")]:
        df = getattr(health, table)
        assert df.count() == df.select(key).distinct().count()


def test_orphans_and_matches_make_the_whole(health):
    sessions = health.fact_rehab_session.filter(F.col("referral_id").isNotNull())
    parts = [sessions.join(health.fact_rehab_referral, "referral_id", how).count() for how in ("left_semi", "left_anti")]
    assert sum(parts) == sessions.count()


def test_rates_are_percentages_and_parts_add_up(health):
    cms = gold.cms_cardiac_rehab(health.fact_rehab_referral, health.fact_rehab_session)
    row = cms.agg(F.min("enrollment_rate_pct"), F.max("enrollment_rate_pct"), F.sum("total_referrals")).first()
    assert 0 <= row[0] and row[1] <= 100 and row[2] == health.fact_rehab_referral.count()
    shares = quality.distribution(health.fact_diagnosis, "cardiac_category").agg(F.sum("percentage")).first()[0]
    assert abs(shares - 100) < 0.1


def test_summary_totals_equal_the_rows_of_the_view(health):
    star = (health.fact_encounter, health.dim_patient, health.fact_diagnosis, health.fact_medication,
            health.fact_rehab_referral, health.fact_rehab_session)
    view = gold.clinical_summary(*star).groupBy("encounter_id").agg(
        F.count("*").alias("summary_rows"), F.count("icd_code").alias("diagnosis_rows"),
        F.count("medication_name").alias("medication_rows"), F.sum("latest_rehab_session").alias("session_number_sum"),
        F.count(F.when(F.col("rehab_safety_flag"), 1)).alias("flagged_rows"),
    )
    digest = gold.clinical_summary_digest(*star).select(view.columns)
    assert sorted(map(str, view.collect())) == sorted(map(str, digest.collect()))


def test_program_without_sessions(spark, health):
    none = health.fact_rehab_session.limit(0)
    row = gold.rehab_program_summary(health.fact_rehab_referral, none).first()
    assert (row.total_sessions, row.program_weeks, row.adherence_rate_pct) == (0, None, 0.0)


def test_hot_patient_features_equal_plain_ones(health):
    whole = features.cardiac_rehab_features(health.fact_rehab_session, health.fact_rehab_referral, health.as_of)
    split = features.cardiac_rehab_features(health.fact_rehab_session, health.fact_rehab_referral, health.as_of, hot_rows=25)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


@pytest.mark.parametrize("role, expected", [
    ("HEALTH_DATA_ADMIN", "all"), ("HEALTH_READONLY", "own"), ("HEALTH_APP_ADMIN", "none"),
])
def test_care_team_matrix(health, role, expected):
    seen = governance.filter_by_care_team(health.dim_patient, health.care_team_assignments, role, "CLINICIAN_3")
    own = health.care_team_assignments.filter("care_team_id = 'TEAM-CARDIO'").count()  # the reader's only team
    assert seen.count() == {"all": health.dim_patient.count(), "own": own, "none": 0}[expected]


def test_role_inheritance():
    reach = governance.inherited(governance.ROLE_EDGES)
    assert ("SYSADMIN", "HEALTH_READONLY") in reach and ("HEALTH_ANALYST", "HEALTH_DATA_ADMIN") not in reach


def test_generators_repeat_themselves(spark):
    as_of = moment("2002-01-01 00:00:00")
    one = generators.patients(generators.rows(spark, 50), as_of)
    two = generators.patients(generators.rows(spark, 50).repartition(3), as_of)
    assert sorted(one.collect()) == sorted(two.collect())
    assert generators.sessions(generators.rows(spark, 20), as_of).count() == 200
    assert generators.outcomes(generators.rows(spark, 20), as_of).count() == 40


def test_shared_folder_comes_from_the_session(spark):
    assert store.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
