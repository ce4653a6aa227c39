"""Bronze to silver: cleaned, classified, one row per business id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions import dates, rules
from pulsemart.operators.latest import latest_by, newest_first


def _newest_row(raw: DataFrame, key: str, spread: bool = False) -> DataFrame:
    return latest_by(raw, key, newest_first("load_timestamp", "record_id"), spread=spread)


def dim_patient(raw_patients: DataFrame, as_of: Column) -> DataFrame:
    clean = lambda c: F.upper(F.trim(c))
    return _newest_row(raw_patients, "patient_id").select(
        "patient_id",
        clean("first_name").alias("first_name"),
        clean("last_name").alias("last_name"),
        "date_of_birth",
        dates.years_between(F.col("date_of_birth"), as_of).alias("age"),
        clean("gender").alias("gender"),
        F.trim("ethnicity").alias("ethnicity"),
        "ssn",
        "address",
        "phone",
        F.lower(F.trim("email")).alias("email"),
        "insurance_id",
        "primary_language",
        "marital_status",
        F.lit(True).alias("is_active"),
        F.lit(True).alias("is_current"),
        "load_timestamp",
    )


def fact_encounter(raw_encounters: DataFrame, as_of: Column) -> DataFrame:
    end = F.coalesce(F.col("discharge_date"), as_of)
    return _newest_row(raw_encounters, "encounter_id").select(
        "encounter_id",
        "patient_id",
        F.upper(F.trim("encounter_type")).alias("encounter_type"),
        "admit_date",
        "discharge_date",
        dates.days_between(F.col("admit_date"), end).alias("length_of_stay_days"),
        "department",
        "attending_provider",
        "facility_code",
        "admit_diagnosis_code",
        "discharge_status",
    )


def fact_diagnosis(raw_diagnoses: DataFrame) -> DataFrame:
    return _newest_row(raw_diagnoses, "diagnosis_id", spread=True).select(
        "diagnosis_id",
        "encounter_id",
        "patient_id",
        F.trim("icd_code").alias("icd_code"),
        "icd_version",
        "description",
        "diagnosis_type",
        "diagnosis_date",
        rules.icd_category(F.col("icd_code")).alias("cardiac_category"),
    )


def fact_medication(raw_medications: DataFrame) -> DataFrame:
    return _newest_row(raw_medications, "medication_id", spread=True).select(
        "medication_id",
        "encounter_id",
        "patient_id",
        "ndc_code",
        "medication_name",
        "dosage",
        "route",
        "frequency",
        "prescriber",
        "start_date",
        "end_date",
        rules.drug_class(F.col("medication_name")).alias("drug_class"),
    )


def fact_lab_result(raw_lab_results: DataFrame) -> DataFrame:
    flag = rules.lab_flag(
        F.col("result_numeric"), F.col("reference_low"), F.col("reference_high"), F.col("abnormal_flag")
    )
    return _newest_row(raw_lab_results, "lab_id", spread=True).select(
        "lab_id",
        "encounter_id",
        "patient_id",
        "loinc_code",
        "test_name",
        "result_numeric",
        "unit",
        "reference_low",
        "reference_high",
        "abnormal_flag",
        flag.alias("computed_flag"),
        "collected_at",
    )


def fact_rehab_referral(raw_rehab_referrals: DataFrame) -> DataFrame:
    risk = rules.referral_risk(F.col("lvef_percent"), F.col("gxt_peak_mets"), F.col("aacvpr_risk_category"))
    return _newest_row(raw_rehab_referrals, "referral_id").select(
        "referral_id",
        "patient_id",
        "referring_physician",
        "qualifying_diagnosis",
        "cardiac_event_date",
        "lvef_percent",
        "gxt_peak_hr",
        "gxt_peak_mets",
        "ischemic_threshold",
        F.upper(F.trim("aacvpr_risk_category")).alias("aacvpr_risk_category"),
        risk.alias("computed_risk"),
        "referral_date",
        dates.days_between(F.col("cardiac_event_date"), F.col("referral_date")).alias("days_event_to_referral"),
    )


def fact_rehab_session(raw_rehab_sessions: DataFrame) -> DataFrame:
    c = F.col
    return (
        _newest_row(raw_rehab_sessions, "session_id", spread=True)
        .withColumn(
            "achieved_hrr_percent", rules.reserve_percent(c("peak_hr"), c("resting_hr"), c("target_hr_high"))
        )
        .withColumn("hr_recovery_delta", rules.recovery_delta(c("peak_hr"), c("recovery_hr")))
        .withColumn(
            "safety_flag",
            rules.safety_flag(
                c("peak_bp_systolic"), c("peak_bp_diastolic"), c("resting_bp_systolic"), c("spo2_min"),
                c("exercise_terminated_early"),
            ),
        )
        .drop("record_id", "source_system", "load_timestamp")
    )


def fact_rehab_outcome(raw_rehab_outcomes: DataFrame) -> DataFrame:
    return (
        _newest_row(raw_rehab_outcomes, "outcome_id")
        .withColumn("depression_severity", rules.phq9_band(F.col("phq9_score")))
        .drop("record_id", "source_system", "load_timestamp")
    )


def active_care_team(care_team_assignments: DataFrame, as_of: Column) -> DataFrame:
    """Assignments in force on the given day; a missing end date means still in force."""
    today = F.to_date(as_of)
    return care_team_assignments.filter(
        (F.col("assigned_date") <= today) & (F.col("end_date").isNull() | (F.col("end_date") >= today))
    )


# Surrogate key and business id of each stored table.
KEYS = {
    "dim_patient": ("patient_key", "patient_id"),
    "fact_encounter": ("encounter_key", "encounter_id"),
    "fact_diagnosis": ("diagnosis_key", "diagnosis_id"),
    "fact_medication": ("medication_key", "medication_id"),
    "fact_lab_result": ("lab_key", "lab_id"),
    "fact_rehab_referral": ("referral_key", "referral_id"),
    "fact_rehab_session": ("session_key", "session_id"),
    "fact_rehab_outcome": ("outcome_key", "outcome_id"),
}


def surrogate_key(business_id: Column) -> Column:
    """A number of 60 bits from the digest of the id: the same on every load, with no shuffle to number rows."""
    return F.conv(F.left(F.md5(business_id), F.lit(15)), 16, 10).cast("long")


def stored_form(table: str, df: DataFrame, as_of: Column) -> DataFrame:
    """The table as it is kept: surrogate key in front, validity of a patient row, time of the transformation."""
    key, business_id = KEYS[table]
    if table == "dim_patient":
        df = df.withColumn("effective_from", F.col("load_timestamp")).withColumn("effective_to", dates.end_of_time())
    kept = [c for c in df.columns if c != "load_timestamp"]
    return df.select(surrogate_key(F.col(business_id)).alias(key), *kept, as_of.alias("transformed_at"))
