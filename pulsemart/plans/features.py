"""Feature store, training sets and the model catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions.numbers import count_where, ratio
from pulsemart.operators.latest import latest_by
from pulsemart.operators.neighbours import HOT_ROWS, windowed
from pulsemart.sources.store import snapshot


def _any(condition):
    return F.max(F.coalesce(condition, F.lit(False)))


def diagnosis_block(diagnoses: DataFrame) -> DataFrame:
    category = F.col("cardiac_category")
    return diagnoses.groupBy("patient_id").agg(
        F.count("*").alias("total_diagnoses"),
        F.countDistinct("icd_code").alias("unique_icd_codes"),
        _any(category == "ACUTE_MI").alias("has_mi"),
        _any(category == "HEART_FAILURE").alias("has_heart_failure"),
        _any(category == "ATRIAL_FIBRILLATION").alias("has_atrial_fib"),
    )


def medication_block(medications: DataFrame) -> DataFrame:
    drug = F.col("drug_class")
    return medications.groupBy("patient_id").agg(
        F.count("*").alias("total_medications"),
        _any(drug == "BETA_BLOCKER").alias("on_beta_blocker"),
        _any(drug == "ACE_INHIBITOR").alias("on_ace_inhibitor"),
        _any(drug == "ANTICOAGULANT").alias("on_anticoagulant"),
        _any(drug == "STATIN").alias("on_statin"),
        F.countDistinct("drug_class").alias("distinct_drug_classes"),
    )


def encounter_block(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy("patient_id").agg(
        F.count("*").alias("total_encounters"),
        count_where(F.col("encounter_type") == "INPATIENT").alias("inpatient_visits"),
        F.avg("length_of_stay_days").alias("avg_length_of_stay"),
        F.max("length_of_stay_days").alias("max_length_of_stay"),
    )


def lab_block(labs: DataFrame) -> DataFrame:
    """Highest value per analyte (kept under the name 'latest') and the abnormal share."""
    def highest(pattern: str):
        return F.max(F.when(F.col("test_name").ilike(pattern), F.col("result_numeric")))

    abnormal = count_where(F.col("computed_flag").isin("HIGH", "LOW")).cast("double")
    return labs.groupBy("patient_id").agg(
        highest("%hba1c%").alias("latest_hba1c"),
        highest("%ldl%").alias("latest_ldl"),
        highest("%hdl%").alias("latest_hdl"),
        highest("%cholesterol%").alias("latest_total_cholesterol"),
        F.round(ratio(abnormal, F.count("*")), 3).alias("abnormal_lab_ratio"),
    )


def patient_clinical_features(
    patients: DataFrame, diagnoses: DataFrame, medications: DataFrame, encounters: DataFrame, labs: DataFrame,
    as_of: Column,
) -> DataFrame:
    """One row per patient. Each source is aggregated to patients before it is joined.

    ``as_of`` is the time the features were computed.
    """
    blocks = [diagnosis_block(diagnoses), medication_block(medications), encounter_block(encounters), lab_block(labs)]
    wide = reduce(
        lambda left, block: left.join(block, "patient_id", "left"),
        blocks,
        patients.select("patient_id", "age", "gender", "ethnicity"),
    )
    zero = ["total_diagnoses", "unique_icd_codes", "total_medications", "distinct_drug_classes", "total_encounters",
            "inpatient_visits", "avg_length_of_stay", "max_length_of_stay"]
    false = ["has_mi", "has_heart_failure", "has_atrial_fib", "on_beta_blocker", "on_ace_inhibitor",
             "on_anticoagulant", "on_statin"]
    return wide.fillna(0, subset=zero).fillna(False, subset=false).withColumn("feature_computed_at", as_of)


def cardiac_rehab_features(
    sessions: DataFrame, referrals: DataFrame, as_of: Column, hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Session features with three-session means and changes against the session before.

    The order runs per patient by session number, as defined; referral and session id only
    break ties.
    """
    joined = sessions.join(
        referrals.select("referral_id", F.col("computed_risk").alias("risk_category"), "lvef_percent", "gxt_peak_mets"),
        "referral_id",
    ).select(
        "patient_id", "referral_id", "session_id", "session_number", "risk_category", "lvef_percent", "gxt_peak_mets",
        "resting_hr", "peak_hr", "recovery_hr", "hr_recovery_delta", "achieved_hrr_percent", "resting_bp_systolic",
        "peak_bp_systolic", "rpe_peak", "spo2_min", "duration_minutes", "ecg_monitor_minutes", "safety_flag",
        "exercise_terminated_early",
    )

    def trends(window):
        last_three = window.rowsBetween(-2, 0)
        pairs = {"peak_hr": "peak_hr", "rpe": "rpe_peak", "duration": "duration_minutes"}
        means = {f"rolling_3_avg_{n}": F.avg(c).over(last_three) for n, c in pairs.items()}
        return means | {f"{n}_delta": F.col(c) - F.lag(c).over(window) for n, c in pairs.items()}

    found = windowed(joined, "patient_id", ["session_number", "referral_id", "session_id"], 2, trends, hot_rows, sized_by)
    return found.withColumn("feature_computed_at", as_of)


def latest_encounter(encounters: DataFrame) -> DataFrame:
    newest = [F.col("admit_date").desc_nulls_first(), F.desc("encounter_id")]
    return latest_by(encounters, "patient_id", newest).select("patient_id", "encounter_id", "discharge_status")


def mortality_training_set(features: DataFrame, encounters: DataFrame, as_of: Column, version: str = "V1") -> DataFrame:
    died = F.when(F.col("discharge_status") == "EXPIRED", 1).otherwise(0)
    labelled = features.join(latest_encounter(encounters), "patient_id", "left").withColumn("label_mortality", died)
    return snapshot(
        labelled.select(
            "patient_id", "age", "gender", "total_diagnoses", "unique_icd_codes", "has_mi", "has_heart_failure",
            "has_atrial_fib", "total_medications", "on_beta_blocker", "on_ace_inhibitor", "on_anticoagulant",
            "on_statin", "distinct_drug_classes", "total_encounters", "inpatient_visits", "avg_length_of_stay",
            "latest_hba1c", "latest_ldl", "abnormal_lab_ratio", "label_mortality",
        ),
        version, as_of,
    )


def adverse_event_training_set(rehab_features: DataFrame, as_of: Column, version: str = "V1") -> DataFrame:
    adverse = F.when(F.col("safety_flag") | F.col("exercise_terminated_early"), 1).otherwise(0)
    labelled = rehab_features.drop("feature_computed_at").withColumn("label_adverse_event", adverse)
    return snapshot(labelled, version, as_of)


def upsert_models(catalogue: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Catalogue with new entries; the arrival wins for the same model and version."""
    merged = catalogue.withColumn("_arrival", F.lit(0)).unionByName(arrivals.withColumn("_arrival", F.lit(1)))
    keyed = merged.withColumn("_key", F.struct("model_id", "model_version"))
    return latest_by(keyed, "_key", [F.desc("_arrival")]).drop("_key", "_arrival")


def catalogue_with_sizes(catalogue: DataFrame, sizes: DataFrame) -> DataFrame:
    """Active models with the present size of the data set each is trained on."""
    return catalogue.join(
        sizes.select(F.col("table_name").alias("training_dataset"), F.col("row_count").alias("training_rows")),
        "training_dataset", "left",
    )
