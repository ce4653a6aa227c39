"""The full build: silver tables from bronze, then the gold marts, written in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pulsemart.plans import features, gold
from pulsemart.plans.health import Health
from pulsemart.sources.store import save, save_bucketed

# Tables that are joined on the patient again and again.
BY_PATIENT = ["dim_patient", "fact_encounter", "fact_diagnosis", "fact_medication", "fact_lab_result",
              "fact_rehab_referral"]
BY_REFERRAL = ["fact_rehab_session", "fact_rehab_outcome"]


def build_silver(health: Health, folder: str, prefix: str, buckets: int) -> dict[str, DataFrame]:
    """Silver tables, bucketed on the key their readers join on."""
    keys = {name: "patient_id" for name in BY_PATIENT} | {name: "referral_id" for name in BY_REFERRAL}
    return {
        name: save_bucketed(health.stored(name), f"{prefix}_{name}", f"{folder}/{name}", key, buckets)
        for name, key in keys.items()
    }


def build_gold(silver: dict[str, DataFrame], claims: DataFrame, folder: str, as_of: Column) -> dict[str, DataFrame]:
    """Gold marts and the feature table from stored silver tables."""
    referrals, sessions = silver["fact_rehab_referral"], silver["fact_rehab_session"]
    marts = {
        "rehab_program_summary": gold.rehab_program_summary(referrals, sessions),
        "outcome_comparison": gold.outcome_comparison(silver["fact_rehab_outcome"]),
        "cardiac_cohort": gold.cardiac_cohort(silver["dim_patient"], referrals),
        "daily_session_metrics": gold.daily_session_metrics(sessions),
        "cms_cardiac_rehab": gold.cms_cardiac_rehab(referrals, sessions),
        "claims_summary": gold.claims_summary(claims),
        "patient_clinical_features": features.patient_clinical_features(
            silver["dim_patient"], silver["fact_diagnosis"], silver["fact_medication"], silver["fact_encounter"],
            silver["fact_lab_result"], as_of,
        ),
    }
    return {name: save(df, f"{folder}/{name}") for name, df in marts.items()}
