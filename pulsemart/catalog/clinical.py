"""Silver, gold and dashboard queries."""

from __future__ import annotations

from pulsemart.catalog.shape import steady
from pulsemart.plans import dashboard as d, gold as g, silver
from pulsemart.plans.health import Health

PATIENT = "PAT-000000000016"
RISKS = ["LOW", "MODERATE", "HIGH"]


def _silver(name):
    def run(h: Health):
        return h.stored(name)

    return run


def _star(h: Health):
    return (h.fact_encounter, h.dim_patient, h.fact_diagnosis, h.fact_medication, h.fact_rehab_referral,
            h.fact_rehab_session)


QUERIES = {
    "t1_dim_patient": _silver("dim_patient"),
    "t2_fact_encounter": _silver("fact_encounter"),
    "t3_fact_diagnosis": _silver("fact_diagnosis"),
    "t4_fact_medication": _silver("fact_medication"),
    "t5_fact_lab_result": _silver("fact_lab_result"),
    "t6_fact_rehab_referral": _silver("fact_rehab_referral"),
    "t7_fact_rehab_session": _silver("fact_rehab_session"),
    "t8_fact_rehab_outcome": _silver("fact_rehab_outcome"),
    "t10_active_care_team": lambda h: silver.active_care_team(h.care_team_assignments, h.as_of),
    "m1_rehab_program_summary": lambda h: steady(
        g.rehab_program_summary(h.fact_rehab_referral, h.fact_rehab_session), "avg_hrr_percent"
    ),
    "m2_outcome_comparison": lambda h: g.outcome_comparison(h.fact_rehab_outcome),
    "m3_cardiac_cohort": lambda h: g.cardiac_cohort(h.dim_patient, h.fact_rehab_referral),
    "m4_daily_session_metrics": lambda h: g.daily_session_metrics(h.fact_rehab_session),
    "m5_cms_cardiac_rehab": lambda h: steady(
        g.cms_cardiac_rehab(h.fact_rehab_referral, h.fact_rehab_session), "avg_days_to_referral"
    ),
    "m6_claims_summary": lambda h: g.claims_summary(h.raw_claims),
    "m7_patient_hemodynamic_trend": lambda h: g.patient_hemodynamic_trend(h.fact_rehab_session),
    "m8_clinical_summary": lambda h: g.clinical_summary_digest(*_star(h)),
    "m8_clinical_summary_rows": lambda h: g.clinical_summary_checksums(*_star(h)),
    "m9_diagnosis_category_counts": lambda h: g.diagnosis_category_counts(h.fact_diagnosis),
    "d1_platform_kpis": lambda h: d.platform_kpis(h.silver_tables(), h.raw_claims),
    "d2_daily_sessions": lambda h: d.daily_sessions(h.fact_rehab_session),
    "d3_risk_distribution": lambda h: d.counts_by(h.fact_rehab_referral, "computed_risk", "risk_category"),
    "d4_encounter_types": lambda h: d.counts_by(h.fact_encounter, "encounter_type", "encounter_type"),
    "d5_rehab_patient_list": lambda h: d.rehab_patient_list(h.dim_patient, h.fact_rehab_referral),
    "d6_patient_sessions": lambda h: d.patient_sessions(h.fact_rehab_session, PATIENT),
    "d7_patient_outcomes": lambda h: d.patient_outcomes(h.fact_rehab_outcome, PATIENT),
    "d8_patient_referral": lambda h: d.patient_referral(h.fact_rehab_referral, PATIENT),
    "d9_patient_medications": lambda h: d.patient_medications(h.fact_medication, PATIENT),
    "d10_patient_diagnoses": lambda h: d.patient_diagnoses(h.fact_diagnosis, PATIENT),
    "d11_outcome_deltas": lambda h: d.outcome_deltas(h.fact_rehab_outcome),
    "d12_cohort": lambda h: d.cohort(h.dim_patient, h.fact_rehab_referral),
    "d13_demographics": lambda h: d.demographics(h.dim_patient),
    "d14_diagnosis_prevalence": lambda h: d.diagnosis_prevalence(h.fact_diagnosis, h.dim_patient),
    "d15_comorbidity_pairs": lambda h: d.comorbidity_pairs(h.fact_diagnosis),
    "d16_demographic_rollups": lambda h: d.demographic_rollups(d.demographics(h.dim_patient)),
    "d17_cohort_by_risk_and_diagnosis": lambda h: d.cohort_by_risk_and_diagnosis(
        d.cohort(h.dim_patient, h.fact_rehab_referral), RISKS
    ),
    "d17_cohort_totals": lambda h: d.cohort_totals(d.cohort(h.dim_patient, h.fact_rehab_referral), ["HIGH", "LOW"]),
    "d18_cms_metrics": lambda h: d.cms_metrics(h.fact_rehab_referral, h.fact_rehab_session),
    "d19_adherence_by_risk": lambda h: d.adherence_by_risk(h.fact_rehab_referral, h.fact_rehab_session),
    "d20_safety_by_modality": lambda h: d.safety_by_modality(h.fact_rehab_session),
    "d21_outcome_improvement": lambda h: d.outcome_improvement(h.fact_rehab_referral, h.fact_rehab_outcome),
    "d22_claims_by_payer": lambda h: d.claims_by_payer(h.raw_claims),
    "d23_denial_reasons": lambda h: d.denial_reasons(h.raw_claims),
    "d24_revenue_summary": lambda h: d.revenue_summary(h.raw_claims),
    "d25_monthly_revenue": lambda h: d.monthly_revenue(h.raw_claims),
    "d26_payer_rollup": lambda h: d.payer_rollup(h.raw_claims),
    "d26_denial_reason_rollup": lambda h: d.denial_reason_rollup(h.raw_claims),
    "k4_clinical_summary_sample": lambda h: g.clinical_summary_sample(*_star(h)).select(
        "patient_name", "age", "gender", "encounter_type", "department", "diagnosis_description", "cardiac_category",
        "medication_name", "drug_class", "rehab_risk_category", "lvef_percent",
    ),
}
