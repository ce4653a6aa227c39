"""Quality, governance, metric-layer, streaming and generator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsemart.catalog import clinical
from pulsemart.catalog.shape import steady
from pulsemart.functions import masks
from pulsemart.plans import gold, governance as n, quality as q, semantic as y
from pulsemart.plans.health import Health
from pulsemart.plans.logs import Logs, since_midnight
from pulsemart.sources import bridge, generators as gen
from pulsemart.streaming import feeds, monitors

ROLES = ["HEALTH_DATA_ADMIN", "HEALTH_ANALYST", "HEALTH_DATA_ENGINEER", "HEALTH_READONLY"]
READER = "CLINICIAN_3"
COUNTED = ["dim_patient", "fact_encounter", "fact_diagnosis", "fact_medication", "fact_rehab_referral",
           "fact_rehab_session", "fact_rehab_outcome"]


def _logs(h: Health) -> Logs:
    return Logs(h.spark, h.sf_dir)


def _counted(h: Health):
    return {name.upper(): getattr(h, name) for name in COUNTED} | {"RAW_CLAIMS": h.raw_claims}


def _masked(column: str, mask):
    def run(h: Health):
        return h.dim_patient.select("patient_id", *[mask(F.col(column), r).alias(r.lower()) for r in ROLES])

    return run


def _rated(h: Health):
    return q.quality_status(h.dim_patient)


def _events(h: Health):
    return feeds.read_feed(h.spark, h.sf_dir, "events.parquet")


def _ids(h: Health, table: str, key: str):
    return bridge.star(h.spark, h.sf_dir, table).select(F.col(key).alias("id"))


def _metrics(table, measures, dims=(), grain=None, where=None):
    return lambda h: y.metrics({table: getattr(h, table)}, table, measures, dims, grain, where)


# Queries of one operator id show the same view.
MARTS = sorted({name.split("_")[0] for name in clinical.QUERIES if name.startswith("m")})
SESSION_MEASURES = list(y.MODEL["fact_rehab_session"]["measures"])

QUERIES = {
    "q1_category_distribution": lambda h: q.distribution(h.fact_diagnosis, "cardiac_category"),
    "q2_patient_nulls": lambda h: q.patient_nulls(h.dim_patient),
    "q3_safety_rate": lambda h: q.safety_rate(h.fact_rehab_session),
    "q4_orphan_sessions": lambda h: q.orphans(
        h.fact_rehab_session, h.fact_rehab_referral, "referral_id", "orphan_sessions",
        "PASS: All sessions have valid referrals", "orphan sessions found",
    ),
    "q5_orphan_encounters": lambda h: q.orphans(
        h.fact_encounter, h.dim_patient, "patient_id", "orphan_encounters",
        "PASS: All encounters have valid patients", "orphan encounters",
    ),
    "q6_hemodynamic_ranges": lambda h: q.hemodynamic_ranges(h.fact_rehab_session),
    "q7_drug_class_distribution": lambda h: q.drug_class_distribution(h.fact_medication),
    "q8_outcome_completeness": lambda h: q.outcome_completeness(h.fact_rehab_outcome),
    "q9_key_checks": lambda h: q.key_checks({
        "raw_diagnoses": (h.raw_diagnoses, "diagnosis_id"),
        "fact_diagnosis": (h.fact_diagnosis, "diagnosis_id"),
        "raw_encounters": (h.raw_encounters, "encounter_id"),
        "fact_encounter": (h.fact_encounter, "encounter_id"),
        "fact_rehab_session": (h.fact_rehab_session, "referral_id"),
    }),
    "q10_total_records": lambda h: q.total_records(_counted(h)),
    "q11_target_checks": lambda h: q.target_checks(_counted(h)),
    "q12_risk_distribution": lambda h: q.risk_distribution(h.fact_rehab_referral),
    "q13_encounter_distribution": lambda h: q.encounter_distribution(h.fact_encounter),
    "q14_payer_distribution": lambda h: q.payer_distribution(h.raw_claims),
    "q15_first_sessions": lambda h: q.first_sessions(h.dim_patient, h.fact_rehab_referral, h.fact_rehab_session),
    "q16_program_totals": lambda h: steady(
        q.program_totals(gold.rehab_program_summary(h.fact_rehab_referral, h.fact_rehab_session)), "avg_adherence_pct"
    ),
    "q17_comparison_totals": lambda h: q.comparison_totals(gold.outcome_comparison(h.fact_rehab_outcome)),
    "q18_cohort_by_risk": lambda h: steady(
        q.cohort_by_risk(gold.cardiac_cohort(h.dim_patient, h.fact_rehab_referral)), "avg_lvef", "avg_mets"
    ),
    "q19_latest_cms": lambda h: q.latest_cms(gold.cms_cardiac_rehab(h.fact_rehab_referral, h.fact_rehab_session)),
    "q20_claims_by_payer": lambda h: steady(
        q.claims_by_payer(gold.claims_summary(h.raw_claims)), "avg_collection_rate"
    ),
    "q21_platform_health": lambda h: q.platform_health(
        h.silver_tables(), _logs(h).roles, since_midnight(_logs(h).query_history, "start_time", _logs(h).as_of, 30, "DAY"),
        _logs(h).tag_references, MARTS,
    ),
    "q22_quality_status": lambda h: _rated(h).select("patient_id", "dq_status"),
    "n1_mask_patient_phi": _masked("last_name", masks.mask_patient_phi),
    "n2_mask_ssn": _masked("ssn", masks.mask_ssn),
    "n3_mask_dob": _masked("date_of_birth", masks.mask_dob),
    "n4_mask_email": _masked("email", masks.mask_phone_email),
    "n4_mask_phone": _masked("phone", masks.mask_phone_email),
    "n5_quality_row_filter": lambda h: n.filter_by_quality(_rated(h), "HEALTH_ANALYST").select("patient_id", "dq_status"),
    "n5_visible_by_role": lambda h: n.visible_by_role(_rated(h), ROLES),
    "n6_care_team_row_filter": lambda h: n.filter_by_care_team(
        h.dim_patient, h.care_team_assignments, "HEALTH_READONLY", READER
    ).select("patient_id", "gender"),
    "n7_bound_policies_readonly": lambda h: n.patients_for(
        _rated(h), h.care_team_assignments, "HEALTH_READONLY", READER
    ).select("patient_id", *n.PATIENT_MASKS, "dq_status"),
    "n7_bound_policies_engineer": lambda h: n.patients_for(
        _rated(h), h.care_team_assignments, "HEALTH_DATA_ENGINEER", READER
    ).select("patient_id", *n.PATIENT_MASKS, "dq_status"),
    "n8_tag_usage": lambda h: n.tag_usage(h.spark, _logs(h).tag_references),
    "n8_columns_tagged": lambda h: n.columns_tagged(
        _logs(h).tag_references, "RETENTION_POLICY", ["7_YEARS", "10_YEARS"]
    ),
    "n8_effective_roles": lambda h: n.effective_roles(h.spark, _logs(h).grants_to_users),
    "y1_metric_query": _metrics(
        "fact_rehab_session", ["total_sessions", "avg_peak_hr"], ["modality", "therapist"],
        ("session_date", "MONTH"), "NOT safety_flag",
    ),
    "y2_metrics_across": lambda h: steady(
        y.metrics_across(
            h.silver_tables(), ("dim_patient", "gender"),
            {
                "dim_patient": ["patient_count", "average_age"],
                "fact_rehab_referral": ["referral_count", "avg_lvef"],
                "fact_rehab_session": ["total_sessions", "avg_hrr_percent"],
                "fact_rehab_outcome": ["avg_6mwt"],
            },
        ),
        "avg_hrr_percent",
    ),
    "y3_patient_metrics": _metrics("dim_patient", ["patient_count", "average_age"], ["gender", "age_group"]),
    "y4_session_metrics": lambda h: steady(
        y.metrics({"fact_rehab_session": h.fact_rehab_session}, "fact_rehab_session", SESSION_MEASURES, ["modality"]),
        "avg_hrr_percent",
    ),
    "y5_referral_metrics": _metrics(
        "fact_rehab_referral", ["referral_count", "avg_lvef", "avg_days_to_referral"],
        ["risk_category", "qualifying_diagnosis"],
    ),
    "y6_outcome_metrics": _metrics(
        "fact_rehab_outcome", ["avg_6mwt", "avg_peak_mets", "avg_phq9", "avg_bmi"],
        ["measurement_point", "depression_severity"],
    ),
    "y7_referrals_by_day": _metrics("fact_rehab_referral", ["referral_count"], (), ("referral_date", "DAY")),
    "y7_outcomes_by_month": _metrics("fact_rehab_outcome", ["avg_6mwt"], (), ("measurement_date", "MONTH")),
    "z1_failure_spikes": lambda h: monitors.failure_spikes(_events(h), "ts", F.col("event_type") == "error", 1),
    "z2_login_spikes": lambda h: monitors.login_spikes(
        _events(h).withColumn("user", F.concat(F.lit("USER_"), F.col("user_id").cast("string"))),
        "ts", "user", F.col("event_type") == "error", 2,
    ),
    "z3_daily_sessions": lambda h: monitors.daily_sessions(
        bridge.raw_rehab_sessions(
            h.spark,
            bridge.lines_with_patient(h.spark, h.sf_dir, feeds.read_feed(h.spark, h.sf_dir, "lineitem.parquet")),
        )
    ),
    "z4_newest_encounters": lambda h: monitors.newest_per_key(
        bridge.raw_encounters(h.spark, h.sf_dir, feeds.read_feed(h.spark, h.sf_dir, "orders.parquet")),
        "encounter_id", "load_timestamp", "record_id",
    ).select("encounter_id", "discharge_status", "load_timestamp"),
    "z4_without_repeats": lambda h: monitors.without_repeats(_events(h), ["event_id"], "ts").select(
        "event_id", "user_id", "event_type"
    ),
    "h1_patients": lambda h: gen.patients(_ids(h, "customer", "c_custkey"), h.as_of),
    "h2_encounters": lambda h: gen.encounters(_ids(h, "orders", "o_orderkey"), h.as_of),
    "h3_diagnoses": lambda h: gen.diagnoses(_ids(h, "orders", "o_orderkey"), h.as_of),
    "h4_medications": lambda h: gen.medications(_ids(h, "orders", "o_orderkey"), h.as_of),
    "h5_referrals": lambda h: gen.referrals(_ids(h, "customer", "c_custkey"), h.as_of),
    "h6_sessions": lambda h: gen.sessions(_ids(h, "customer", "c_custkey"), h.as_of),
    "h7_outcomes": lambda h: gen.outcomes(_ids(h, "customer", "c_custkey"), h.as_of),
    "h8_labs": lambda h: gen.labs(_ids(h, "events", "event_id"), h.as_of),
    "h9_vitals": lambda h: gen.vitals(_ids(h, "events", "event_id"), h.as_of),
    "h10_claims": lambda h: gen.claims(_ids(h, "orders", "o_orderkey"), h.as_of),
    "h11_clinical_notes": lambda h: gen.clinical_notes(_ids(h, "documents", "doc_id"), h.as_of),
}
