"""Expected results of the silver, gold and dashboard queries."""

from __future__ import annotations

from checks.silver import AGE_GROUP
from checks.sqltext import CLINICAL_DAY, exact, key, printed, r, weeks
from pulsemart.catalog.clinical import PATIENT

DATE = lambda c: f"CAST({c} AS VARCHAR) AS {c}"
STAMP = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"

JOINED_SESSIONS = """
    fact_rehab_referral r LEFT JOIN fact_rehab_session s ON r.referral_id = s.referral_id
    LEFT JOIN (SELECT referral_id, count(*) AS total_sessions FROM fact_rehab_session GROUP BY 1) ps
      ON r.referral_id = ps.referral_id"""

COHORT = f"""
    SELECT p.gender, p.ethnicity, {AGE_GROUP} AS age_group, r.computed_risk AS risk_category, r.qualifying_diagnosis,
           count(DISTINCT p.patient_id) AS patient_count, avg(r.lvef_percent) AS avg_lvef,
           avg(r.gxt_peak_mets) AS avg_peak_mets
    FROM dim_patient p JOIN fact_rehab_referral r ON p.patient_id = r.patient_id GROUP BY ALL"""

ROUNDED_COHORT = f"""
    SELECT * REPLACE ({r('avg_lvef', 1)} AS avg_lvef, {r('avg_peak_mets', 1)} AS avg_peak_mets) FROM ({COHORT})"""

PAIRS = """
    fact_rehab_outcome b JOIN fact_rehab_outcome d ON b.referral_id = d.referral_id
      AND b.measurement_point = 'BASELINE' AND d.measurement_point = 'DISCHARGE'"""

DEMOGRAPHICS = f"""
    SELECT gender, ethnicity, {AGE_GROUP} AS age_group, count(*) AS patient_count, {r('avg(age)', 1)} AS avg_age
    FROM dim_patient WHERE is_current GROUP BY 1, 2, 3"""

DENIED = "CAST(sum(CASE WHEN claim_status = 'DENIED' THEN 1 ELSE 0 END) AS BIGINT)"
MONEY = lambda c: exact(f"sum({c})")
COLLECTED = r("CAST(sum(paid_amount) AS DOUBLE) / nullif(CAST(sum(billed_amount) AS DOUBLE), 0) * 100", 1)

BY_PAYER = f"""
    SELECT payer_name, claim_type, count(*) AS claim_count, {MONEY('billed_amount')} AS total_billed,
           {MONEY('allowed_amount')} AS total_allowed, {MONEY('paid_amount')} AS total_paid,
           {MONEY('patient_responsibility')} AS total_patient_resp, {DENIED} AS denials,
           {r(f"{DENIED} * 100.0::DOUBLE / count(*)", 1)} AS denial_rate, {COLLECTED} AS collection_rate
    FROM raw_claims GROUP BY 1, 2"""

BY_REASON = f"""
    SELECT denial_reason, payer_name, count(*) AS denial_count, {MONEY('billed_amount')} AS denied_amount
    FROM raw_claims WHERE claim_status = 'DENIED' AND denial_reason IS NOT NULL GROUP BY 1, 2"""

SUMMARY = """
    fact_encounter e JOIN dim_patient p ON e.patient_id = p.patient_id AND p.is_current
    LEFT JOIN fact_diagnosis d ON e.encounter_id = d.encounter_id AND d.diagnosis_type = 'PRIMARY'
    LEFT JOIN fact_medication m ON e.encounter_id = m.encounter_id
    LEFT JOIN fact_rehab_referral r ON e.patient_id = r.patient_id
    LEFT JOIN fact_rehab_session s ON r.referral_id = s.referral_id"""


def total(table: str) -> str:
    return f"(SELECT count(*) FROM {table})"


def rate(condition: str, table: str, places: int) -> str:
    return "(SELECT " + r(f"avg(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0 END) * 100", places) + f" FROM {table})"


def first_outcome(point: str) -> str:
    return f"""(SELECT * FROM fact_rehab_outcome WHERE measurement_point = '{point}'
                QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY outcome_id) = 1)"""


def change(name: str) -> str:
    return f"CASE WHEN b.{name} <> 0 AND d.{name} <> 0 THEN d.{name} - b.{name} END"


THOUSANDTHS = lambda c: f"CAST(CAST(round({c} * 1000) AS BIGINT) AS VARCHAR)"
SECONDS = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
# All columns of the clinical summary as text, in its order.
VIEW = [
    "e.encounter_id", "e.patient_id", "p.first_name || ' ' || p.last_name", "CAST(p.age AS VARCHAR)", "p.gender",
    "p.ethnicity", "e.encounter_type", "e.department", "e.attending_provider", SECONDS("e.admit_date"),
    SECONDS("e.discharge_date"), "CAST(e.length_of_stay_days AS VARCHAR)", "e.discharge_status", "d.icd_code",
    "d.description", "d.cardiac_category", "m.medication_name", "m.drug_class", "r.qualifying_diagnosis",
    "r.computed_risk", THOUSANDTHS("r.lvef_percent"), "CAST(s.session_number AS VARCHAR)",
    THOUSANDTHS("s.achieved_hrr_percent"), "CAST(s.safety_flag AS VARCHAR)",
]

SQL = {
    "t1_dim_patient": f"""
        SELECT * EXCLUDE (load_timestamp) REPLACE (CAST(date_of_birth AS VARCHAR) AS date_of_birth), TRUE AS is_active,
               {printed('load_timestamp')} AS effective_from, '9999-12-31 00:00:00.000000' AS effective_to
        FROM dim_patient""",
    "t2_fact_encounter": """
        SELECT * REPLACE (strftime(admit_date, '%Y-%m-%d %H:%M:%S.%f') AS admit_date,
                          strftime(discharge_date, '%Y-%m-%d %H:%M:%S.%f') AS discharge_date) FROM fact_encounter""",
    "t3_fact_diagnosis": "SELECT * REPLACE (CAST(diagnosis_date AS VARCHAR) AS diagnosis_date) FROM fact_diagnosis",
    "t4_fact_medication": """
        SELECT * REPLACE (CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date)
        FROM fact_medication""",
    "t5_fact_lab_result": """
        SELECT * REPLACE (strftime(collected_at, '%Y-%m-%d %H:%M:%S.%f') AS collected_at) FROM fact_lab_result""",
    "t6_fact_rehab_referral": """
        SELECT * REPLACE (CAST(cardiac_event_date AS VARCHAR) AS cardiac_event_date,
                          CAST(referral_date AS VARCHAR) AS referral_date) FROM fact_rehab_referral""",
    "t7_fact_rehab_session": "SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date) FROM fact_rehab_session",
    "t8_fact_rehab_outcome": """
        SELECT * REPLACE (CAST(measurement_date AS VARCHAR) AS measurement_date) FROM fact_rehab_outcome""",
    "t10_active_care_team": f"""
        SELECT * REPLACE (CAST(assigned_date AS VARCHAR) AS assigned_date, CAST(end_date AS VARCHAR) AS end_date)
        FROM care_team_assignments
        WHERE assigned_date <= CAST({CLINICAL_DAY} AS DATE)
          AND (end_date IS NULL OR end_date >= CAST({CLINICAL_DAY} AS DATE))""",
    "m1_rehab_program_summary": f"""
        SELECT r.patient_id, r.referral_id, r.qualifying_diagnosis, r.computed_risk AS risk_category, r.lvef_percent,
               CAST(r.referral_date AS VARCHAR) AS referral_date, r.days_event_to_referral,
               count(s.session_id) AS total_sessions, CAST(min(s.session_date) AS VARCHAR) AS first_session_date,
               CAST(max(s.session_date) AS VARCHAR) AS last_session_date,
               {weeks('min(s.session_date)', 'max(s.session_date)')} AS program_weeks,
               avg(s.duration_minutes) AS avg_duration_min, round(avg(s.achieved_hrr_percent), 6) AS avg_hrr_percent,
               avg(s.rpe_peak) AS avg_rpe,
               CAST(sum(CASE WHEN s.safety_flag THEN 1 ELSE 0 END) AS BIGINT) AS safety_flag_count,
               CAST(sum(CASE WHEN s.exercise_terminated_early THEN 1 ELSE 0 END) AS BIGINT) AS early_terminations,
               {r('count(s.session_id)::DOUBLE / 36 * 100', 1)} AS adherence_rate_pct
        FROM fact_rehab_referral r LEFT JOIN fact_rehab_session s ON r.referral_id = s.referral_id
        GROUP BY r.patient_id, r.referral_id, r.qualifying_diagnosis, r.computed_risk, r.lvef_percent,
                 r.referral_date, r.days_event_to_referral""",
    "m2_outcome_comparison": f"""
        SELECT b.patient_id, b.referral_id, b.six_min_walk_meters AS baseline_6mwt,
               d.six_min_walk_meters AS discharge_6mwt, d.six_min_walk_meters - b.six_min_walk_meters AS delta_6mwt,
               CASE WHEN d.six_min_walk_meters - b.six_min_walk_meters >= 25 THEN 'CLINICALLY_SIGNIFICANT'
                    ELSE 'NOT_SIGNIFICANT' END AS mcid_6mwt,
               b.peak_mets AS baseline_mets, d.peak_mets AS discharge_mets, d.peak_mets - b.peak_mets AS delta_mets,
               b.phq9_score AS baseline_phq9, d.phq9_score AS discharge_phq9, d.phq9_score - b.phq9_score AS delta_phq9,
               b.bmi AS baseline_bmi, d.bmi AS discharge_bmi, b.ldl AS baseline_ldl, d.ldl AS discharge_ldl,
               b.hba1c AS baseline_hba1c, d.hba1c AS discharge_hba1c
        FROM {PAIRS}""",
    "m3_cardiac_cohort": COHORT,
    "m4_daily_session_metrics": """
        SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS sessions_conducted,
               count(DISTINCT patient_id) AS unique_patients, avg(duration_minutes) AS avg_duration,
               avg(peak_hr) AS avg_peak_hr, avg(rpe_peak) AS avg_rpe,
               CAST(sum(CASE WHEN safety_flag THEN 1 ELSE 0 END) AS BIGINT) AS safety_incidents,
               CAST(sum(ecg_monitor_minutes) AS BIGINT) AS total_ecg_minutes
        FROM fact_rehab_session GROUP BY 1""",
    "m5_cms_cardiac_rehab": f"""
        SELECT CAST(CAST(date_trunc('month', r.referral_date) AS DATE) AS VARCHAR) AS referral_month,
               count(DISTINCT r.referral_id) AS total_referrals,
               count(DISTINCT s.referral_id) AS referrals_with_sessions,
               {r('count(DISTINCT s.referral_id)::DOUBLE / nullif(count(DISTINCT r.referral_id), 0) * 100', 1)}
                 AS enrollment_rate_pct,
               round(avg(r.days_event_to_referral), 6) AS avg_days_to_referral,
               count(DISTINCT CASE WHEN ps.total_sessions >= 36 THEN r.referral_id END) AS completed_programs,
               {r("count(DISTINCT CASE WHEN ps.total_sessions >= 36 THEN r.referral_id END)::DOUBLE"
                  " / nullif(count(DISTINCT s.referral_id), 0) * 100", 1)} AS completion_rate_pct
        FROM {JOINED_SESSIONS} GROUP BY 1""",
    "m6_claims_summary": f"""
        SELECT CAST(CAST(date_trunc('month', service_date) AS DATE) AS VARCHAR) AS service_month, payer_name,
               claim_type, count(*) AS claim_count, {MONEY('billed_amount')} AS total_billed,
               {MONEY('allowed_amount')} AS total_allowed, {MONEY('paid_amount')} AS total_paid,
               {MONEY('billed_amount - paid_amount')} AS total_write_off, {COLLECTED} AS collection_rate_pct,
               {DENIED} AS denials
        FROM raw_claims GROUP BY 1, 2, 3""",
    "m7_patient_hemodynamic_trend": """
        SELECT patient_id, session_number, CAST(session_date AS VARCHAR) AS session_date, modality, resting_hr, peak_hr,
               recovery_hr, hr_recovery_delta, resting_bp_systolic || '/' || resting_bp_diastolic AS resting_bp,
               peak_bp_systolic || '/' || peak_bp_diastolic AS peak_bp, rpe_peak, achieved_hrr_percent, spo2_min,
               ecg_rhythm, safety_flag, duration_minutes FROM fact_rehab_session""",
    "m8_clinical_summary": f"""
        SELECT e.encounter_id, e.patient_id, p.first_name || ' ' || p.last_name AS patient_name,
               count(*) AS summary_rows, min(p.age) AS age, min(e.length_of_stay_days) AS length_of_stay_days,
               count(d.icd_code) AS diagnosis_rows, max(d.cardiac_category) AS cardiac_category,
               count(m.medication_name) AS medication_rows, min(m.drug_class) AS drug_class,
               min(r.computed_risk) AS rehab_risk_category, max(r.lvef_percent) AS lvef_percent,
               CAST(sum(s.session_number) AS BIGINT) AS session_number_sum,
               max(s.achieved_hrr_percent) AS max_hrr_percent,
               CAST(sum(CASE WHEN s.safety_flag THEN 1 ELSE 0 END) AS BIGINT) AS flagged_rows
        FROM {SUMMARY} GROUP BY 1, 2, 3""",
    "m8_clinical_summary_rows": f"""
        SELECT encounter_id, patient_id, count(*) AS summary_rows,
               CAST(sum(CAST('0x' || left(md5(line), 8) AS BIGINT)) AS BIGINT) AS row_digests
        FROM (SELECT e.encounter_id, e.patient_id, concat_ws('|', {", ".join(f"coalesce({c}, '')" for c in VIEW)}) AS line
              FROM {SUMMARY}) GROUP BY 1, 2""",
    "m9_diagnosis_category_counts": """
        SELECT cardiac_category, count(*) AS num_diagnoses, count(DISTINCT patient_id) AS unique_patients
        FROM fact_diagnosis WHERE cardiac_category IS NOT NULL GROUP BY 1""",
    "d1_platform_kpis": f"""
        SELECT (SELECT count(*) FROM dim_patient WHERE is_current) AS total_patients,
               {total('fact_encounter')} AS total_encounters, {total('fact_rehab_referral')} AS total_referrals,
               {total('fact_rehab_session')} AS total_sessions, {total('fact_diagnosis')} AS total_diagnoses,
               {total('fact_medication')} AS total_medications, {total('fact_lab_result')} AS total_labs,
               {total('raw_claims')} AS total_claims, {rate('safety_flag', 'fact_rehab_session', 2)} AS safety_pct,
               {rate("discharge_status = 'EXPIRED'", 'fact_encounter', 2)} AS mortality_pct,
               {rate("claim_status = 'DENIED'", 'raw_claims', 1)} AS denial_pct,
               (SELECT count(DISTINCT patient_id) FROM fact_rehab_session) AS active_rehab""",
    "d2_daily_sessions": f"""
        SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS sessions,
               count(DISTINCT patient_id) AS patients, {r('avg(peak_hr)', 1)} AS avg_peak_hr,
               CAST(sum(CASE WHEN safety_flag THEN 1 ELSE 0 END) AS BIGINT) AS safety_events
        FROM fact_rehab_session GROUP BY session_date ORDER BY session_date DESC LIMIT 90""",
    "d3_risk_distribution": """
        SELECT computed_risk AS risk_category, count(*) AS count FROM fact_rehab_referral GROUP BY 1""",
    "d4_encounter_types": "SELECT encounter_type, count(*) AS count FROM fact_encounter GROUP BY 1",
    "d5_rehab_patient_list": """
        SELECT patient_id, first_name || ' ' || last_name AS patient_name, age, gender, ethnicity FROM dim_patient
        WHERE is_current AND patient_id IN (SELECT DISTINCT patient_id FROM fact_rehab_referral)
        ORDER BY patient_id LIMIT 500""",
    "d6_patient_sessions": f"""
        SELECT session_number, CAST(session_date AS VARCHAR) AS session_date, modality, duration_minutes, resting_hr,
               peak_hr, recovery_hr, hr_recovery_delta, rpe_peak, spo2_min, achieved_hrr_percent, safety_flag,
               resting_bp_systolic, peak_bp_systolic, ecg_rhythm FROM fact_rehab_session
        WHERE patient_id = '{PATIENT}'""",
    "d7_patient_outcomes": f"""
        SELECT measurement_point, six_min_walk_meters, peak_mets, dasi_score, phq9_score, weight_kg, bmi, hba1c, ldl,
               hdl, total_cholesterol, depression_severity FROM fact_rehab_outcome WHERE patient_id = '{PATIENT}'""",
    "d8_patient_referral": f"""
        SELECT referral_id, qualifying_diagnosis, CAST(cardiac_event_date AS VARCHAR) AS cardiac_event_date,
               lvef_percent, gxt_peak_hr, gxt_peak_mets, computed_risk, CAST(referral_date AS VARCHAR) AS referral_date,
               days_event_to_referral FROM fact_rehab_referral WHERE patient_id = '{PATIENT}'
        ORDER BY referral_id LIMIT 1""",
    "d9_patient_medications": f"""
        SELECT medication_name, drug_class, dosage, route, frequency, CAST(start_date AS VARCHAR) AS start_date
        FROM (SELECT * FROM fact_medication WHERE patient_id = '{PATIENT}'
              ORDER BY fact_medication.start_date DESC, medication_id LIMIT 20)""",
    "d10_patient_diagnoses": f"""
        SELECT icd_code, description, cardiac_category, diagnosis_type, CAST(diagnosis_date AS VARCHAR) AS diagnosis_date
        FROM (SELECT * FROM fact_diagnosis WHERE patient_id = '{PATIENT}'
              ORDER BY fact_diagnosis.diagnosis_date DESC, diagnosis_id LIMIT 20)""",
    "d11_outcome_deltas": f"""
        SELECT patient_id, delta_6mwt, {r('raw_mets', 1)} AS delta_mets, delta_phq9, {r('raw_bmi', 1)} AS delta_bmi,
               delta_ldl,
               CASE WHEN delta_6mwt >= 25 THEN 'CLINICALLY SIGNIFICANT' ELSE 'Not significant' END AS mcid_assessment
        FROM (SELECT b.patient_id, CAST(trunc({change('six_min_walk_meters')}) AS BIGINT) AS delta_6mwt,
                     {change('peak_mets')} AS raw_mets, CAST(d.phq9_score - b.phq9_score AS BIGINT) AS delta_phq9,
                     {change('bmi')} AS raw_bmi, CAST(trunc({change('ldl')}) AS BIGINT) AS delta_ldl
              FROM {first_outcome('BASELINE')} b JOIN {first_outcome('DISCHARGE')} d ON b.patient_id = d.patient_id)""",
    "d12_cohort": ROUNDED_COHORT,
    "d13_demographics": DEMOGRAPHICS,
    "d14_diagnosis_prevalence": f"""
        SELECT cardiac_category, count(DISTINCT patient_id) AS patients, count(*) AS total_diagnoses,
               {r("count(DISTINCT patient_id) * 100.0::DOUBLE / (SELECT count(*) FROM dim_patient WHERE is_current)", 1)}
                 AS prevalence_pct
        FROM fact_diagnosis WHERE cardiac_category IS NOT NULL GROUP BY 1""",
    "d15_comorbidity_pairs": """
        SELECT d1.cardiac_category AS condition_1, d2.cardiac_category AS condition_2,
               count(DISTINCT d1.patient_id) AS co_occurrence
        FROM fact_diagnosis d1 JOIN fact_diagnosis d2
          ON d1.patient_id = d2.patient_id AND d1.cardiac_category < d2.cardiac_category
        GROUP BY 1, 2 HAVING count(DISTINCT d1.patient_id) > 5
        ORDER BY co_occurrence DESC, condition_1, condition_2 LIMIT 20""",
    "d16_demographic_rollups": f"""
        WITH cells AS ({DEMOGRAPHICS})
        SELECT 'age_group' AS axis, age_group AS value, CAST(sum(patient_count) AS BIGINT) AS patient_count
        FROM cells WHERE age_group IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'gender', gender, CAST(sum(patient_count) AS BIGINT) FROM cells
        WHERE gender IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'ethnicity', ethnicity, CAST(sum(patient_count) AS BIGINT) FROM cells
        WHERE ethnicity IS NOT NULL GROUP BY 2""",
    "d17_cohort_by_risk_and_diagnosis": f"""
        SELECT risk_category, qualifying_diagnosis, CAST(sum(patient_count) AS BIGINT) AS patient_count
        FROM ({COHORT}) WHERE risk_category IN ('LOW', 'MODERATE', 'HIGH') GROUP BY 1, 2""",
    "d17_cohort_totals": f"""
        SELECT CAST(sum(patient_count) AS BIGINT) AS total_cohort, {r('avg(avg_lvef)', 1)} AS avg_lvef,
               {r('avg(avg_peak_mets)', 1)} AS avg_peak_mets
        FROM ({ROUNDED_COHORT}) WHERE risk_category IN ('HIGH', 'LOW')""",
    "d18_cms_metrics": f"""
        SELECT CAST(CAST(date_trunc('month', r.referral_date) AS DATE) AS VARCHAR) AS referral_month,
               count(DISTINCT r.referral_id) AS total_referrals,
               count(DISTINCT s.referral_id) AS referrals_with_sessions,
               {r('count(DISTINCT s.referral_id)::DOUBLE / nullif(count(DISTINCT r.referral_id), 0) * 100', 1)}
                 AS enrollment_rate_pct,
               {r('avg(r.days_event_to_referral)', 1)} AS avg_days_to_referral,
               count(DISTINCT CASE WHEN ps.total_sessions >= 36 THEN r.referral_id END) AS completed_programs
        FROM {JOINED_SESSIONS} GROUP BY 1""",
    "d19_adherence_by_risk": f"""
        SELECT r.computed_risk AS risk_category, count(DISTINCT r.referral_id) AS total_programs,
               {r('avg(s.n)', 1)} AS avg_sessions, {r('avg(s.n) * 100.0::DOUBLE / 36', 1)} AS avg_adherence_pct,
               CAST(sum(CASE WHEN s.n >= 36 THEN 1 ELSE 0 END) AS BIGINT) AS completed,
               {r('sum(CASE WHEN s.n >= 36 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*)', 1)} AS completion_rate
        FROM fact_rehab_referral r
        LEFT JOIN (SELECT referral_id, count(*) AS n FROM fact_rehab_session GROUP BY 1) s
          ON r.referral_id = s.referral_id GROUP BY 1""",
    "d20_safety_by_modality": f"""
        SELECT modality, count(*) AS total_sessions,
               CAST(sum(CASE WHEN safety_flag THEN 1 ELSE 0 END) AS BIGINT) AS safety_events,
               {r('sum(CASE WHEN safety_flag THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*)', 2)} AS safety_rate_pct,
               CAST(sum(CASE WHEN exercise_terminated_early THEN 1 ELSE 0 END) AS BIGINT) AS early_terminations,
               {r('avg(ecg_monitor_minutes)', 1)} AS avg_ecg_minutes
        FROM fact_rehab_session GROUP BY 1""",
    "d21_outcome_improvement": f"""
        SELECT r.computed_risk, {r('avg(d.six_min_walk_meters - b.six_min_walk_meters)', 1)} AS avg_6mwt_change,
               {r('avg(d.peak_mets - b.peak_mets)', 2)} AS avg_mets_change,
               {r('avg(d.phq9_score - b.phq9_score)', 1)} AS avg_phq9_change,
               CAST(sum(CASE WHEN d.six_min_walk_meters - b.six_min_walk_meters >= 25 THEN 1 ELSE 0 END) AS BIGINT)
                 AS mcid_met,
               count(*) AS total_measured,
               {r('sum(CASE WHEN d.six_min_walk_meters - b.six_min_walk_meters >= 25 THEN 1 ELSE 0 END)'
                  ' * 100.0::DOUBLE / count(*)', 1)} AS mcid_rate
        FROM fact_rehab_referral r
        JOIN fact_rehab_outcome b ON r.referral_id = b.referral_id AND b.measurement_point = 'BASELINE'
        JOIN fact_rehab_outcome d ON r.referral_id = d.referral_id AND d.measurement_point = 'DISCHARGE'
        GROUP BY 1""",
    "d22_claims_by_payer": BY_PAYER,
    "d23_denial_reasons": BY_REASON,
    "d24_revenue_summary": f"""
        SELECT {exact('round(sum(billed_amount), 0)', 0)} AS total_billed,
               {exact('round(sum(allowed_amount), 0)', 0)} AS total_allowed,
               {exact('round(sum(paid_amount), 0)', 0)} AS total_paid,
               {exact('round(sum(billed_amount) - sum(paid_amount), 0)', 0)} AS total_write_off,
               {exact('round(sum(patient_responsibility), 0)', 0)} AS total_patient_resp, count(*) AS total_claims,
               {DENIED} AS total_denials,
               CAST(sum(CASE WHEN claim_status = 'PAID' THEN 1 ELSE 0 END) AS BIGINT) AS total_paid_claims,
               {COLLECTED} AS net_collection_rate
        FROM raw_claims""",
    "d25_monthly_revenue": f"""
        SELECT CAST(CAST(date_trunc('month', service_date) AS DATE) AS VARCHAR) AS service_month,
               {exact('round(sum(billed_amount), 0)', 0)} AS billed,
               {exact('round(sum(paid_amount), 0)', 0)} AS paid, count(*) AS claims
        FROM raw_claims WHERE service_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24""",
    "d26_payer_rollup": f"""
        SELECT payer_name, CAST(sum(claim_count) AS BIGINT) AS claim_count,
               {exact('sum(CAST(total_billed AS DECIMAL(18,2)))')} AS total_billed,
               {exact('sum(CAST(total_paid AS DECIMAL(18,2)))')} AS total_paid,
               CAST(sum(denials) AS BIGINT) AS denials FROM ({BY_PAYER}) GROUP BY 1""",
    "d26_denial_reason_rollup": f"""
        SELECT denial_reason, CAST(sum(denial_count) AS BIGINT) AS denial_count,
               {exact('sum(CAST(denied_amount AS DECIMAL(18,2)))')} AS denied_amount
        FROM ({BY_REASON}) GROUP BY 1""",
    "k4_clinical_summary_sample": f"""
        SELECT patient_name, age, gender, encounter_type, department, diagnosis_description, cardiac_category,
               medication_name, drug_class, rehab_risk_category, lvef_percent
        FROM (SELECT p.first_name || ' ' || p.last_name AS patient_name, p.age, p.gender, e.encounter_type,
                     e.department, d.description AS diagnosis_description, d.cardiac_category, m.medication_name,
                     m.drug_class, r.computed_risk AS rehab_risk_category, r.lvef_percent
              FROM {SUMMARY}
              ORDER BY e.encounter_id, d.icd_code NULLS FIRST, m.medication_name NULLS FIRST,
                       r.qualifying_diagnosis NULLS FIRST, s.session_number NULLS FIRST LIMIT 20)""",
}

# Surrogate key and business id of the stored tables.
STORED = {
    "t1_dim_patient": ("patient_key", "patient_id"), "t2_fact_encounter": ("encounter_key", "encounter_id"),
    "t3_fact_diagnosis": ("diagnosis_key", "diagnosis_id"), "t4_fact_medication": ("medication_key", "medication_id"),
    "t5_fact_lab_result": ("lab_key", "lab_id"), "t6_fact_rehab_referral": ("referral_key", "referral_id"),
    "t7_fact_rehab_session": ("session_key", "session_id"), "t8_fact_rehab_outcome": ("outcome_key", "outcome_id"),
}
for name, (surrogate, business_id) in STORED.items():
    SQL[name] = f"""
        SELECT {key(business_id)} AS {surrogate}, t.*, {printed(CLINICAL_DAY)} AS transformed_at FROM ({SQL[name]}) t"""
