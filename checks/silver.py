"""Silver tables in SQL."""

from __future__ import annotations

from checks.sqltext import CLINICAL_DAY, r

NEWEST = "QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY load_timestamp DESC NULLS FIRST, record_id DESC) = 1"

AGE_GROUP = """CASE WHEN age < 45 THEN '<45' WHEN age < 55 THEN '45-54' WHEN age < 65 THEN '55-64'
               WHEN age < 75 THEN '65-74' ELSE '75+' END"""

TABLES = {
    "dim_patient": f"""
        SELECT patient_id, upper(trim(first_name)) AS first_name, upper(trim(last_name)) AS last_name, date_of_birth,
               year({CLINICAL_DAY}) - year(date_of_birth) AS age, upper(trim(gender)) AS gender,
               trim(ethnicity) AS ethnicity, ssn, address, phone, lower(trim(email)) AS email, insurance_id,
               primary_language, marital_status, TRUE AS is_current, load_timestamp
        FROM raw_patients {NEWEST.format(key='patient_id')}""",
    "fact_encounter": f"""
        SELECT encounter_id, patient_id, upper(trim(encounter_type)) AS encounter_type, admit_date, discharge_date,
               CAST(CAST(coalesce(discharge_date, {CLINICAL_DAY}) AS DATE) - CAST(admit_date AS DATE) AS BIGINT)
                 AS length_of_stay_days,
               department, attending_provider, facility_code, admit_diagnosis_code, discharge_status
        FROM raw_encounters {NEWEST.format(key='encounter_id')}""",
    "fact_diagnosis": f"""
        SELECT diagnosis_id, encounter_id, patient_id, trim(icd_code) AS icd_code, icd_version, description,
               diagnosis_type, diagnosis_date,
               CASE WHEN icd_code ILIKE 'I21%' OR icd_code ILIKE '410%' THEN 'ACUTE_MI'
                    WHEN icd_code ILIKE 'I25%' OR icd_code ILIKE '414%' THEN 'CHRONIC_IHD'
                    WHEN icd_code ILIKE 'I50%' OR icd_code ILIKE '428%' THEN 'HEART_FAILURE'
                    WHEN icd_code ILIKE 'I20%' OR icd_code ILIKE '413%' THEN 'ANGINA'
                    WHEN icd_code ILIKE 'Z95%' THEN 'CARDIAC_DEVICE'
                    WHEN icd_code ILIKE 'I48%' THEN 'ATRIAL_FIBRILLATION'
                    WHEN icd_code ILIKE 'I42%' THEN 'CARDIOMYOPATHY' ELSE 'OTHER' END AS cardiac_category
        FROM raw_diagnoses {NEWEST.format(key='diagnosis_id')}""",
    "fact_medication": f"""
        SELECT medication_id, encounter_id, patient_id, ndc_code, medication_name, dosage, route, frequency, prescriber,
               start_date, end_date,
               CASE WHEN regexp_matches(lower(medication_name), 'metoprolol|atenolol|carvedilol') THEN 'BETA_BLOCKER'
                    WHEN regexp_matches(lower(medication_name), 'lisinopril|enalapril|ramipril') THEN 'ACE_INHIBITOR'
                    WHEN regexp_matches(lower(medication_name), 'warfarin|heparin|apixaban') THEN 'ANTICOAGULANT'
                    WHEN regexp_matches(lower(medication_name), 'amiodarone|sotalol') THEN 'ANTIARRHYTHMIC'
                    WHEN regexp_matches(lower(medication_name), 'atorvastatin|rosuvastatin') THEN 'STATIN'
                    WHEN regexp_matches(lower(medication_name), 'aspirin|clopidogrel') THEN 'ANTIPLATELET'
                    ELSE 'OTHER' END AS drug_class
        FROM raw_medications {NEWEST.format(key='medication_id')}""",
    "fact_lab_result": f"""
        SELECT lab_id, encounter_id, patient_id, loinc_code, test_name, result_numeric, unit, reference_low,
               reference_high, abnormal_flag,
               CASE WHEN result_numeric IS NOT NULL AND reference_low IS NOT NULL AND reference_high IS NOT NULL THEN
                 CASE WHEN result_numeric < reference_low THEN 'LOW' WHEN result_numeric > reference_high THEN 'HIGH'
                      ELSE 'NORMAL' END ELSE abnormal_flag END AS computed_flag,
               collected_at
        FROM raw_lab_results {NEWEST.format(key='lab_id')}""",
    "fact_rehab_referral": f"""
        SELECT referral_id, patient_id, referring_physician, qualifying_diagnosis, cardiac_event_date, lvef_percent,
               gxt_peak_hr, gxt_peak_mets, ischemic_threshold,
               upper(trim(aacvpr_risk_category)) AS aacvpr_risk_category,
               CASE WHEN lvef_percent >= 50 AND gxt_peak_mets >= 7 THEN 'LOW'
                    WHEN lvef_percent BETWEEN 40 AND 49 THEN 'MODERATE' WHEN lvef_percent < 40 THEN 'HIGH'
                    ELSE upper(trim(aacvpr_risk_category)) END AS computed_risk,
               referral_date, CAST(referral_date - cardiac_event_date AS BIGINT) AS days_event_to_referral
        FROM raw_rehab_referrals {NEWEST.format(key='referral_id')}""",
    "fact_rehab_session": f"""
        SELECT * EXCLUDE (record_id, load_timestamp),
               CASE WHEN target_hr_high > 0 AND resting_hr > 0 THEN
                 {r("(peak_hr - resting_hr)::DOUBLE / nullif(target_hr_high - resting_hr, 0) * 100", 1)} END
                 AS achieved_hrr_percent,
               CASE WHEN peak_hr > 0 AND recovery_hr > 0 THEN peak_hr - recovery_hr END AS hr_recovery_delta,
               CASE WHEN peak_bp_systolic > 250 OR peak_bp_diastolic > 115 THEN TRUE
                    WHEN peak_bp_systolic < resting_bp_systolic - 10 THEN TRUE
                    WHEN spo2_min < 88 THEN TRUE WHEN exercise_terminated_early THEN TRUE ELSE FALSE END AS safety_flag
        FROM raw_rehab_sessions {NEWEST.format(key='session_id')}""",
    "fact_rehab_outcome": f"""
        SELECT * EXCLUDE (record_id, load_timestamp),
               CASE WHEN phq9_score >= 20 THEN 'SEVERE' WHEN phq9_score >= 15 THEN 'MODERATELY_SEVERE'
                    WHEN phq9_score >= 10 THEN 'MODERATE' WHEN phq9_score >= 5 THEN 'MILD' ELSE 'MINIMAL' END
                 AS depression_severity
        FROM raw_rehab_outcomes {NEWEST.format(key='outcome_id')}""",
}
