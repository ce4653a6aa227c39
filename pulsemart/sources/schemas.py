"""Declared schemas of the health tables (fixed values), as DDL text per table."""

from __future__ import annotations

from pyspark.sql import types as T

DDL = {
    "raw_patients": (
        "record_id long, patient_id string, first_name string, last_name string, date_of_birth date, gender "
        "string, ethnicity string, ssn string, address string, phone string, email string, insurance_id "
        "string, primary_language string, marital_status string, source_system string, source_file string, "
        "load_timestamp timestamp_ntz"
    ),
    "raw_encounters": (
        "record_id long, raw_data string, encounter_id string, patient_id string, encounter_type string, "
        "admit_date timestamp_ntz, discharge_date timestamp_ntz, department string, attending_provider "
        "string, facility_code string, admit_diagnosis_code string, discharge_status string, source_system "
        "string, load_timestamp timestamp_ntz"
    ),
    "raw_diagnoses": (
        "record_id long, raw_data string, diagnosis_id string, patient_id string, encounter_id string, "
        "icd_code string, icd_version string, description string, diagnosis_type string, diagnosis_date date, "
        "source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_medications": (
        "record_id long, raw_data string, medication_id string, patient_id string, encounter_id string, "
        "ndc_code string, medication_name string, dosage string, route string, frequency string, prescriber "
        "string, start_date date, end_date date, source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_procedures": (
        "record_id long, raw_data string, procedure_id string, patient_id string, encounter_id string, "
        "cpt_code string, icd_proc_code string, description string, procedure_date date, performing_provider "
        "string, source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_lab_results": (
        "record_id long, raw_data string, lab_id string, patient_id string, encounter_id string, loinc_code "
        "string, test_name string, result_value string, result_numeric double, unit string, reference_low "
        "double, reference_high double, abnormal_flag string, collected_at timestamp_ntz, source_system "
        "string, load_timestamp timestamp_ntz"
    ),
    "raw_vital_signs": (
        "record_id long, raw_data string, vital_id string, patient_id string, encounter_id string, vital_type "
        "string, value_numeric double, unit string, measured_at timestamp_ntz, measured_by string, "
        "source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_rehab_referrals": (
        "record_id long, raw_data string, referral_id string, patient_id string, referring_physician string, "
        "qualifying_diagnosis string, cardiac_event_date date, lvef_percent double, gxt_peak_hr int, "
        "gxt_peak_mets double, ischemic_threshold string, aacvpr_risk_category string, referral_date date, "
        "source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_rehab_sessions": (
        "record_id long, raw_data string, session_id string, referral_id string, patient_id string, "
        "session_number int, session_date date, modality string, duration_minutes int, target_hr_low int, "
        "target_hr_high int, resting_hr int, peak_hr int, recovery_hr int, resting_bp_systolic int, "
        "resting_bp_diastolic int, peak_bp_systolic int, peak_bp_diastolic int, post_bp_systolic int, "
        "post_bp_diastolic int, rpe_peak int, spo2_min double, ecg_rhythm string, ecg_monitor_minutes int, "
        "symptoms string, adverse_events string, exercise_terminated_early boolean, termination_reason "
        "string, therapist string, source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_rehab_outcomes": (
        "record_id long, raw_data string, outcome_id string, referral_id string, patient_id string, "
        "measurement_type string, measurement_point string, measurement_date date, six_min_walk_meters "
        "double, peak_mets double, dasi_score double, phq9_score int, weight_kg double, bmi double, waist_cm "
        "double, hba1c double, ldl double, hdl double, total_cholesterol double, triglycerides double, "
        "source_system string, load_timestamp timestamp_ntz"
    ),
    "raw_claims": (
        "record_id long, raw_data string, claim_id string, patient_id string, encounter_id string, payer_id "
        "string, payer_name string, claim_type string, service_date date, cpt_code string, drg_code string, "
        "billed_amount decimal(12,2), allowed_amount decimal(12,2), paid_amount decimal(12,2), "
        "patient_responsibility decimal(12,2), claim_status string, denial_reason string, source_system "
        "string, load_timestamp timestamp_ntz"
    ),
    "dim_patient": (
        "patient_key long, patient_id string not null, first_name string, last_name string, date_of_birth "
        "date, age long, gender string, ethnicity string, ssn string, address string, phone string, email "
        "string, insurance_id string, primary_language string, marital_status string, is_active boolean, "
        "effective_from timestamp_ntz, effective_to timestamp_ntz, is_current boolean"
    ),
    "care_team_assignments": (
        "assignment_id long, patient_id string, care_team_id string, clinician_user string, role_in_team "
        "string, assigned_date date, end_date date"
    ),
    "fact_encounter": (
        "encounter_key long, encounter_id string not null, patient_id string not null, encounter_type string, "
        "admit_date timestamp_ntz, discharge_date timestamp_ntz, length_of_stay_days long, department string, "
        "attending_provider string, facility_code string, admit_diagnosis_code string, discharge_status "
        "string, load_timestamp timestamp_ntz"
    ),
    "fact_diagnosis": (
        "diagnosis_key long, diagnosis_id string not null, encounter_id string, patient_id string not null, "
        "icd_code string, icd_version string, description string, diagnosis_type string, diagnosis_date date, "
        "cardiac_category string, load_timestamp timestamp_ntz"
    ),
    "fact_medication": (
        "medication_key long, medication_id string not null, encounter_id string, patient_id string not null, "
        "ndc_code string, medication_name string, dosage string, route string, frequency string, prescriber "
        "string, start_date date, end_date date, drug_class string, load_timestamp timestamp_ntz"
    ),
    "fact_rehab_referral": (
        "referral_key long, referral_id string not null, patient_id string not null, referring_physician "
        "string, qualifying_diagnosis string, cardiac_event_date date, lvef_percent double, gxt_peak_hr int, "
        "gxt_peak_mets double, ischemic_threshold string, aacvpr_risk_category string, computed_risk string, "
        "referral_date date, days_event_to_referral long, load_timestamp timestamp_ntz"
    ),
    "fact_rehab_session": (
        "session_key long, session_id string not null, referral_id string, patient_id string not null, "
        "session_number int, session_date date, modality string, duration_minutes int, target_hr_low int, "
        "target_hr_high int, resting_hr int, peak_hr int, recovery_hr int, resting_bp_systolic int, "
        "resting_bp_diastolic int, peak_bp_systolic int, peak_bp_diastolic int, post_bp_systolic int, "
        "post_bp_diastolic int, rpe_peak int, spo2_min double, ecg_rhythm string, ecg_monitor_minutes int, "
        "symptoms string, adverse_events string, exercise_terminated_early boolean, termination_reason "
        "string, therapist string, achieved_hrr_percent double, hr_recovery_delta int, safety_flag boolean, "
        "load_timestamp timestamp_ntz"
    ),
    "fact_rehab_outcome": (
        "outcome_key long, outcome_id string not null, referral_id string, patient_id string not null, "
        "measurement_type string, measurement_point string, measurement_date date, six_min_walk_meters "
        "double, peak_mets double, dasi_score double, phq9_score int, weight_kg double, bmi double, waist_cm "
        "double, hba1c double, ldl double, hdl double, total_cholesterol double, triglycerides double, "
        "depression_severity string, load_timestamp timestamp_ntz"
    ),
    "fact_lab_result": (
        "lab_key long, lab_id string not null, encounter_id string, patient_id string not null, loinc_code "
        "string, test_name string, result_value string, result_numeric double, unit string, reference_low "
        "double, reference_high double, abnormal_flag string, computed_flag string, collected_at "
        "timestamp_ntz, load_timestamp timestamp_ntz"
    ),
    "fact_patient_clinical_features": (
        "feature_id long, patient_id string not null, age long, gender string, ethnicity string, "
        "total_diagnoses long, unique_icd_codes long, has_mi boolean, has_heart_failure boolean, "
        "has_atrial_fib boolean, total_medications long, on_beta_blocker boolean, on_ace_inhibitor boolean, "
        "on_anticoagulant boolean, on_statin boolean, distinct_drug_classes long, total_encounters long, "
        "inpatient_visits long, avg_length_of_stay double, max_length_of_stay long, latest_hba1c double, "
        "latest_ldl double, latest_hdl double, latest_total_cholesterol double, abnormal_lab_ratio double, "
        "created_at timestamp_ntz"
    ),
    "fact_cardiac_rehab_features": (
        "feature_id long, patient_id string not null, referral_id string, session_id string, session_number "
        "int, risk_category string, lvef_percent double, gxt_peak_mets double, resting_hr int, peak_hr int, "
        "recovery_hr int, hr_recovery_delta int, achieved_hrr_percent double, resting_bp_systolic int, "
        "peak_bp_systolic int, rpe_peak int, spo2_min double, duration_minutes int, ecg_monitor_minutes int, "
        "safety_flag boolean, exercise_terminated_early boolean, rolling_3_avg_peak_hr double, "
        "rolling_3_avg_rpe double, rolling_3_avg_duration double, peak_hr_delta double, rpe_delta double, "
        "duration_delta double, created_at timestamp_ntz"
    ),
    "ds_mortality_prediction": (
        "record_id long, patient_id string, age long, gender string, total_diagnoses long, unique_icd_codes "
        "long, has_mi boolean, has_heart_failure boolean, total_medications long, on_beta_blocker boolean, "
        "on_statin boolean, distinct_drug_classes long, inpatient_visits long, avg_length_of_stay double, "
        "latest_hba1c double, abnormal_lab_ratio double, label_mortality long, dataset_version string, "
        "created_at timestamp_ntz"
    ),
    "ds_cardiac_adverse_event": (
        "record_id long, patient_id string, session_id string, session_number int, risk_category string, "
        "lvef_percent double, resting_hr int, peak_hr int, rpe_peak int, spo2_min double, duration_minutes "
        "int, rolling_3_avg_peak_hr double, peak_hr_delta double, label_adverse_event long, dataset_version "
        "string, created_at timestamp_ntz"
    ),
    "fact_predictions": (
        "prediction_id long, model_name string, model_version string, prediction_date date, patient_id "
        "string, predicted_risk decimal(10,6), predicted_class long, confidence_score decimal(8,6), "
        "actual_outcome long, is_correct boolean, created_at timestamp_ntz"
    ),
    "model_catalog": (
        "model_id string, model_name string, model_version string, model_type string, task string, "
        "target_platform string, training_dataset string, feature_columns string, hyperparameters string, "
        "metrics string, description string, created_by string, created_at timestamp_ntz, status string"
    ),
    "raw_clinical_notes": (
        "note_id string, patient_id string, encounter_id string, note_type string, note_text string, author "
        "string, authored_at timestamp_ntz, source_system string, load_timestamp timestamp_ntz"
    ),
    "diagnosis_code_embeddings": (
        "icd_code string, icd_version string, description string, embedding array<float>, model_used string, "
        "created_at timestamp_ntz"
    ),
    "medication_embeddings": (
        "ndc_code string, medication_name string, drug_class string, embedding array<float>, model_used "
        "string, created_at timestamp_ntz"
    ),
    "clinical_note_embeddings": (
        "note_id string, patient_id string, encounter_id string, note_type string, note_text string, "
        "embedding array<float>, model_used string, created_at timestamp_ntz"
    ),
}


def schema(table: str) -> T.StructType:
    """The declared columns of a table. Semi-structured columns are JSON text."""
    return T.StructType.fromDDL(DDL[table])
