"""Raw health tables in SQL, over the star tables."""

from __future__ import annotations

from checks.sqltext import pad, pick, values
from pulsemart.sources import lookups as L

LINE_ID = lambda prefix: f"{pad(prefix, 'ok')} || '-' || CAST(ln AS VARCHAR)"
LINE_LOAD = "CASE WHEN NOT ((ok + pk) % 200 = 0) THEN shipped END"

TABLES = {
    "lk_diagnoses": f"""
        SELECT *, row_number() OVER (ORDER BY dx_code) AS rn
        FROM ({values(L.DIAGNOSES, ['dx_code', 'dx_name', 'lookup_category'])})""",
    "lk_medications": f"""
        SELECT *, row_number() OVER (ORDER BY med_name) AS rn
        FROM ({values(L.MEDICATIONS, ['med_name', 'lookup_class'])})""",
    "lk_labs": f"""
        SELECT *, row_number() OVER (ORDER BY lookup_loinc) AS rn
        FROM ({values(L.LAB_TESTS, ['lookup_loinc', 'lookup_test', 'lookup_unit', 'ref_low', 'ref_high'])})""",
    "lines": """
        SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk,
               o_custkey AS ck, CAST(l_quantity AS BIGINT) AS qty,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CAST(round(l_discount * 100) AS BIGINT) AS disc,
               l_returnflag AS flag, l_shipdate AS shipped
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "raw_patients": f"""
        SELECT c_custkey * 2 + v - 1 AS record_id, {pad('PAT-', 'c_custkey')} AS patient_id,
               ' ' || lower({pick(L.FIRST_NAMES, 'c_custkey')}) || ' ' AS first_name,
               {pick(L.LAST_NAMES, 'c_custkey // 20')} || '  ' AS last_name,
               CASE WHEN c_custkey % 53 <> 0 THEN DATE '1921-01-01' + CAST((c_custkey * 37) % 21900 AS INTEGER) END
                 AS date_of_birth,
               CASE WHEN c_custkey % 41 <> 0 THEN {pick([' m', 'F '], 'c_custkey')} END AS gender,
               ' ' || r_name AS ethnicity,
               CASE WHEN c_custkey % 29 <> 0 THEN (c_custkey % 900 + 100)::VARCHAR || '-' ||
                 (c_custkey % 90 + 10)::VARCHAR || '-' || ((c_custkey * 7) % 9000 + 1000)::VARCHAR END AS ssn,
               (c_custkey % 9900 + 100 + v)::VARCHAR || ' ' || {pick(L.STREETS, 'c_custkey + v')} AS address,
               '(' || (c_custkey % 800 + 200)::VARCHAR || ') 555-' || ((c_custkey * 11) % 9000 + 1000)::VARCHAR AS phone,
               CASE WHEN c_custkey % 13 <> 0 THEN ' Patient' || c_custkey::VARCHAR || '@Email.COM ' END AS email,
               'INS-' || ((c_custkey * 3) % 90000 + 10000)::VARCHAR AS insurance_id,
               {pick(L.LANGUAGES, 'c_custkey')} AS primary_language,
               {pick(L.MARITAL, 'c_custkey + v')} AS marital_status,
               CASE WHEN NOT (c_custkey % 35 = 0 AND v = 1)
                 THEN TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 300 + (v - 1) * 90 AS INTEGER)) END
                 AS load_timestamp
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        CROSS JOIN (VALUES (1), (2)) AS versions(v)
        WHERE v = 1 OR c_custkey % 5 = 0""",
    "raw_encounters": f"""
        SELECT o_orderkey * 2 + v - 1 AS record_id, {pad('ENC-', 'o_orderkey')} AS encounter_id,
               CASE WHEN o_orderkey % 101 = 0 THEN {pad('PAT-X', 'o_custkey')} ELSE {pad('PAT-', 'o_custkey')} END
                 AS patient_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN ' Inpatient'
                 WHEN '3-MEDIUM' THEN 'INPATIENT ' WHEN '4-NOT SPECIFIED' THEN 'observation'
                 WHEN '5-LOW' THEN 'outpatient' END AS encounter_type,
               o_orderdate + to_hours(o_orderkey % 24) AS admit_date,
               CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24)
                 + to_hours((o_orderkey % 14) * 24 + o_orderkey % 20) END AS discharge_date,
               {pick(L.DEPARTMENTS, 'o_orderkey')} AS department,
               {pick(L.PROVIDERS, 'o_orderkey')} AS attending_provider,
               {pick(L.FACILITIES, 'o_orderkey')} AS facility_code,
               {pick(L.ADMIT_CODES, 'o_orderkey')} AS admit_diagnosis_code,
               CASE WHEN v = 2 THEN 'TRANSFERRED' WHEN o_orderkey % 20 = 0 THEN 'EXPIRED'
                 WHEN o_orderkey % 15 = 0 THEN 'TRANSFERRED' ELSE 'DISCHARGED_HOME' END AS discharge_status,
               o_orderdate + to_days(v) AS load_timestamp
        FROM orders CROSS JOIN (VALUES (1), (2)) AS versions(v)
        WHERE v = 1 OR o_orderkey % 9 = 0""",
    "raw_diagnoses": f"""
        SELECT pk * 1000003 + sk AS record_id, {LINE_ID('DX-')} AS diagnosis_id, {pad('PAT-', 'ck')} AS patient_id,
               {pad('ENC-', 'ok')} AS encounter_id,
               CASE WHEN sk % 11 = 0 THEN {pick(['410.1', '414.0', '428.0', '413.9'], 'sk')}
                    WHEN ok % 50 = 0 THEN ' ' || dx_code WHEN pk % 7 = 0 THEN lower(dx_code) ELSE dx_code END AS icd_code,
               CASE WHEN sk % 11 = 0 THEN '9' ELSE '10' END AS icd_version,
               CASE WHEN pk % 23 <> 0 THEN dx_name END AS description,
               {pick(L.DIAGNOSIS_TYPES, 'ln - 1')} AS diagnosis_type,
               CAST(shipped AS DATE) AS diagnosis_date, {LINE_LOAD} AS load_timestamp
        FROM lines JOIN lk_diagnoses ON rn = pk % 30 + 1""",
    "raw_medications": f"""
        SELECT pk * 1000003 + sk AS record_id, {LINE_ID('MED-')} AS medication_id, {pad('PAT-', 'ck')} AS patient_id,
               {pad('ENC-', 'ok')} AS encounter_id, lpad(pk::VARCHAR, 11, '0') AS ndc_code,
               CASE WHEN pk % 37 <> 0 THEN med_name END AS medication_name,
               nullif(regexp_extract(med_name, '[0-9]+[a-zA-Z]+'), '') AS dosage,
               {pick(L.ROUTES, 'pk')} AS route, {pick(L.FREQUENCIES, 'sk')} AS frequency,
               {pick(L.PROVIDERS, 'ok')} AS prescriber,
               CAST(shipped AS DATE) AS start_date, CAST(shipped AS DATE) + CAST(qty + 30 AS INTEGER) AS end_date,
               {LINE_LOAD} AS load_timestamp
        FROM lines JOIN lk_medications ON rn = (pk + sk) % 30 + 1""",
    "raw_lab_results": f"""
        SELECT event_id AS record_id, {pad('LAB-', 'event_id')} AS lab_id, {pad('PAT-', 'user_id')} AS patient_id,
               {pad('ENC-', 'event_id // 2')} AS encounter_id, lookup_loinc AS loinc_code,
               CASE WHEN lookup_test = 'Hemoglobin A1c' AND event_id % 4 = 0 THEN 'HbA1c (glycated)'
                    ELSE lookup_test END AS test_name,
               CASE WHEN event_id % 19 <> 0 THEN value END AS result_numeric, lookup_unit AS unit,
               CASE WHEN event_id % 11 <> 0 THEN ref_low END AS reference_low,
               CASE WHEN event_id % 11 <> 0 THEN ref_high END AS reference_high,
               CASE WHEN event_id % 2 = 0 THEN 'A' END AS abnormal_flag,
               ts AS collected_at, ts + INTERVAL 1 HOUR AS load_timestamp
        FROM events JOIN lk_labs ON rn = event_id % 30 + 1""",
    "raw_vital_signs": f"""
        SELECT {pad('VIT-', 'event_id')} AS vital_id, {pad('PAT-', 'user_id')} AS patient_id,
               {pad('ENC-', 'event_id // 2')} AS encounter_id,
               {pick([v[0] for v in L.VITALS], 'event_id')} AS vital_type, value AS value_numeric,
               {pick([v[1] for v in L.VITALS], 'event_id')} AS unit, ts AS measured_at,
               {pick(L.NURSES, 'event_id')} AS measured_by
        FROM events""",
    "raw_procedures": f"""
        SELECT {pad('PRC-', 'o_orderkey')} AS procedure_id, {pad('PAT-', 'o_custkey')} AS patient_id,
               {pad('ENC-', 'o_orderkey')} AS encounter_id, {pick(L.CPT_CODES, 'o_orderkey')} AS cpt_code,
               CAST(o_orderdate AS DATE) AS procedure_date, {pick(L.PROVIDERS, 'o_orderkey')} AS performing_provider
        FROM orders""",
    "referral_keys": f"""
        SELECT c_custkey AS k, part,
               {pad('REF-', 'c_custkey')} || CASE WHEN part = 2 THEN '-2' ELSE '' END AS referral_id
        FROM customer CROSS JOIN (VALUES (1), (2)) AS parts(part)
        WHERE c_custkey % 5 <> 3 AND (part = 1 OR c_custkey % 8 = 0)""",
    "raw_rehab_referrals": f"""
        SELECT k * 2 + part - 1 AS record_id, referral_id, {pad('PAT-', 'k')} AS patient_id,
               {pick(L.PROVIDERS, 'k')} AS referring_physician, {pick(L.QUALIFYING, 'k + part')} AS qualifying_diagnosis,
               CASE WHEN k % 31 <> 0 THEN DATE '1995-06-01' + CAST((k * 13) % 1800 + (part - 1) * 200 AS INTEGER) END
                 AS cardiac_event_date,
               CASE WHEN k % 37 <> 0 THEN ((k * 7) % 92) / 2.0::DOUBLE + 20 END AS lvef_percent,
               CAST(k % 91 + 80 AS INTEGER) AS gxt_peak_hr,
               CASE WHEN k % 59 <> 0 THEN ((k * 5) % 37) / 4.0::DOUBLE + 3 END AS gxt_peak_mets,
               {pick(['NONE', 'ST_DEPRESSION', 'ANGINA'], 'k')} AS ischemic_threshold,
               CASE WHEN k % 43 <> 0 THEN {pick([' low', 'Moderate ', 'HIGH'], 'k')} END AS aacvpr_risk_category,
               DATE '1995-06-01' + CAST((k * 13) % 1800 + (part - 1) * 200 + k % 29 + 2 AS INTEGER) AS referral_date,
               CAST(DATE '1995-06-01' + CAST((k * 13) % 1800 + (part - 1) * 200 + k % 29 + 3 AS INTEGER) AS TIMESTAMP)
                 AS load_timestamp
        FROM referral_keys""",
    "raw_rehab_sessions": f"""
        SELECT pk * 1000003 + sk AS record_id, {LINE_ID('SES-')} AS session_id,
               CASE WHEN ok % 25 <> 0 THEN {pad('REF-', 'ck')} ||
                 CASE WHEN ck % 8 = 0 AND ok % 2 = 1 THEN '-2' ELSE '' END END AS referral_id,
               {pad('PAT-', 'ck')} AS patient_id,
               CAST((ok * 7 + ln * 3) % 36 + 1 AS INTEGER) AS session_number, CAST(shipped AS DATE) AS session_date,
               {pick(L.MODALITIES, 'pk')} AS modality, CAST(pk % 36 + 20 AS INTEGER) AS duration_minutes,
               CAST(sk % 25 + 88 AS INTEGER) AS target_hr_low,
               CASE WHEN sk % 47 <> 0 THEN CAST(CASE WHEN sk % 43 = 1 THEN 0 ELSE sk % 31 + 118 END AS INTEGER) END
                 AS target_hr_high,
               CAST(pk % 31 + 58 AS INTEGER) AS resting_hr,
               CASE WHEN pk % 61 <> 0 THEN CAST((pk * 3 + ln) % 69 + 92 AS INTEGER) END AS peak_hr,
               CASE WHEN sk % 53 <> 0 THEN CAST(sk % 38 + 68 AS INTEGER) END AS recovery_hr,
               CAST(pk % 38 + 108 AS INTEGER) AS resting_bp_systolic,
               CAST(sk % 27 + 62 AS INTEGER) AS resting_bp_diastolic,
               CAST((pk * 7) % 90 + 110 AS INTEGER) AS peak_bp_systolic,
               CAST(sk % 52 + 65 AS INTEGER) AS peak_bp_diastolic,
               CAST(pk % 37 + 112 AS INTEGER) AS post_bp_systolic,
               CAST(sk % 27 + 62 AS INTEGER) AS post_bp_diastolic,
               CASE WHEN qty <> 50 THEN CAST(qty % 8 + 10 AS INTEGER) END AS rpe_peak,
               CASE WHEN pk % 71 <> 0 THEN (pk % 27) / 2.0::DOUBLE + 87 END AS spo2_min,
               {pick(L.RHYTHMS, 'pk')} AS ecg_rhythm, CAST(sk % 36 + 15 AS INTEGER) AS ecg_monitor_minutes,
               CASE WHEN pk % 17 = 0 THEN 'FATIGUE' END AS symptoms,
               CASE WHEN pk % 97 = 0 THEN 'DIZZINESS' END AS adverse_events,
               CASE WHEN (pk + sk) % 34 <> 1 THEN (pk + sk) % 33 = 0 END AS exercise_terminated_early,
               CASE WHEN (pk + sk) % 33 = 0 THEN 'SYMPTOMS' END AS termination_reason,
               {pick(L.THERAPISTS, 'sk')} AS therapist, {LINE_LOAD} AS load_timestamp
        FROM lines""",
    "raw_rehab_outcomes": f"""
        SELECT k * 2 + part - 1 AS record_id, 'OUT-' || kind || '-' || referral_id AS outcome_id, referral_id,
               {pad('PAT-', 'k')} AS patient_id, 'COMPREHENSIVE' AS measurement_type,
               CASE WHEN kind = 'D' THEN 'DISCHARGE' ELSE 'BASELINE' END AS measurement_point,
               DATE '1996-01-01' + CAST((k * 13) % 1800 + CASE WHEN kind = 'D' THEN 120 ELSE 0 END AS INTEGER)
                 AS measurement_date,
               CASE WHEN k % 23 <> 0 THEN CAST((k * 11) % 341 + 180 +
                 CASE kind WHEN 'D' THEN k % 60 - 10 WHEN 'B2' THEN 5 ELSE 0 END AS DOUBLE) END AS six_min_walk_meters,
               (k % 25) / 4.0::DOUBLE + 2.5 + CASE WHEN kind = 'D' THEN 1.25 ELSE 0 END::DOUBLE AS peak_mets,
               (k % 80) / 2.0::DOUBLE + 8 AS dasi_score,
               CASE WHEN k % 17 <> 0 THEN CAST(CASE WHEN kind = 'D' THEN (k * 2) % 21 ELSE (k * 3) % 25 END AS INTEGER)
                 END AS phq9_score,
               (k % 181) / 2.0::DOUBLE + 50 AS weight_kg,
               (k % 54) / 2.0::DOUBLE + 18.5 - CASE WHEN kind = 'D' THEN 0.5 ELSE 0 END::DOUBLE AS bmi,
               (k % 140) / 2.0::DOUBLE + 65 AS waist_cm,
               (k % 41) / 8.0::DOUBLE + 5 - CASE WHEN kind = 'D' THEN 0.25 ELSE 0 END::DOUBLE AS hba1c,
               CAST(k % 131 + 70 - CASE WHEN kind = 'D' THEN 15 ELSE 0 END AS DOUBLE) AS ldl,
               CAST(k % 51 + 25 AS DOUBLE) AS hdl, CAST(k % 161 + 140 AS DOUBLE) AS total_cholesterol,
               CAST(k % 281 + 70 AS DOUBLE) AS triglycerides,
               TIMESTAMP '2001-06-01' + to_days(CAST(k % 100 AS INTEGER)) AS load_timestamp
        FROM referral_keys CROSS JOIN (VALUES ('B'), ('B2'), ('D')) AS kinds(kind)
        WHERE kind = 'B' OR (kind = 'B2' AND k % 19 = 0) OR (kind = 'D' AND k % 7 <> 0)""",
    "claim_cents": """
        SELECT *, (cents * (100 - disc)) // 100 AS allowed_cents,
               CASE WHEN flag = 'R' THEN 0 ELSE (((cents * (100 - disc)) // 100) * 4) // 5 END AS paid_cents
        FROM lines""",
    "raw_claims": f"""
        SELECT {LINE_ID('CLM-')} AS claim_id, {pad('PAT-', 'ck')} AS patient_id, {pad('ENC-', 'ok')} AS encounter_id,
               {pad('PAY-', 'sk % 10', 3)} AS payer_id, {pick(L.PAYERS, 'sk')} AS payer_name,
               {pick(L.CLAIM_TYPES, 'ln')} AS claim_type,
               CASE WHEN ok % 211 <> 0 THEN CAST(shipped AS DATE) END AS service_date,
               {pick(L.CPT_CODES, 'pk')} AS cpt_code, {pick(L.DRG_CODES, 'pk')} AS drg_code,
               CAST(cents / 100.0 AS DECIMAL(12,2)) AS billed_amount,
               CASE WHEN pk % 83 <> 0 THEN CAST(allowed_cents / 100.0 AS DECIMAL(12,2)) END AS allowed_amount,
               CASE WHEN pk % 89 <> 0 THEN CAST(paid_cents / 100.0 AS DECIMAL(12,2)) END AS paid_amount,
               CAST((allowed_cents - paid_cents) / 100.0 AS DECIMAL(12,2)) AS patient_responsibility,
               CASE WHEN flag = 'R' THEN 'DENIED' WHEN flag = 'A' AND ln = 1 THEN 'PENDING' ELSE 'PAID' END
                 AS claim_status,
               CASE WHEN pk % 5 <> 0 THEN {pick(L.DENIAL_REASONS, 'pk')} END AS denial_reason,
               shipped AS load_timestamp
        FROM claim_cents""",
    "raw_clinical_notes": f"""
        SELECT {pad('NOTE-', 'doc_id')} AS note_id, {pad('PAT-', 'doc_id * 3 // 2')} AS patient_id,
               {pad('ENC-', 'doc_id * 5')} AS encounter_id, {pick(L.NOTE_TYPES, 'doc_id')} AS note_type,
               text || chr(10) || {pick(L.NOTE_TEXTS, 'doc_id')} AS note_text,
               {pick(L.AUTHORS, 'doc_id')} AS author,
               TIMESTAMP '2001-01-01' + to_minutes((doc_id * 37) % 500000) AS authored_at
        FROM documents""",
    "care_team_assignments": f"""
        SELECT c_custkey AS assignment_id, {pad('PAT-', 'c_custkey')} AS patient_id,
               {pick(['TEAM-CARDIO', 'TEAM-ORTHO', 'TEAM-REHAB'], 'c_custkey')} AS care_team_id,
               'CLINICIAN_' || (c_custkey % 12)::VARCHAR AS clinician_user,
               {pick(['LEAD', 'NURSE', 'THERAPIST'], 'c_custkey // 3')} AS role_in_team,
               DATE '1998-01-01' + CAST((c_custkey * 17) % 1200 AS INTEGER) AS assigned_date,
               CASE WHEN c_custkey % 4 <> 0 THEN DATE '1998-01-01' +
                 CAST((c_custkey * 17) % 1200 + (c_custkey * 23) % 1500 AS INTEGER) END AS end_date
        FROM customer""",
}
