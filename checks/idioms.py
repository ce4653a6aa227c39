"""Expected results of the one-idiom queries."""

from __future__ import annotations

from checks import clinical, learning, platform
from checks.control import CONTACT, RATED, SEEN, mix, u
from checks.platform import ago, stamp
from checks.silver import AGE_GROUP
from checks.sqltext import CLINICAL_DAY, LOG_DAY, exact, key, pick, printed, r, weeks
from pulsemart.catalog.idioms import KEY_COLUMNS, PATIENT, READER

SILVER = ["dim_patient", "fact_encounter", "fact_diagnosis", "fact_medication", "fact_lab_result",
          "fact_rehab_referral", "fact_rehab_session", "fact_rehab_outcome"]
# The key clinical columns each table has.
HAS = {
    "dim_patient": ["patient_id", "ssn", "date_of_birth"],
    "fact_encounter": ["patient_id"],
    "fact_diagnosis": ["patient_id", "cardiac_category"],
    "fact_medication": ["patient_id", "drug_class"],
    "fact_lab_result": ["patient_id"],
    "fact_rehab_referral": ["patient_id", "lvef_percent", "gxt_peak_mets"],
    "fact_rehab_session": ["patient_id", "peak_hr", "resting_hr", "rpe_peak", "safety_flag", "achieved_hrr_percent"],
    "fact_rehab_outcome": ["patient_id", "six_min_walk_meters", "phq9_score"],
}
# Their types, where not text.
TYPES = {
    "date_of_birth": "date", "lvef_percent": "double", "gxt_peak_mets": "double", "peak_hr": "int", "resting_hr": "int",
    "rpe_peak": "int", "safety_flag": "boolean", "achieved_hrr_percent": "double", "six_min_walk_meters": "double",
    "phq9_score": "int",
}
assert {x for xs in HAS.values() for x in xs} == set(KEY_COLUMNS)


def n(keys: str, source: str) -> str:
    return f"SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL"


def money(c: str) -> str:
    return exact(f"sum({c})")


def text(c: str, alias: str | None = None) -> str:
    return f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {alias or c}"


DAYS = "CAST(CAST(discharge_date AS DATE) - CAST(admit_date AS DATE) AS BIGINT)"
GROWTH = "(SELECT usage_date, storage_bytes, lag(storage_bytes) OVER (ORDER BY usage_date) AS before FROM storage_usage)"
MEASURED = "row_number() OVER (PARTITION BY diagnosis_id ORDER BY load_timestamp DESC NULLS FIRST, record_id DESC)"

SQL = {
    "s1_typed_scan": """
        SELECT medication_id, medication_name, CAST(start_date AS VARCHAR) AS start_date FROM raw_medications
        WHERE raw_medications.start_date >= DATE '2000-01-01'""",
    "s2_ctas_overwrite": n("encounter_type", "fact_encounter"),
    "s3_insert_select_defaults": f"""
        SELECT referral_id, computed_risk, CASE WHEN computed_risk = 'HIGH' THEN ischemic_threshold END
                 AS ischemic_threshold,
               CASE WHEN computed_risk IS DISTINCT FROM 'HIGH' THEN strftime({CLINICAL_DAY}, '%Y-%m-%d %H:%M:%S.%f') END AS load_timestamp,
               {key('referral_id')} AS referral_key
        FROM fact_rehab_referral""",
    "s4_full_refresh": n("measurement_point", "fact_rehab_outcome"),
    "s5_named_view": f"""
        SELECT payer_name, count(*) AS n, CAST(sum(denials) AS BIGINT) AS denials
        FROM ({clinical.SQL['m6_claims_summary']}) GROUP BY 1""",
    "s6_values_lookup": n("dx_code, dx_name, lookup_category",
                          "fact_diagnosis JOIN lk_diagnoses ON upper(icd_code) = dx_code"),
    "s7_row_generator": f"SELECT c_custkey AS id, {u('c_custkey', 1, 16000, 32000)} AS days FROM customer",
    "s8_key_registry": """
        WITH loads AS (SELECT patient_id, CASE WHEN CAST(right(patient_id, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE 2 END AS load
                       FROM dim_patient)
        SELECT patient_id, row_number() OVER (ORDER BY load, patient_id) AS patient_key FROM loads""",
    "s8_surrogate_keys": f"SELECT {key('encounter_id')} AS encounter_key, encounter_id FROM fact_encounter",
    "s9_versioned_snapshot": n(f"'V1' AS dataset_version, {printed(CLINICAL_DAY)} AS created_at, computed_risk", "fact_rehab_referral"),
    "s10_log_scan": f"""
        SELECT query_id, warehouse_name, {stamp('start_time')} FROM query_history
        WHERE {ago('query_history.start_time', 30, 'DAY')} AND warehouse_name LIKE 'HEALTH_%'""",
    "s11_register_models": f"""
        SELECT model_id, 'ACTIVE' AS status, strftime({CLINICAL_DAY}, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
               CASE WHEN model_id = 'MDL-003' THEN (SELECT count(*) FROM fact_medication) END AS training_rows
        FROM (VALUES ('MDL-001'), ('MDL-002'), ('MDL-003'), ('MDL-004')) AS m(model_id)""",
    "s12_table_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in SILVER),
    "s13_column_inventory": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{x}' AS column_name, count({x}) AS filled_rows,
            'Key Clinical Column' AS column_type, '{TYPES.get(x, "string")}' AS data_type FROM {t}"""
        for t, xs in HAS.items() for x in xs),
    "e1_projection_rename_literal": "SELECT encounter_id, department AS unit, 'EPIC' AS source FROM fact_encounter",
    "e2_ordered_case": """
        SELECT record_id, icd_code, CASE WHEN regexp_matches(upper(icd_code), '^(I21|410)') THEN 'ACUTE_MI'
               WHEN regexp_matches(upper(icd_code), '^(I25|414)') THEN 'CHRONIC_IHD'
               WHEN regexp_matches(upper(icd_code), '^(I50|428)') THEN 'HEART_FAILURE'
               WHEN regexp_matches(upper(icd_code), '^(I20|413)') THEN 'ANGINA'
               WHEN regexp_matches(upper(icd_code), '^Z95') THEN 'CARDIAC_DEVICE'
               WHEN regexp_matches(upper(icd_code), '^I48') THEN 'ATRIAL_FIBRILLATION'
               WHEN regexp_matches(upper(icd_code), '^I42') THEN 'CARDIOMYOPATHY' ELSE 'OTHER' END AS category
        FROM raw_diagnoses""",
    "e3_nested_case": """
        SELECT lab_id, CASE WHEN result_numeric IS NULL OR reference_low IS NULL OR reference_high IS NULL
                 THEN abnormal_flag WHEN result_numeric < reference_low THEN 'LOW'
                 WHEN result_numeric > reference_high THEN 'HIGH' ELSE 'NORMAL' END AS flag FROM raw_lab_results""",
    "e4_range_bands": f"SELECT patient_id, {AGE_GROUP} AS age_group FROM dim_patient",
    "e5_round_robin": f"SELECT record_id, {pick(['RED', 'GREEN', 'BLUE'], 'record_id')} AS team FROM raw_encounters",
    "e6_ilike": """
        SELECT medication_id, medication_name FROM fact_medication
        WHERE lower(medication_name) LIKE 'metoprolol%' OR contains(lower(medication_name), 'statin')""",
    "e7_like_and_not_like": n("database_name, query_type",
                              "query_history WHERE starts_with(database_name, 'HEALTH_A') AND NOT query_type LIKE 'CREATE%'"),
    "e8_in_and_not_in": n("payer_name, denial_reason", """raw_claims WHERE payer_name IN ('Medicare', 'Aetna')
                          AND denial_reason NOT IN ('CODING_ERROR', 'TIMELY_FILING')"""),
    "e9_in_subquery": """
        SELECT patient_id, gender FROM dim_patient WHERE patient_id IN (SELECT patient_id FROM fact_rehab_referral)""",
    "e10_correlated_exists": f"""
        SELECT patient_id FROM dim_patient p WHERE EXISTS (SELECT 1 FROM care_team_assignments a
          WHERE a.patient_id = p.patient_id AND a.care_team_id IN
            (SELECT care_team_id FROM care_team_assignments WHERE clinician_user = '{READER}'))""",
    "e11_exists_flag": """
        SELECT EXISTS (SELECT 1 FROM fact_rehab_session WHERE spo2_min < 87.5) AS low_oxygen_seen,
               EXISTS (SELECT 1 FROM fact_rehab_session WHERE peak_hr > 220) AS extreme_rate_seen""",
    "e12_between": """
        SELECT referral_id, lvef_percent FROM fact_rehab_referral WHERE lvef_percent >= 40 AND lvef_percent <= 49""",
    "e13_null_guards": """
        SELECT session_id, recovery_hr FROM fact_rehab_session WHERE peak_hr IS NULL AND recovery_hr IS NOT NULL""",
    "e14_coalesce_defaults": f"""
        SELECT p.patient_id, coalesce(l.abnormal_lab_ratio, 0.0::DOUBLE) AS abnormal_lab_ratio
        FROM dim_patient p LEFT JOIN ({learning.LAB}) l ON p.patient_id = l.patient_id""",
    "e15_nullif_guard": """
        SELECT query_id, partitions_scanned::DOUBLE / nullif(partitions_total, 0) AS scanned_share FROM query_history""",
    "e16_boolean_predicate": """
        SELECT session_id, safety_flag, exercise_terminated_early FROM fact_rehab_session
        WHERE safety_flag OR exercise_terminated_early""",
    "e17_casts": f"""
        SELECT encounter_id, length_of_stay_days::DOUBLE AS stay, {text('admit_date', 'day')},
               length_of_stay_days::VARCHAR AS stay_text FROM fact_encounter""",
    "e18_bound_parameters": f"""
        SELECT session_id, session_number, modality FROM fact_rehab_session
        WHERE patient_id = '{PATIENT}' AND session_number <= 20""",
    "e19_scalar_projection": """
        SELECT encounter_type, count(*) AS n, (SELECT count(*) FROM fact_encounter) AS all_encounters
        FROM fact_encounter GROUP BY 1""",
    "e20_scalar_filter": f"""
        SELECT session_id, {text('session_date')} FROM fact_rehab_session
        WHERE fact_rehab_session.session_date = (SELECT max(s.session_date) FROM fact_rehab_session s)""",
    "e21_common_tables": """
        WITH busy AS (SELECT patient_id, count(*) AS n FROM fact_encounter GROUP BY 1 HAVING count(*) >= 10),
        oldest AS (SELECT patient_id, age FROM dim_patient WHERE age >= 65)
        SELECT busy.patient_id, n, age FROM busy JOIN oldest ON busy.patient_id = oldest.patient_id""",
    "e22_all_plus_derived": f"""
        SELECT * REPLACE (strftime(measured_at, '%Y-%m-%d %H:%M:%S.%f') AS measured_at), 'BEDSIDE_MONITOR' AS source_system,
               vital_type = 'PAIN_SCALE' AS is_pain FROM raw_vital_signs""",
    "e23_quoted_names": """
        SELECT "Encounter Id" AS id, "unit name" AS unit
        FROM (SELECT encounter_id AS "Encounter Id", department AS "unit name" FROM fact_encounter)""",
    "j1_inner": n("gender, encounter_type", "fact_encounter e JOIN dim_patient p ON e.patient_id = p.patient_id"),
    "j2_left_fan_out": """
        SELECT f.referral_id, count(*) AS joined_rows, count(s.session_id) AS sessions FROM fact_rehab_referral f
        LEFT JOIN fact_rehab_session s ON f.referral_id = s.referral_id GROUP BY 1""",
    "j3_left_pre_aggregated": """
        SELECT f.referral_id, total_sessions FROM fact_rehab_referral f LEFT JOIN
          (SELECT referral_id, count(*) AS total_sessions FROM fact_rehab_session GROUP BY 1) s
        ON f.referral_id = s.referral_id""",
    "j4_self_join_roles": f"""
        SELECT b.referral_id, b.six_min_walk_meters AS baseline_6mwt, d.six_min_walk_meters AS discharge_6mwt
        FROM {clinical.PAIRS}""",
    "j5_unordered_pairs": """
        SELECT d1.cardiac_category AS condition_1, d2.cardiac_category AS condition_2,
               count(DISTINCT d1.patient_id) AS co_occurrence
        FROM (SELECT DISTINCT patient_id, cardiac_category FROM fact_diagnosis) d1
        JOIN (SELECT DISTINCT patient_id, cardiac_category FROM fact_diagnosis) d2
          ON d1.patient_id = d2.patient_id AND d1.cardiac_category < d2.cardiac_category GROUP BY 1, 2""",
    "j6_predicate_in_on": """
        SELECT e.encounter_id, d.icd_code FROM fact_encounter e LEFT JOIN fact_diagnosis d
          ON e.encounter_id = d.encounter_id AND d.diagnosis_type = 'PRIMARY'""",
    "j7_star": f"""
        SELECT e.encounter_type, r.computed_risk AS rehab_risk_category, count(*) AS n FROM {clinical.SUMMARY}
        GROUP BY 1, 2""",
    "j8_composite_key": n("masking_policy_name, protection_level",
                          f"({platform.SQL['a6_masking_policy_usage']})"),
    "j9_left_then_not_null": n("phi_classification", f"({platform.SQL['a4_phi_data_access']})"),
    "j10_anti": """
        SELECT session_id, referral_id FROM fact_rehab_session s WHERE referral_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM fact_rehab_referral f WHERE f.referral_id = s.referral_id)""",
    "j11_semi": """
        SELECT encounter_id FROM fact_encounter WHERE patient_id IN (SELECT patient_id FROM fact_rehab_referral)""",
    "j12_six_way_left": """
        SELECT q.user_name, q.n AS statements, coalesce(a.n, 0) AS logins, coalesce(b.n, 0) AS sessions,
               coalesce(c.n, 0) AS roles_granted, coalesce(d.n, 0) AS grants_made
        FROM (SELECT user_name, count(*) AS n FROM query_history GROUP BY 1) q
        LEFT JOIN (SELECT user_name, count(*) AS n FROM login_history GROUP BY 1) a ON a.user_name = q.user_name
        LEFT JOIN (SELECT user_name, count(*) AS n FROM platform_sessions GROUP BY 1) b ON b.user_name = q.user_name
        LEFT JOIN (SELECT grantee_name, count(*) AS n FROM grants_to_users GROUP BY 1) c ON c.grantee_name = q.user_name
        LEFT JOIN (SELECT granted_by, count(*) AS n FROM grants_to_roles GROUP BY 1) d ON d.granted_by = q.user_name""",
    "j13_cyclic_pick": "SELECT o_orderkey, med_name FROM orders JOIN lk_medications ON rn = o_orderkey % 30 + 1",
    "j14_replicate_rows": """
        SELECT referral_id, copy FROM fact_rehab_referral CROSS JOIN (VALUES (1), (2), (3)) AS k(copy)""",
    "g1_group_by_expression": n("CAST(year(admit_date) AS INTEGER) AS admit_year, department", "fact_encounter"),
    "g2_count_rows_and_values": """
        SELECT measurement_point, count(*) AS rows, count(phq9_score) AS scored FROM fact_rehab_outcome GROUP BY 1""",
    "g3_count_distinct": "SELECT icd_version, count(DISTINCT patient_id) AS patients FROM fact_diagnosis GROUP BY 1",
    "g4_filtered_distinct": """
        SELECT diagnosis_type, count(DISTINCT patient_id) FILTER (cardiac_category = 'HEART_FAILURE') AS hf_patients
        FROM fact_diagnosis GROUP BY 1""",
    "g5_several_distincts": """
        SELECT route, count(DISTINCT patient_id) AS patients, count(DISTINCT drug_class) AS classes,
               count(DISTINCT prescriber) AS prescribers FROM fact_medication GROUP BY 1""",
    "g6_sum_avg_min_max": f"""
        SELECT payer_name, {money('billed_amount')} AS billed, {exact('min(paid_amount)')} AS least,
               {exact('max(paid_amount)')} AS most FROM raw_claims GROUP BY 1""",
    "g7_conditional_sum": """
        SELECT therapist, count(*) FILTER (safety_flag) AS flagged FROM fact_rehab_session GROUP BY 1""",
    "g8_conditional_count": """
        SELECT count(*) - count(ssn) AS null_ssn, count(*) - count(email) AS null_email FROM dim_patient""",
    "g9_boolean_any": """
        SELECT patient_id, max(CASE WHEN cardiac_category = 'ACUTE_MI' THEN 1 ELSE 0 END) = 1 AS has_mi
        FROM fact_diagnosis GROUP BY 1""",
    "g10_conditional_pivot": """
        SELECT patient_id, max(result_numeric) FILTER (test_name ILIKE '%ldl%') AS latest_ldl,
               max(result_numeric) FILTER (test_name ILIKE '%hdl%') AS latest_hdl FROM fact_lab_result GROUP BY 1""",
    "g11_rate": f"""
        SELECT department, {r("avg(CASE WHEN discharge_status = 'EXPIRED' THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)}
                 AS mortality_pct FROM fact_encounter GROUP BY 1""",
    "g12_guarded_ratio": f"SELECT claim_type, {clinical.COLLECTED} AS collection_pct FROM raw_claims GROUP BY 1",
    "g13_sum_of_expression": f"""
        SELECT payer_name, {money('billed_amount - paid_amount')} AS write_off FROM raw_claims GROUP BY 1""",
    "g14_having": "SELECT icd_code, count(*) AS n FROM fact_diagnosis GROUP BY 1 HAVING count(*) > 1000",
    "g15_having_without_groups": "SELECT count(*) AS n FROM fact_encounter HAVING count(*) > 100",
    "g16_global_aggregate": f"""
        SELECT count(*) AS claims, {money('billed_amount')} AS billed, CAST(max(service_date) AS VARCHAR) AS latest
        FROM raw_claims""",
    "g17_share_of_total": f"""
        SELECT cardiac_category, {r("count(DISTINCT patient_id) * 100.0::DOUBLE / (SELECT count(*) FROM dim_patient)", 1)}
                 AS prevalence_pct FROM fact_diagnosis GROUP BY 1""",
    "g18_distinct_rows": "SELECT medication_name, drug_class FROM fact_medication GROUP BY 1, 2",
    "g19_group_by_month": n(text("date_trunc('month', diagnosis_date)", "month"), "fact_diagnosis"),
    "g20_active_days": f"SELECT warehouse_name, usage_month, active_days FROM ({platform.COST})",
    "g21_aggregate_of_aggregate": f"""
        SELECT age_group, CAST(sum(patient_count) AS BIGINT) AS patients, max(avg_lvef) AS best_lvef
        FROM ({clinical.COHORT}) GROUP BY 1""",
    "w1_latest_row": f"SELECT diagnosis_id, record_id FROM raw_diagnoses QUALIFY {MEASURED} = 1",
    "w2_latest_encounter": """
        SELECT patient_id, encounter_id, discharge_status FROM fact_encounter QUALIFY row_number() OVER
          (PARTITION BY patient_id ORDER BY admit_date DESC NULLS FIRST, encounter_id DESC) = 1""",
    "w3_rolling_mean": """
        SELECT patient_id, session_number, session_id, peak_hr, avg(peak_hr) OVER (PARTITION BY patient_id
          ORDER BY session_number, session_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mean_peak_hr
        FROM fact_rehab_session""",
    "w4_change_to_previous": """
        SELECT encounter_id, length_of_stay_days - lag(length_of_stay_days) OVER (PARTITION BY patient_id
          ORDER BY admit_date, encounter_id) AS stay_change FROM fact_encounter""",
    "w5_daily_growth": f"""
        SELECT CAST(usage_date AS VARCHAR) AS usage_date, storage_bytes FROM {GROWTH}
        WHERE before > 0 AND (storage_bytes - before)::DOUBLE / before > 0.1""",
    "w6_share_of_group": f"""
        SELECT route, drug_class, count(*) AS n,
               {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY route)', 2)} AS share
        FROM fact_medication GROUP BY 1, 2""",
    "w7_share_of_total": f"""
        SELECT department, count(*) AS count, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 2)} AS percentage
        FROM fact_encounter GROUP BY 1""",
    "w8_indexed_lookup": """
        SELECT dx_code, CAST(rn AS INTEGER) AS rn, count(*) AS n FROM fact_diagnosis JOIN lk_diagnoses
          ON upper(icd_code) = dx_code GROUP BY 1, 2""",
    "k1_mixed_order": f"SELECT referral_id, {text('referral_date')} FROM fact_rehab_referral",
    "k2_top_k": "SELECT icd_code, count(*) AS n FROM fact_diagnosis GROUP BY 1 ORDER BY n DESC, icd_code LIMIT 10",
    "k3_nulls_last": """
        SELECT outcome_id, phq9_score FROM fact_rehab_outcome ORDER BY phq9_score DESC NULLS LAST, outcome_id""",
    "k5_scattered_sample": """
        SELECT c_custkey, c_name FROM customer
        ORDER BY ((c_custkey % 2147483648) * 2654435761) % 4294967296, c_custkey LIMIT 10""",
    "u1_labelled_union": """
        SELECT 'patients' AS table_name, count(*) AS row_count FROM dim_patient
        UNION ALL SELECT 'claims', count(*) FROM raw_claims UNION ALL SELECT 'notes', count(*) FROM raw_clinical_notes""",
    "u2_two_sources_one_shape": n("grant_type, sensitivity_level", f"({platform.SQL['a2_role_grant_history']})"),
    "u3_stacked_points": n("measurement_point, depression_severity", "fact_rehab_outcome"),
    "f1_case_and_trim": """
        SELECT record_id, upper(trim(first_name)) AS first_name, lower(trim(email)) AS email FROM raw_patients""",
    "f2_concat": """
        SELECT patient_id, first_name || ' ' || last_name || '/' || gender AS label FROM dim_patient""",
    "f3_left_right_substr": """
        SELECT patient_id, left(last_name, 2) AS head, right(ssn, 4) AS tail, substr(address, 2, 3) AS middle
        FROM dim_patient""",
    "f4_length_repeat_contains": """
        SELECT patient_id, CAST(length(email) AS INTEGER) AS size, repeat('*', length(last_name)) AS stars,
               contains(email, '@') AS is_email FROM dim_patient""",
    "f5_zero_padding": """
        SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS padded, lpad(o_orderkey::VARCHAR, 2, '0') AS cut
        FROM orders""",
    "f6_first_match": """
        SELECT medication_id, nullif(regexp_extract(medication_name, '[0-9]+[a-zA-Z]+'), '') AS dose
        FROM fact_medication""",
    "f7_array_text": """
        SELECT query_id, array_to_string(direct_objects_accessed, ',') AS objects FROM access_history
        WHERE array_to_string(direct_objects_accessed, ',') ILIKE '%patient%'""",
    "f8_round": f"""
        SELECT lab_id, {r('result_numeric / 3', 1)} AS third, {r('result_numeric', 0)} AS whole FROM raw_lab_results""",
    "f9_power_floor_abs_mod": """
        SELECT encounter_id, pow(length_of_stay_days, 2)::DOUBLE AS squared, length_of_stay_days // 7 AS weeks,
               abs(length_of_stay_days - 5) AS distance, length_of_stay_days % 3 AS rest FROM fact_encounter""",
    "f10_integer_division": "SELECT query_id, total_elapsed_time / 1000.0::DOUBLE AS seconds FROM query_history",
    "f11_days_between": f"SELECT encounter_id, {DAYS} AS days FROM fact_encounter",
    "f12_weeks_between": f"SELECT medication_id, {weeks('start_date', 'end_date')} AS weeks FROM fact_medication",
    "f13_years_between": f"""
        SELECT patient_id, year({CLINICAL_DAY}) - year(date_of_birth) AS years FROM dim_patient""",
    "f14_hours_between": f"""
        SELECT session_id, CAST((epoch({LOG_DAY}) - epoch(date_trunc('hour', created_on))) / 3600 AS BIGINT) AS hours
        FROM platform_sessions""",
    "f15_date_add": f"""
        SELECT referral_id, {text('referral_date + 30', 'plus_days')},
               {text('referral_date - INTERVAL 1 MONTH', 'minus_month')},
               {text('referral_date + INTERVAL 7 YEARS', 'plus_years')} FROM fact_rehab_referral""",
    "f16_truncate": f"""
        SELECT event_id, {text("date_trunc('month', event_timestamp)", 'month')}, {text('event_timestamp', 'day')},
               {stamp("date_trunc('hour', event_timestamp)", 'hour')} FROM login_history""",
    "f17_date_parts": """
        SELECT patient_id, CAST(make_date(year(date_of_birth), 1, 1) AS VARCHAR) AS first_of_year FROM dim_patient""",
    "f18_explicit_today": n("drug_class", f"fact_medication WHERE end_date >= {CLINICAL_DAY} - INTERVAL 6 MONTHS"),
    "f19_explicit_role": """
        SELECT patient_id FROM dim_patient WHERE patient_id IN
          (SELECT patient_id FROM care_team_assignments WHERE care_team_id IN
             (SELECT care_team_id FROM care_team_assignments WHERE clinician_user = 'CLINICIAN_5'))""",
    "f20_hash_spread": f"SELECT event_id, {mix('event_id', 5, 10000)} AS spread FROM events",
    "f21_uniform": f"SELECT event_id, {u('event_id', 9, 10, 99)} AS drawn FROM events",
    "f22_unit_conversion": f"""
        SELECT transfer_type, {r('CAST(sum(bytes_transferred) AS DOUBLE) / 1073741824.0::DOUBLE', 4)} AS gb,
               {r('CAST(sum(bytes_transferred) AS DOUBLE) / 1099511627776.0::DOUBLE', 6)} AS tb
        FROM data_transfer_history GROUP BY 1""",
    "v1_scalar_policy": f"""
        SELECT patient_id, 'XXX-XX-' || right(ssn, 4) AS ssn, {CONTACT('phone')} AS phone FROM dim_patient""",
    "v2_boolean_policy": f"SELECT patient_id, {SEEN} AS may_read FROM ({RATED})",
    "v3_replicating_generator": n(f"{pick(['TREADMILL', 'CYCLE_ERGOMETER', 'RECUMBENT_STEPPER', 'ARM_ERGOMETER', 'NU_STEP'], 'c_custkey * 4 + k')} AS modality",
                                  "customer CROSS JOIN range(0, 4) AS t(k)"),
}
