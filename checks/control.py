"""Expected results of the quality, governance, metric, streaming and generator queries."""

from __future__ import annotations

from checks import clinical
from checks.platform import stamp
from checks.silver import AGE_GROUP
from checks.fixed import ROLE_EDGES, TAG_VALUES, TARGETS
from checks.sqltext import CLINICAL_DAY, LOG_DAY, exact, pad, pick, r
from pulsemart.catalog.control import COUNTED, READER, ROLES
from pulsemart.sources import lookups as L

TOTAL = lambda c: f"CAST(sum({c}) AS BIGINT)"
ONE = lambda c: TOTAL(f"CASE WHEN {c} THEN 1 ELSE 0 END")
DAY = f"CAST({CLINICAL_DAY} AS DATE)"

RATED = """
    SELECT *, CASE WHEN patient_id IS NULL OR date_of_birth IS NULL THEN 'QUARANTINED'
                   WHEN ssn IS NULL OR gender IS NULL THEN 'UNDER_REVIEW'
                   WHEN load_timestamp < TIMESTAMP '2001-02-01' THEN 'DEPRECATED'
                   WHEN load_timestamp IS NULL THEN NULL ELSE 'CERTIFIED' END AS dq_status FROM dim_patient"""
SEEN = "(dq_status IS NULL OR dq_status = 'CERTIFIED')"
COUNTS = " UNION ALL ".join(
    f"SELECT '{t.upper()}' AS table_name, count(*) AS record_count FROM {t}" for t in [*COUNTED, "raw_claims"]
)
TARGET = "CASE " + " ".join(
    f"WHEN table_name = '{t}' AND record_count >= {n} THEN 'PASS: Target {n}'" for t, n in TARGETS.items()
) + " ELSE 'CHECK: Below target' END"
PHI = lambda c: f"""CASE WHEN length({c}) > 4 THEN repeat('*', length({c}) - 4) || right({c}, 4)
                    ELSE repeat('*', length({c})) END"""  # noqa: E731
CONTACT = lambda c: f"""CASE WHEN contains({c}, '@') THEN left({c}, 2) || '***@***.com'
                        WHEN length({c}) >= 10 THEN '***-***-' || right({c}, 4) ELSE '***' END"""  # noqa: E731


def by_role(*expressions: str) -> str:
    named = ", ".join(f"{e} AS {role.lower()}" for e, role in zip(expressions, ROLES))
    return f"SELECT patient_id, {named} FROM dim_patient"


def key_check(table: str, key: str) -> str:
    return f"""
        SELECT '{table}' AS table_name, '{key}' AS key_column,
               count(CASE WHEN k IS NOT NULL AND n > 1 THEN 1 END) AS repeated_keys,
               CAST(coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS BIGINT) AS missing_keys,
               CASE WHEN count(CASE WHEN k IS NOT NULL AND n > 1 THEN 1 END) = 0
                     AND coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
        FROM (SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1)"""


def component(label: str, expected: int, source: str, actual: str, healthy: str, otherwise: str, details: str) -> str:
    return f"""SELECT '{label}' AS component, CAST({expected} AS BIGINT) AS expected, actual,
               CASE WHEN actual {healthy} THEN 'HEALTHY' ELSE '{otherwise}' END AS status, '{details}' AS details
               FROM (SELECT CAST({actual} AS BIGINT) AS actual FROM {source})"""


def mix(key: str, salt: int, modulus: int) -> str:
    return f"(({key} * 48271 + {salt * 7919}) % {modulus})"


def u(key: str, salt: int, low: int, high: int) -> str:
    return f"({mix(key, salt, high - low + 1)} + {low})"


def back(key: str, salt: int, low: int, high: int, alias: str) -> str:
    return f"CAST({DAY} - CAST({u(key, salt, low, high)} AS INTEGER) AS VARCHAR) AS {alias}"


def minutes(key: str, salt: int, alias: str) -> str:
    return f"strftime({CLINICAL_DAY} - to_minutes({u(key, salt, 1, 1500000)}), '%Y-%m-%d %H:%M:%S.%f') AS {alias}"


def tenths(key: str, salt: int, low: int, high: int) -> str:
    return f"{u(key, salt, low, high)} / 10.0::DOUBLE"


def cents(key: str, salt: int, low: int, high: int) -> str:
    return exact(f"{u(key, salt, low * 100, high * 100)} / 100.0")


def txt(key: str, salt: int, low: int, high: int) -> str:
    return f"{u(key, salt, low, high)}::VARCHAR"


TEAM = f"""SELECT patient_id FROM care_team_assignments WHERE care_team_id IN
           (SELECT care_team_id FROM care_team_assignments WHERE clinician_user = '{READER}')"""
ORDER, CUST, EVENT = "o_orderkey", "c_custkey", "event_id"
PAT = lambda k: pad("PAT-", f"{k} % 5000", 6)
ENC = lambda k: pad("ENC-", f"{k} % 15000", 8)
DRAWN = {
    "duration_minutes": (20, 55), "target_hr_low": (88, 112), "target_hr_high": (118, 148), "resting_hr": (58, 88),
    "peak_hr": (92, 160), "recovery_hr": (68, 105), "resting_bp_systolic": (108, 145), "resting_bp_diastolic": (62, 88),
    "peak_bp_systolic": (128, 185), "peak_bp_diastolic": (68, 98), "rpe_peak": (10, 17), "ecg_monitor_minutes": (15, 50),
}
RESULT = "ref_low * 0.5::DOUBLE + (ref_high * 1.8::DOUBLE - ref_low * 0.5::DOUBLE) * " + \
    mix(EVENT, 101, 10000) + " / 10000.0::DOUBLE"


def outcome(name: str, mark: str, salt: int, days, walk, mets, phq9) -> str:
    return f"""
        SELECT {pad(f'OUT-{mark}-', CUST, 6)} AS outcome_id, {pad('REF-', CUST, 6)} AS referral_id,
               {PAT(CUST)} AS patient_id, 'COMPREHENSIVE' AS measurement_type, '{name}' AS measurement_point,
               {back(CUST, salt, *days, 'measurement_date')}, {u(CUST, salt + 1, *walk)} AS six_min_walk_meters,
               {tenths(CUST, salt + 2, *mets)} AS peak_mets, {u(CUST, salt + 3, *phq9)} AS phq9_score,
               {tenths(CUST, salt + 4, 180, 450)} AS bmi, {u(CUST, salt + 5, 55, 200)} AS ldl,
               {u(CUST, salt + 6, 25, 80)} AS hdl FROM customer"""


REACH = """
    WITH RECURSIVE edges(child, parent) AS (VALUES {edges}),
    reach(role, effective_role) AS (
      SELECT name, name FROM (SELECT child AS name FROM edges UNION SELECT parent FROM edges)
      UNION SELECT e.parent, q.effective_role FROM reach q JOIN edges e ON e.child = q.role)""".format(
    edges=", ".join(f"('{a}', '{b}')" for a, b in ROLE_EDGES)
)
ALLOWED = ", ".join(f"('{t}', '{v}')" for t, vs in TAG_VALUES.items() for v in vs)
SESSION_MEASURES = f"""
    count(*) AS total_sessions, avg(peak_hr) AS avg_peak_hr, avg(rpe_peak) AS avg_rpe,
    avg(duration_minutes) AS avg_duration, {ONE('safety_flag')} AS safety_incident_count,
    {ONE('exercise_terminated_early')} AS early_termination_count,
    {TOTAL('ecg_monitor_minutes')} AS total_ecg_minutes, round(avg(achieved_hrr_percent), 6) AS avg_hrr_percent"""
MONTH = lambda c: f"CAST(CAST(date_trunc('month', {c}) AS DATE) AS VARCHAR) AS {c}"
FAILS = "events WHERE event_type = 'error'"
SUMMARY = clinical.SQL["m1_rehab_program_summary"]
CMS = clinical.SQL["m5_cms_cardiac_rehab"]

SQL = {
    "q1_category_distribution": f"""
        SELECT cardiac_category, count(*) AS count,
               {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 2)} AS percentage
        FROM fact_diagnosis WHERE cardiac_category IS NOT NULL GROUP BY 1""",
    "q2_patient_nulls": """
        SELECT count(*) AS total_patients, count(CASE WHEN ssn IS NULL THEN 1 END) AS null_ssn,
               count(CASE WHEN date_of_birth IS NULL THEN 1 END) AS null_dob,
               count(CASE WHEN gender IS NULL THEN 1 END) AS null_gender,
               CASE WHEN count(CASE WHEN patient_id IS NULL THEN 1 END) = 0 THEN 'PASS: No NULL patient_id'
                    ELSE 'FAIL: NULL patient_id found' END AS quality_check FROM dim_patient""",
    "q3_safety_rate": f"""
        SELECT count(*) AS total_sessions, {ONE('safety_flag')} AS safety_flagged,
               {r(ONE('safety_flag') + ' * 100.0::DOUBLE / count(*)', 2)} AS pct_safety_flagged,
               CASE WHEN {ONE('safety_flag')} * 100.0 / count(*) < 10 THEN 'PASS: Safety flag rate < 10%'
                    ELSE 'CHECK: High safety flag rate' END AS validation_result FROM fact_rehab_session""",
    "q4_orphan_sessions": """
        SELECT count(*) AS orphan_sessions, CASE WHEN count(*) = 0 THEN 'PASS: All sessions have valid referrals'
               ELSE 'FAIL: ' || count(*)::VARCHAR || ' orphan sessions found' END AS validation_result
        FROM fact_rehab_session s LEFT JOIN fact_rehab_referral r ON s.referral_id = r.referral_id
        WHERE r.referral_id IS NULL AND s.referral_id IS NOT NULL""",
    "q5_orphan_encounters": """
        SELECT count(*) AS orphan_encounters, CASE WHEN count(*) = 0 THEN 'PASS: All encounters have valid patients'
               ELSE 'FAIL: ' || count(*)::VARCHAR || ' orphan encounters' END AS validation_result
        FROM fact_encounter e LEFT JOIN dim_patient p ON e.patient_id = p.patient_id WHERE p.patient_id IS NULL""",
    "q6_hemodynamic_ranges": """
        SELECT count(*) AS total_sessions, count(CASE WHEN peak_hr < 50 OR peak_hr > 220 THEN 1 END) AS invalid_peak_hr,
               count(CASE WHEN resting_hr < 30 OR resting_hr > 150 THEN 1 END) AS invalid_resting_hr,
               count(CASE WHEN rpe_peak < 6 OR rpe_peak > 20 THEN 1 END) AS invalid_rpe,
               count(CASE WHEN spo2_min < 70 OR spo2_min > 100 THEN 1 END) AS invalid_spo2,
               CASE WHEN count(CASE WHEN peak_hr < 50 OR peak_hr > 220 THEN 1 END) = 0
                    THEN 'PASS: All hemodynamics in valid range' ELSE 'CHECK: Some out-of-range values' END AS range_check
        FROM fact_rehab_session""",
    "q7_drug_class_distribution": """
        SELECT drug_class, count(*) AS count, count(DISTINCT patient_id) AS unique_patients FROM fact_medication
        WHERE drug_class IS NOT NULL GROUP BY 1""",
    "q8_outcome_completeness": """
        SELECT measurement_point, count(*) AS total_records, count(six_min_walk_meters) AS has_6mwt,
               count(peak_mets) AS has_mets, count(phq9_score) AS has_phq9, count(bmi) AS has_bmi
        FROM fact_rehab_outcome GROUP BY 1""",
    "q9_key_checks": " UNION ALL ".join([
        key_check("raw_diagnoses", "diagnosis_id"), key_check("fact_diagnosis", "diagnosis_id"),
        key_check("raw_encounters", "encounter_id"), key_check("fact_encounter", "encounter_id"),
        key_check("fact_rehab_session", "referral_id")]),
    "q10_total_records": f"""
        SELECT {TOTAL('record_count')} AS total_records,
               CASE WHEN sum(record_count) >= 10000 THEN 'PASS: Target met (10,000+)'
                    WHEN sum(record_count) >= 8000 THEN 'PARTIAL: Close to target' ELSE 'FAIL: Below target' END
                 AS validation_result FROM ({COUNTS})""",
    "q11_target_checks": f"SELECT table_name, record_count, {TARGET} AS target_check FROM ({COUNTS})",
    "q12_risk_distribution": """
        SELECT computed_risk AS risk_category, count(*) AS referral_count, avg(lvef_percent) AS avg_lvef,
               avg(gxt_peak_mets) AS avg_peak_mets FROM fact_rehab_referral GROUP BY 1""",
    "q13_encounter_distribution": """
        SELECT encounter_type, count(*) AS count, avg(length_of_stay_days) AS avg_los FROM fact_encounter GROUP BY 1""",
    "q14_payer_distribution": f"""
        SELECT payer_name, count(*) AS claim_count, {ONE("claim_status = 'DENIED'")} AS denials,
               {exact(r('CAST(sum(paid_amount) AS DOUBLE) / count(paid_amount)', 2))} AS avg_paid FROM raw_claims GROUP BY 1""",
    "q15_first_sessions": """
        SELECT p.first_name || ' ' || p.last_name AS patient_name, p.age, p.gender, r.qualifying_diagnosis,
               r.computed_risk, r.lvef_percent, s.session_number, s.peak_hr, s.rpe_peak, s.achieved_hrr_percent,
               s.safety_flag
        FROM dim_patient p JOIN fact_rehab_referral r ON p.patient_id = r.patient_id
        JOIN fact_rehab_session s ON r.referral_id = s.referral_id
        WHERE s.session_number = 1 ORDER BY r.lvef_percent ASC NULLS LAST, s.session_id LIMIT 15""",
    "q16_program_totals": f"""
        SELECT count(*) AS total_programs, count(DISTINCT patient_id) AS unique_patients,
               avg(total_sessions) AS avg_sessions_per_program, round(avg(adherence_rate_pct), 6) AS avg_adherence_pct
        FROM ({SUMMARY})""",
    "q17_comparison_totals": f"""
        SELECT count(*) AS total_comparisons, avg(delta_6mwt) AS avg_6mwt_improvement,
               avg(delta_mets) AS avg_mets_improvement, avg(delta_phq9) AS avg_phq9_change
        FROM ({clinical.SQL['m2_outcome_comparison']})""",
    "q18_cohort_by_risk": f"""
        SELECT risk_category, {TOTAL('patient_count')} AS total_patients, round(avg(avg_lvef), 6) AS avg_lvef,
               round(avg(avg_peak_mets), 6) AS avg_mets FROM ({clinical.COHORT}) GROUP BY 1""",
    "q19_latest_cms": f"""
        SELECT referral_month, total_referrals, enrollment_rate_pct, completion_rate_pct FROM ({CMS})
        ORDER BY referral_month DESC LIMIT 6""",
    "q20_claims_by_payer": f"""
        SELECT payer_name, {TOTAL('claim_count')} AS total_claims,
               {exact('sum(CAST(total_paid AS DECIMAL(18,2)))')} AS total_paid,
               round(avg(collection_rate_pct), 6) AS avg_collection_rate
        FROM ({clinical.SQL['m6_claims_summary']}) AS m6 GROUP BY 1
        ORDER BY sum(CAST(m6.total_paid AS DECIMAL(18,2))) DESC LIMIT 6""",
    "q21_platform_health": " UNION ALL ".join([
        component("01. RBAC Roles", 7, "platform_roles WHERE name LIKE 'HEALTH_%'", "count(*)", ">= 7", "ISSUE",
                  "Custom healthcare roles"),
        component("02. Warehouses", 4, f"""query_history WHERE start_time >= {LOG_DAY} - INTERVAL 30 DAY
                  AND warehouse_name LIKE 'HEALTH_%'""", "count(DISTINCT warehouse_name)", ">= 1", "CHECK",
                  "Dedicated warehouses"),
        component("03. Databases", 5, f"""query_history WHERE start_time >= {LOG_DAY} - INTERVAL 30 DAY
                  AND database_name LIKE 'HEALTH_%'""", "count(DISTINCT database_name)", ">= 5", "ISSUE",
                  "Medallion + Governance DBs"),
        component("04. DIM_PATIENT", 500, "dim_patient", "count(*)", ">= 400", "CHECK", "Patient demographics"),
        component("05. FACT_ENCOUNTER", 2000, "fact_encounter", "count(*)", ">= 1500", "CHECK", "Clinical encounters"),
        component("06. FACT_REHAB_SESSION", 4000, "fact_rehab_session", "count(*)", ">= 3000", "CHECK",
                  "Cardiac rehab sessions"),
        component("07. FACT_DIAGNOSIS", 3000, "fact_diagnosis", "count(*)", ">= 2000", "CHECK", "ICD diagnoses"),
        component("08. Analytics Views", 6, "range(9)", "count(*)", ">= 4", "CHECK", "Clinical + reporting views"),
        component("09. Governance Tags", 8, "tag_references", "count(DISTINCT tag_name)", ">= 6", "CHECK",
                  "HIPAA data classification tags"),
        component("10. Data Quality", 0, "dim_patient WHERE patient_id IS NULL", "count(*)", "= 0", "NULL values",
                  "No NULL patient identifiers")]),
    "q22_quality_status": f"SELECT patient_id, dq_status FROM ({RATED})",
    "n1_mask_patient_phi": by_role("last_name", "last_name", PHI("last_name"), "'**REDACTED**'"),
    "n2_mask_ssn": by_role("ssn", "'XXX-XX-' || right(ssn, 4)", "'***-**-****'", "'***-**-****'"),
    "n3_mask_dob": by_role("date_of_birth::VARCHAR", "make_date(year(date_of_birth), 1, 1)::VARCHAR",
                           "NULL::VARCHAR", "NULL::VARCHAR"),
    "n4_mask_email": by_role("email", "email", CONTACT("email"), CONTACT("email")),
    "n4_mask_phone": by_role("phone", "phone", CONTACT("phone"), CONTACT("phone")),
    "n5_quality_row_filter": f"SELECT patient_id, dq_status FROM ({RATED}) WHERE {SEEN}",
    "n5_visible_by_role": " UNION ALL ".join(
        f"SELECT '{role}' AS role, count(*) AS visible_rows FROM ({RATED}) WHERE "
        + ("TRUE" if role in ("HEALTH_DATA_ADMIN", "HEALTH_DATA_ENGINEER") else SEEN) for role in ROLES),
    "n6_care_team_row_filter": f"""
        SELECT patient_id, gender FROM dim_patient
        WHERE patient_id IN ({TEAM})""",
    "n7_bound_policies_readonly": f"""
        SELECT patient_id, '**REDACTED**' AS first_name, '**REDACTED**' AS last_name, '***-**-****' AS ssn,
               NULL::VARCHAR AS date_of_birth, {CONTACT('email')} AS email, {CONTACT('phone')} AS phone, dq_status
        FROM ({RATED}) q WHERE {SEEN}
          AND patient_id IN ({TEAM})""",
    "n7_bound_policies_engineer": f"""
        SELECT patient_id, {PHI('first_name')} AS first_name, {PHI('last_name')} AS last_name, '***-**-****' AS ssn,
               NULL::VARCHAR AS date_of_birth, {CONTACT('email')} AS email, {CONTACT('phone')} AS phone, dq_status
        FROM ({RATED}) q""",
    "n8_tag_usage": f"""
        SELECT tag_name, tag_value, count(*) AS assignments, count(DISTINCT object_name) AS objects,
               coalesce((tag_name, tag_value) IN ({ALLOWED}), FALSE) AS is_allowed FROM tag_references GROUP BY 1, 2""",
    "n8_columns_tagged": """
        SELECT object_database, object_schema, object_name, column_name, tag_value FROM tag_references
        WHERE tag_name = 'RETENTION_POLICY' AND tag_value IN ('7_YEARS', '10_YEARS')""",
    "n8_effective_roles": f"""
        {REACH}
        SELECT user_name, effective_role, count(*) AS granted_through
        FROM (SELECT DISTINCT grantee_name AS user_name, role FROM grants_to_users WHERE deleted_on IS NULL) g
        JOIN reach ON reach.role = g.role GROUP BY 1, 2""",
    "y1_metric_query": f"""
        SELECT modality, therapist, {MONTH('session_date')}, count(*) AS total_sessions, avg(peak_hr) AS avg_peak_hr
        FROM fact_rehab_session WHERE NOT safety_flag GROUP BY 1, 2, 3""",
    "y2_metrics_across": """
        SELECT p.gender, patient_count, average_age, referral_count, avg_lvef, total_sessions, avg_hrr_percent, avg_6mwt
        FROM (SELECT gender, count(DISTINCT patient_id) AS patient_count, avg(age) AS average_age
              FROM dim_patient GROUP BY 1) p
        LEFT JOIN (SELECT gender, count(DISTINCT referral_id) AS referral_count, avg(lvef_percent) AS avg_lvef
                   FROM fact_rehab_referral JOIN dim_patient USING (patient_id) GROUP BY 1) a
          ON a.gender IS NOT DISTINCT FROM p.gender
        LEFT JOIN (SELECT d.gender, count(*) AS total_sessions, round(avg(s.achieved_hrr_percent), 6) AS avg_hrr_percent
                   FROM fact_rehab_session s JOIN fact_rehab_referral f ON s.referral_id = f.referral_id
                   JOIN dim_patient d ON f.patient_id = d.patient_id GROUP BY 1) b
          ON b.gender IS NOT DISTINCT FROM p.gender
        LEFT JOIN (SELECT d.gender, avg(o.six_min_walk_meters) AS avg_6mwt
                   FROM fact_rehab_outcome o JOIN fact_rehab_referral f ON o.referral_id = f.referral_id
                   JOIN dim_patient d ON f.patient_id = d.patient_id GROUP BY 1) c
          ON c.gender IS NOT DISTINCT FROM p.gender""",
    "y3_patient_metrics": f"""
        SELECT gender, {AGE_GROUP} AS age_group, count(DISTINCT patient_id) AS patient_count, avg(age) AS average_age
        FROM dim_patient GROUP BY 1, 2""",
    "y4_session_metrics": f"SELECT modality, {SESSION_MEASURES} FROM fact_rehab_session GROUP BY 1",
    "y5_referral_metrics": """
        SELECT computed_risk AS risk_category, qualifying_diagnosis, count(DISTINCT referral_id) AS referral_count,
               avg(lvef_percent) AS avg_lvef, avg(days_event_to_referral) AS avg_days_to_referral
        FROM fact_rehab_referral GROUP BY 1, 2""",
    "y6_outcome_metrics": """
        SELECT measurement_point, depression_severity, avg(six_min_walk_meters) AS avg_6mwt,
               avg(peak_mets) AS avg_peak_mets, avg(phq9_score) AS avg_phq9, avg(bmi) AS avg_bmi
        FROM fact_rehab_outcome GROUP BY 1, 2""",
    "y7_referrals_by_day": """
        SELECT CAST(referral_date AS VARCHAR) AS referral_date, count(DISTINCT referral_id) AS referral_count
        FROM fact_rehab_referral GROUP BY 1""",
    "y7_outcomes_by_month": f"""
        SELECT {MONTH('measurement_date')}, avg(six_min_walk_meters) AS avg_6mwt FROM fact_rehab_outcome GROUP BY 1""",
    "z1_failure_spikes": f"""
        SELECT {stamp('w', 'window_start')}, {stamp('w + INTERVAL 15 MINUTES', 'window_end')}, failures
        FROM (SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS w, count(*) AS failures FROM {FAILS} GROUP BY 1)
        WHERE failures > 1""",
    "z2_login_spikes": f"""
        SELECT {stamp('w', 'window_start')}, {stamp('w + INTERVAL 1 HOUR', 'window_end')}, user_name, failures
        FROM (SELECT time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * s) AS w,
                     'USER_' || user_id::VARCHAR AS user_name, count(*) AS failures
              FROM (SELECT * FROM {FAILS}) CROSS JOIN (VALUES (0), (1), (2), (3)) AS steps(s) GROUP BY 1, 2)
        WHERE failures >= 2""",
    "z3_daily_sessions": f"""
        SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS sessions_conducted,
               count(DISTINCT patient_id) AS unique_patients, avg(duration_minutes) AS avg_duration, avg(peak_hr) AS avg_peak_hr,
               {ONE('exercise_terminated_early')} AS early_terminations,
               {TOTAL('ecg_monitor_minutes')} AS total_ecg_minutes FROM raw_rehab_sessions GROUP BY 1""",
    "z4_newest_encounters": """
        SELECT encounter_id, discharge_status, strftime(load_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS load_timestamp
        FROM raw_encounters QUALIFY row_number() OVER (PARTITION BY encounter_id
          ORDER BY raw_encounters.load_timestamp DESC NULLS FIRST, record_id DESC) = 1""",
    "z4_without_repeats": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "h1_patients": f"""
        SELECT {pad('PAT-', CUST, 6)} AS patient_id, {pick(L.FIRST_NAMES, CUST)} AS first_name,
               {pick(L.LAST_NAMES, f'{CUST} // 20')} AS last_name, {back(CUST, 1, 16000, 32000, 'date_of_birth')},
               {u(CUST, 2, 44, 88)} AS age,
               CASE WHEN {CUST} % 20 IN (0, 1, 2, 3, 4, 5, 14, 15, 19) THEN 'M' ELSE 'F' END AS gender,
               {pick(L.ETHNICITIES, CUST)} AS ethnicity,
               {txt(CUST, 3, 100, 999)} || '-' || {txt(CUST, 4, 10, 99)} || '-' || {txt(CUST, 5, 1000, 9999)} AS ssn,
               {txt(CUST, 6, 100, 9999)} || ' ' || {pick(L.STREETS, CUST)} AS address,
               '(' || {txt(CUST, 7, 200, 999)} || ') 555-' || {txt(CUST, 8, 1000, 9999)} AS phone,
               'patient' || {CUST}::VARCHAR || '@email.com' AS email,
               'INS-' || {txt(CUST, 9, 10000, 99999)} AS insurance_id, {pick(L.LANGUAGES, CUST)} AS primary_language,
               {pick(L.MARITAL, CUST)} AS marital_status, TRUE AS is_current FROM customer""",
    "h2_encounters": f"""
        SELECT {pad('ENC-', ORDER, 8)} AS encounter_id, {PAT(ORDER)} AS patient_id,
               {pick(L.ENCOUNTER_TYPES, ORDER)} AS encounter_type, {back(ORDER, 11, 1, 1095, 'admit_date')},
               CAST({DAY} - CAST({u(ORDER, 11, 1, 1095)} AS INTEGER) + CAST({u(ORDER, 12, 1, 14)} AS INTEGER) AS VARCHAR)
                 AS discharge_date, {u(ORDER, 12, 1, 14)} AS length_of_stay_days,
               {pick(L.DEPARTMENTS, ORDER)} AS department, {pick(L.PROVIDERS, ORDER)} AS attending_provider,
               {pick(L.FACILITIES, ORDER)} AS facility_code, {pick(L.ADMIT_CODES, ORDER)} AS admit_diagnosis_code,
               CASE WHEN {ORDER} % 20 = 0 THEN 'EXPIRED' WHEN {ORDER} % 15 = 0 THEN 'TRANSFERRED'
                    ELSE 'DISCHARGED_HOME' END AS discharge_status FROM orders""",
    "h3_diagnoses": f"""
        SELECT {pad('DX-', ORDER, 8)} AS diagnosis_id, {ENC(ORDER)} AS encounter_id, {PAT(ORDER)} AS patient_id,
               dx_code AS icd_code, '10' AS icd_version, dx_name AS description,
               {pick(L.DIAGNOSIS_TYPES, ORDER)} AS diagnosis_type, {back(ORDER, 21, 1, 1095, 'diagnosis_date')},
               lookup_category AS cardiac_category FROM orders JOIN lk_diagnoses ON rn = {ORDER} % 30 + 1""",
    "h4_medications": f"""
        SELECT {pad('MED-', ORDER, 8)} AS medication_id, {ENC(ORDER)} AS encounter_id, {PAT(ORDER)} AS patient_id,
               lpad({txt(ORDER, 31, 10000, 99999)}, 11, '0') AS ndc_code, med_name AS medication_name,
               nullif(regexp_extract(med_name, '[0-9]+[a-zA-Z]+'), '') AS dosage, {pick(L.ROUTES, ORDER)} AS route,
               {pick(L.FREQUENCIES, ORDER)} AS frequency, {pick(L.PROVIDERS, ORDER)} AS prescriber,
               {back(ORDER, 32, 30, 730, 'start_date')},
               CAST({DAY} + CAST({u(ORDER, 33, 30, 365)} AS INTEGER) AS VARCHAR) AS end_date, lookup_class AS drug_class
        FROM orders JOIN lk_medications ON rn = {ORDER} % 30 + 1""",
    "h5_referrals": f"""
        SELECT {pad('REF-', CUST, 6)} AS referral_id, {PAT(CUST)} AS patient_id,
               {pick(L.PROVIDERS, CUST)} AS referring_physician, {pick(L.QUALIFYING, CUST)} AS qualifying_diagnosis,
               {back(CUST, 41, 30, 730, 'cardiac_event_date')}, {u(CUST, 42, 20, 65)} AS lvef_percent,
               {u(CUST, 43, 80, 170)} AS gxt_peak_hr, {tenths(CUST, 44, 30, 120)} AS gxt_peak_mets,
               {pick(['LOW', 'MODERATE', 'HIGH'], mix(CUST, 45, 3))} AS aacvpr_risk_category,
               {back(CUST, 46, 1, 60, 'referral_date')}, {u(CUST, 47, 2, 30)} AS days_event_to_referral FROM customer""",
    "h6_sessions": f"""
        SELECT {pad('SES-', 'id', 8)} AS session_id, {pad('REF-', f'{CUST} % 2000', 6)} AS referral_id,
               {PAT(CUST)} AS patient_id, session_number,
               CAST({DAY} - 90 + CAST((session_number - 1) * 3 + {u('id', 51, 0, 2)} AS INTEGER) AS VARCHAR) AS session_date,
               {pick(L.MODALITIES, 'id')} AS modality,
               {', '.join(f"{u('id', 52 + i, *b)} AS {c}" for i, (c, b) in enumerate(DRAWN.items()))},
               {tenths('id', 70, 880, 1000)} AS spo2_min, {pick(L.RHYTHMS, 'id')} AS ecg_rhythm,
               {u('id', 71, 0, 100)} < 3 AS exercise_terminated_early, {pick(L.THERAPISTS, 'id')} AS therapist
        FROM (SELECT {CUST}, CAST(n AS INTEGER) AS session_number, {CUST} * 10 + n - 1 AS id
              FROM customer CROSS JOIN range(1, 11) AS t(n))""",
    "h7_outcomes": outcome("BASELINE", "B", 81, (60, 180), (180, 520), (25, 85), (1, 24)) + " UNION ALL "
    + outcome("DISCHARGE", "D", 91, (1, 30), (220, 620), (35, 110), (0, 20)),
    "h8_labs": f"""
        SELECT *, CASE WHEN result_numeric < reference_low THEN 'LOW' WHEN result_numeric > reference_high THEN 'HIGH'
                       ELSE 'NORMAL' END AS computed_flag
        FROM (SELECT {pad('LAB-', EVENT, 8)} AS lab_id, {ENC(EVENT)} AS encounter_id, {PAT(EVENT)} AS patient_id,
                     lookup_loinc AS loinc_code, lookup_test AS test_name, {r(RESULT, 2)} AS result_numeric,
                     lookup_unit AS unit, ref_low AS reference_low, ref_high AS reference_high,
                     {minutes(EVENT, 102, 'collected_at')} FROM events JOIN lk_labs ON rn = {EVENT} % 30 + 1)""",
    "h9_vitals": f"""
        SELECT {pad('VIT-', EVENT, 8)} AS vital_id, {PAT(EVENT)} AS patient_id, {ENC(EVENT)} AS encounter_id,
               {pick([v[0] for v in L.VITALS], EVENT)} AS vital_type,
               CASE {EVENT} % 8 {' '.join(f'WHEN {i} THEN {u(EVENT, 111, v[2], v[3])}' for i, v in enumerate(L.VITALS))}
               END AS value_numeric, {pick([v[1] for v in L.VITALS], EVENT)} AS unit,
               {minutes(EVENT, 112, 'measured_at')}, {pick(L.NURSES, EVENT)} AS measured_by,
               'BEDSIDE_MONITOR' AS source_system FROM events""",
    "h10_claims": f"""
        SELECT {pad('CLM-', ORDER, 8)} AS claim_id, {PAT(ORDER)} AS patient_id, {ENC(ORDER)} AS encounter_id,
               {pad('PAY-', f'{ORDER} % 10', 3)} AS payer_id, {pick(L.PAYERS, ORDER)} AS payer_name,
               {pick(L.CLAIM_TYPES, ORDER)} AS claim_type, {back(ORDER, 120, 1, 730, 'service_date')},
               {pick(L.CPT_CODES, ORDER)} AS cpt_code, {pick(L.DRG_CODES, ORDER)} AS drg_code,
               {cents(ORDER, 121, 150, 35000)} AS billed_amount, {cents(ORDER, 122, 100, 28000)} AS allowed_amount,
               {cents(ORDER, 123, 80, 25000)} AS paid_amount, {cents(ORDER, 124, 0, 5000)} AS patient_responsibility,
               CASE WHEN {u(ORDER, 125, 0, 100)} < 12 THEN 'DENIED' WHEN {u(ORDER, 126, 0, 100)} < 5 THEN 'PENDING'
                    ELSE 'PAID' END AS claim_status,
               CASE WHEN {u(ORDER, 127, 0, 100)} < 12 THEN {pick(L.DENIAL_REASONS, ORDER)} END AS denial_reason
        FROM orders""",
    "h11_clinical_notes": f"""
        SELECT {pad('NOTE-', 'doc_id', 8)} AS note_id, {PAT('doc_id')} AS patient_id, {ENC('doc_id')} AS encounter_id,
               {pick(L.NOTE_TYPES, 'doc_id')} AS note_type,
               {pick(L.NOTE_TYPES, 'doc_id')} || ': ' || {pick(L.NOTE_TEXTS, 'doc_id')} AS note_text,
               {pick(L.AUTHORS, 'doc_id')} AS author, {minutes('doc_id', 131, 'authored_at')} FROM documents""",
}
