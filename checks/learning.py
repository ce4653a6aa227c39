"""Expected results of the feature, embedding, history and note queries."""

from __future__ import annotations

from checks.sqltext import CLINICAL_DAY, printed, r, values
from pulsemart.catalog.learning import MODEL_COLUMNS, TRACKED
from pulsemart.plans import notes as n
from pulsemart.plans.embeddings import MODEL
from pulsemart.sources import lookups as L

ANY = lambda column, value: f"bool_or(coalesce({column} = '{value}', FALSE))"
WORDS = lambda text: f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
LISTED = lambda items: "[" + ", ".join(f"'{i}'" for i in items) + "]"

DX = f"""
    SELECT patient_id, count(*) AS total_diagnoses, count(DISTINCT icd_code) AS unique_icd_codes,
           {ANY('cardiac_category', 'ACUTE_MI')} AS has_mi,
           {ANY('cardiac_category', 'HEART_FAILURE')} AS has_heart_failure,
           {ANY('cardiac_category', 'ATRIAL_FIBRILLATION')} AS has_atrial_fib FROM fact_diagnosis GROUP BY 1"""
MED = f"""
    SELECT patient_id, count(*) AS total_medications, {ANY('drug_class', 'BETA_BLOCKER')} AS on_beta_blocker,
           {ANY('drug_class', 'ACE_INHIBITOR')} AS on_ace_inhibitor,
           {ANY('drug_class', 'ANTICOAGULANT')} AS on_anticoagulant, {ANY('drug_class', 'STATIN')} AS on_statin,
           count(DISTINCT drug_class) AS distinct_drug_classes FROM fact_medication GROUP BY 1"""
ENC = """
    SELECT patient_id, count(*) AS total_encounters,
           CAST(sum(CASE WHEN encounter_type = 'INPATIENT' THEN 1 ELSE 0 END) AS BIGINT) AS inpatient_visits,
           avg(length_of_stay_days) AS avg_length_of_stay, max(length_of_stay_days) AS max_length_of_stay
    FROM fact_encounter GROUP BY 1"""
LAB = f"""
    SELECT patient_id, max(CASE WHEN test_name ILIKE '%hba1c%' THEN result_numeric END) AS latest_hba1c,
           max(CASE WHEN test_name ILIKE '%ldl%' THEN result_numeric END) AS latest_ldl,
           max(CASE WHEN test_name ILIKE '%hdl%' THEN result_numeric END) AS latest_hdl,
           max(CASE WHEN test_name ILIKE '%cholesterol%' THEN result_numeric END) AS latest_total_cholesterol,
           {r("sum(CASE WHEN computed_flag IN ('HIGH', 'LOW') THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*), 0)", 3)}
             AS abnormal_lab_ratio FROM fact_lab_result GROUP BY 1"""
FEATURES = f"""
    SELECT p.patient_id, p.age, p.gender, p.ethnicity, coalesce(total_diagnoses, 0) AS total_diagnoses,
           coalesce(unique_icd_codes, 0) AS unique_icd_codes, coalesce(has_mi, FALSE) AS has_mi,
           coalesce(has_heart_failure, FALSE) AS has_heart_failure, coalesce(has_atrial_fib, FALSE) AS has_atrial_fib,
           coalesce(total_medications, 0) AS total_medications, coalesce(on_beta_blocker, FALSE) AS on_beta_blocker,
           coalesce(on_ace_inhibitor, FALSE) AS on_ace_inhibitor, coalesce(on_anticoagulant, FALSE) AS on_anticoagulant,
           coalesce(on_statin, FALSE) AS on_statin, coalesce(distinct_drug_classes, 0) AS distinct_drug_classes,
           coalesce(total_encounters, 0) AS total_encounters, coalesce(inpatient_visits, 0) AS inpatient_visits,
           coalesce(avg_length_of_stay, 0) AS avg_length_of_stay, coalesce(max_length_of_stay, 0) AS max_length_of_stay,
           latest_hba1c, latest_ldl, latest_hdl, latest_total_cholesterol, abnormal_lab_ratio
    FROM dim_patient p LEFT JOIN ({DX}) dx ON p.patient_id = dx.patient_id
    LEFT JOIN ({MED}) med ON p.patient_id = med.patient_id LEFT JOIN ({ENC}) enc ON p.patient_id = enc.patient_id
    LEFT JOIN ({LAB}) lab ON p.patient_id = lab.patient_id"""
TIMELINE = "(PARTITION BY s.patient_id ORDER BY s.session_number, s.referral_id, s.session_id"
REHAB = f"""
    SELECT s.patient_id, s.referral_id, s.session_id, s.session_number, r.computed_risk AS risk_category,
           r.lvef_percent, r.gxt_peak_mets, s.resting_hr, s.peak_hr, s.recovery_hr, s.hr_recovery_delta,
           s.achieved_hrr_percent, s.resting_bp_systolic, s.peak_bp_systolic, s.rpe_peak, s.spo2_min,
           s.duration_minutes, s.ecg_monitor_minutes, s.safety_flag, s.exercise_terminated_early,
           avg(s.peak_hr) OVER {TIMELINE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3_avg_peak_hr,
           avg(s.rpe_peak) OVER {TIMELINE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3_avg_rpe,
           avg(s.duration_minutes) OVER {TIMELINE} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_3_avg_duration,
           s.peak_hr - lag(s.peak_hr) OVER {TIMELINE}) AS peak_hr_delta,
           s.rpe_peak - lag(s.rpe_peak) OVER {TIMELINE}) AS rpe_delta,
           s.duration_minutes - lag(s.duration_minutes) OVER {TIMELINE}) AS duration_delta
    FROM fact_rehab_session s JOIN fact_rehab_referral r ON s.referral_id = r.referral_id"""
STATE = ", ".join(TRACKED)


def vector_table(source: str, keep: str, key: str, text: str) -> str:
    """The hashed vector of each text: length, filled cells, top weight, norm and every weight to five places."""
    return f"""
        WITH source AS ({source}),
        tokens AS (SELECT DISTINCT {key} AS k, {WORDS(text)} AS w FROM source),
        hashed AS (SELECT k, list_transform(w, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT)) AS h FROM tokens),
        terms AS (SELECT k, unnest(list_concat(h, list_transform(range(1, len(h)), lambda i: h[i] * 31 + h[i + 1])))
                    AS term FROM hashed),
        cells AS (SELECT k, term % 768 AS bucket, count(*) AS n FROM terms GROUP BY 1, 2),
        totals AS (SELECT k, CAST(sum(n * n) AS DOUBLE) AS squares FROM cells GROUP BY 1),
        weighted AS (SELECT cells.k, bucket, CAST(n / sqrt(squares) AS FLOAT)::DOUBLE AS weight
                     FROM cells JOIN totals ON cells.k = totals.k),
        vectors AS (SELECT k, CAST(768 AS INTEGER) AS dimensions, CAST(count(*) AS INTEGER) AS filled,
                           round(max(weight), 5) AS top_weight, round(sqrt(sum(weight * weight)), 3) AS norm,
                           string_agg(bucket || ':' || CAST(round(weight * 100000) AS INTEGER), ' ' ORDER BY bucket) AS cells
                    FROM weighted GROUP BY 1)
        SELECT {keep}, '{MODEL}' AS model_used, dimensions, filled, top_weight, norm, cells
        FROM source JOIN vectors ON source.{key} = vectors.k"""


DX_TEXTS = "SELECT DISTINCT icd_code, icd_version, description FROM fact_diagnosis WHERE description IS NOT NULL"
MED_TEXTS = """SELECT DISTINCT ndc_code, medication_name, drug_class, medication_name || ' (' || drug_class || ')' AS label
               FROM fact_medication WHERE medication_name IS NOT NULL"""
SCORE = f"""
    SELECT *, len(list_filter({WORDS('note_text')}, lambda t: list_contains({LISTED(n.POSITIVE)}, t))) AS good,
           len(list_filter({WORDS('note_text')}, lambda t: list_contains({LISTED(n.NEGATIVE)}, t))) AS bad
    FROM raw_clinical_notes"""
SENTIMENT = f"SELECT *, coalesce((good - bad)::DOUBLE / nullif(good + bad, 0), 0.0::DOUBLE) AS score FROM ({SCORE})"
OPINIONS = """
    SELECT referral_id, patient_id, qualifying_diagnosis, lvef_percent, gxt_peak_mets, computed_risk AS rule_based_risk,
           CASE WHEN lvef_percent < 40 OR gxt_peak_mets < 5 THEN 'HIGH'
                WHEN lvef_percent >= 50 AND gxt_peak_mets >= 7
                  AND qualifying_diagnosis NOT IN ('STEMI', 'HFrEF', 'CABG') THEN 'LOW'
                ELSE 'MODERATE' END AS second_opinion FROM fact_rehab_referral"""
PHRASES = n.phrase_index()
ANY_PHRASE = "|".join(sorted(PHRASES, key=lambda p: (-len(p), p)))
FOUND = lambda items: f"list_filter({LISTED(items)}, lambda t: contains(lower(note_text), t))"

HISTORY = f"""
    WITH ordered AS (
      SELECT *, row(address, marital_status, primary_language) AS state,
             lag(row(address, marital_status, primary_language)) OVER w AS before_state, lag(1) OVER w AS had_before
      FROM raw_patients WINDOW w AS (PARTITION BY patient_id ORDER BY load_timestamp ASC NULLS LAST, record_id)),
    changed AS (SELECT * FROM ordered WHERE had_before IS NULL OR before_state IS DISTINCT FROM state)
    SELECT patient_id, {STATE}, strftime(load_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS effective_from,
           CASE WHEN lead(1) OVER v IS NULL THEN '9999-12-31 00:00:00.000000'
                ELSE strftime(lead(load_timestamp) OVER v, '%Y-%m-%d %H:%M:%S.%f') END AS effective_to,
           lead(1) OVER v IS NULL AS is_current
    FROM changed WINDOW v AS (PARTITION BY patient_id ORDER BY load_timestamp ASC NULLS LAST, record_id)"""

SQL = {
    "t9_patient_history": HISTORY,
    "t9_merged_history": HISTORY,
    "l1_patient_clinical_features": f"SELECT *, {printed(CLINICAL_DAY)} AS feature_computed_at FROM ({FEATURES})",
    "l2_diagnosis_features": DX,
    "l3_medication_features": MED,
    "l4_encounter_features": ENC,
    "l5_lab_features": LAB,
    "l6_cardiac_rehab_features": f"SELECT *, {printed(CLINICAL_DAY)} AS feature_computed_at FROM ({REHAB})",
    "l7_mortality_training_set": f"""
        SELECT f.* EXCLUDE (ethnicity, max_length_of_stay, latest_hdl, latest_total_cholesterol),
               CASE WHEN e.discharge_status = 'EXPIRED' THEN 1 ELSE 0 END AS label_mortality, 'V1' AS dataset_version,
               {printed(CLINICAL_DAY)} AS created_at
        FROM ({FEATURES}) f LEFT JOIN (
          SELECT patient_id, discharge_status FROM fact_encounter
          QUALIFY row_number() OVER (PARTITION BY patient_id
                                     ORDER BY admit_date DESC NULLS FIRST, encounter_id DESC) = 1) e
        ON f.patient_id = e.patient_id""",
    "l8_adverse_event_training_set": f"""
        SELECT *, CASE WHEN safety_flag OR exercise_terminated_early THEN 1 ELSE 0 END AS label_adverse_event,
               'V1' AS dataset_version, {printed(CLINICAL_DAY)} AS created_at FROM ({REHAB})""",
    "l9_model_catalogue": f"""
        SELECT m.* REPLACE (CASE WHEN model_id = 'MDL-003' THEN 'Retrained' ELSE description END AS description),
               CASE training_dataset WHEN 'HEALTH_TRANSFORM_DB.MEDICATIONS.FACT_MEDICATION' THEN (SELECT count(*) FROM fact_medication)
                 WHEN 'HEALTH_AI_READY_DB.FEATURE_STORE.PATIENT_CLINICAL_FEATURES' THEN (SELECT count(*) FROM dim_patient)
                 WHEN 'HEALTH_AI_READY_DB.TRAINING_DATASETS.MORTALITY_PREDICTION_V1' THEN (SELECT count(*) FROM dim_patient) END AS training_rows
        FROM ({values(L.MODELS, MODEL_COLUMNS)}) m""",
    "l10_diagnosis_texts": DX_TEXTS,
    "l10_medication_texts": MED_TEXTS,
    "l11_diagnosis_embeddings": vector_table(DX_TEXTS, "icd_code, icd_version, description", "description",
                                             "description"),
    "l11_medication_embeddings": vector_table(MED_TEXTS, "ndc_code, medication_name, drug_class, label", "label",
                                              "label"),
    "l12_note_embeddings": vector_table("SELECT * FROM raw_clinical_notes",
                                        "note_id, patient_id, encounter_id, note_type", "note_id", "note_text"),
    "x1_note_summaries": f"""
        WITH split AS (SELECT note_id, list_filter(list_transform(regexp_extract_all(note_text, '[^.!?\n]+[.!?]?'),
                              lambda s: trim(s)), lambda s: length(s) > 1) AS parts FROM raw_clinical_notes),
        phrases AS (SELECT note_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS position FROM split),
        used AS (SELECT note_id, position, unnest({WORDS('sentence')}) AS word FROM phrases),
        frequency AS (SELECT note_id, word, count(*) AS f FROM used GROUP BY 1, 2),
        scores AS (SELECT u.note_id, u.position, CAST(sum(f) AS BIGINT) * 1000 // count(*) AS score
                   FROM used u JOIN frequency q ON u.note_id = q.note_id AND u.word = q.word GROUP BY 1, 2),
        best AS (SELECT * FROM scores
                 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, position) <= 3)
        SELECT best.note_id, string_agg(sentence, ' ' ORDER BY best.position) AS summary
        FROM best JOIN phrases ON best.note_id = phrases.note_id AND best.position = phrases.position GROUP BY 1""",
    "x1_tfidf_summaries": f"""
        WITH split AS (SELECT note_id, list_filter(list_transform(regexp_extract_all(note_text, '[^.!?\n]+[.!?]?'),
                              lambda s: trim(s)), lambda s: length(s) > 1) AS parts
                       FROM raw_clinical_notes WHERE note_text IS NOT NULL),
        phrases AS (SELECT note_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS position FROM split),
        used AS (SELECT note_id, position, unnest({WORDS('sentence')}) AS word FROM phrases),
        whole AS (SELECT note_id, unnest(list_distinct({WORDS('note_text')})) AS word FROM raw_clinical_notes),
        spread AS (SELECT word, count(*) AS notes FROM whole GROUP BY 1),
        within AS (SELECT note_id, word, count(*) AS f FROM used GROUP BY 1, 2),
        weighed AS (SELECT note_id, within.word, f * CAST(round(ln((SELECT count(*) FROM raw_clinical_notes
                           WHERE note_text IS NOT NULL)::DOUBLE / notes) * 1000) AS BIGINT) AS weight
                    FROM within JOIN spread ON within.word = spread.word),
        scored AS (SELECT u.note_id, u.position, CAST(floor(sum(weight)::DOUBLE / count(*)) AS BIGINT) AS score,
                          list_distinct(list(u.word)) AS ws
                   FROM used u JOIN weighed w ON u.note_id = w.note_id AND u.word = w.word GROUP BY 1, 2),
        one AS (SELECT *, position AS pos FROM scored
                QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY score DESC, position) = 1),
        two AS (SELECT s.note_id, s.position AS pos, s.ws FROM scored s JOIN one ON s.note_id = one.note_id AND s.position <> one.pos
                QUALIFY row_number() OVER (PARTITION BY s.note_id ORDER BY
                  s.score * (100 - len(list_intersect(s.ws, one.ws)) * 100 // len(s.ws)) DESC, s.position) = 1),
        three AS (SELECT s.note_id, s.position AS pos FROM scored s JOIN one ON s.note_id = one.note_id AND s.position <> one.pos
                  JOIN two ON s.note_id = two.note_id AND s.position <> two.pos
                  QUALIFY row_number() OVER (PARTITION BY s.note_id ORDER BY s.score * (100 - greatest(
                    len(list_intersect(s.ws, one.ws)), len(list_intersect(s.ws, two.ws))) * 100 // len(s.ws)) DESC, s.position) = 1),
        best AS (SELECT note_id, pos FROM one UNION ALL SELECT note_id, pos FROM two UNION ALL SELECT note_id, pos FROM three)
        SELECT best.note_id, string_agg(sentence, ' ' ORDER BY best.pos) AS summary
        FROM best JOIN phrases ON best.note_id = phrases.note_id AND best.pos = phrases.position GROUP BY 1""",
    "x2_note_sentiment": f"""
        SELECT note_id, note_type, patient_id, left(note_text, 200) AS note_preview, score AS sentiment_score,
               CASE WHEN score > 0.2 THEN 'POSITIVE' WHEN score < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END
                 AS sentiment_label FROM ({SENTIMENT})""",
    "x3_sentiment_counts": f"""
        SELECT CASE WHEN score > 0.2 THEN 'POSITIVE' WHEN score < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END
                 AS sentiment_label, count(*) AS notes FROM ({SENTIMENT}) GROUP BY 1""",
    "x4_note_entities": f"""
        SELECT note_id, note_type, patient_id, CAST(to_json({{
                 'diagnoses': {FOUND(n.DIAGNOSIS_TERMS)}, 'medications': {FOUND(n.MEDICATION_TERMS)},
                 'vitals': regexp_extract_all(note_text, '{n.VITAL_PATTERN}', 1),
                 'procedures': {FOUND(n.PROCEDURE_TERMS)},
                 'follow_up': regexp_extract(note_text, '{n.FOLLOW_UP_PATTERN}', 1) }}) AS VARCHAR)
               AS extracted_entities FROM raw_clinical_notes""",
    "x4_entity_spans": f"""
        WITH known AS ({values([(p, k, c) for p, (k, c) in PHRASES.items()], ['phrase', 'kind', 'code'])}),
        texts AS (SELECT note_id, note_text, lower(regexp_replace(note_text, '[^A-Za-z0-9]', ' ', 'g')) AS blanked
                  FROM raw_clinical_notes WHERE note_text IS NOT NULL),
        parts AS (SELECT note_id, note_text, regexp_extract_all(blanked, '\\b({ANY_PHRASE})\\b', 1) AS found,
                         regexp_split_to_array(blanked, '\\b(?:{ANY_PHRASE})\\b') AS gaps FROM texts),
        placed AS (SELECT note_id, note_text, found, gaps, unnest(range(1, len(found) + 1)) AS nth FROM parts),
        spans AS (SELECT note_id, note_text, found[nth] AS phrase, CAST(
                    list_sum(list_transform(gaps[1:nth], lambda g: length(g)))
                    + coalesce(list_sum(list_transform(found[1:nth - 1], lambda f: length(f))), 0) AS INTEGER) AS start FROM placed)
        SELECT note_id, kind, code, substring(note_text, start + 1, length(spans.phrase)) AS mention, start,
               regexp_matches(substring(note_text, start - least(start, {n.LOOK_BACK}) + 1, least(start, {n.LOOK_BACK})), '{n.NEGATION}') AS negated
        FROM spans JOIN known ON known.phrase = spans.phrase""",
    "x5_risk_second_opinion": OPINIONS,
    "x6_risk_agreement": f"""
        SELECT count(*) AS referrals,
               CAST(sum(CASE WHEN contains(second_opinion, trim(rule_based_risk)) THEN 1 ELSE 0 END) AS BIGINT)
                 AS agreeing,
               {r("avg(CASE WHEN contains(second_opinion, trim(rule_based_risk)) THEN 1.0::DOUBLE ELSE 0 END) * 100", 2)}
                 AS agreement_pct FROM ({OPINIONS})""",
    "x7_note_previews": "SELECT note_id, note_type, left(note_text, 200) AS note_preview FROM raw_clinical_notes",
    "x8_nearest_vectors": f"""
        SELECT probe_id, neighbour_id, similarity FROM (
          SELECT p.vec_id AS probe_id, c.vec_id AS neighbour_id,
                 round(list_dot_product(c.embedding::DOUBLE[], p.embedding::DOUBLE[]) /
                       (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) *
                        sqrt(list_dot_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 6) AS similarity
          FROM embeddings c JOIN embeddings p ON c.vec_id <> p.vec_id
          WHERE p.vec_id % 50 = 0)
        QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, neighbour_id) <= 5""",
    "k6_newest_notes": """
        SELECT note_id, note_type, patient_id, strftime(authored_at, '%Y-%m-%d %H:%M:%S.%f') AS authored_at
        FROM (SELECT * FROM raw_clinical_notes WHERE note_text IS NOT NULL
              ORDER BY raw_clinical_notes.authored_at DESC, note_id LIMIT 15)""",
    "v4_note_functions": f"""
        SELECT note_id, CASE WHEN score > 0.2 THEN 'POSITIVE' WHEN score < -0.2 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS tone,
               CAST(len({WORDS('note_text')}) AS INTEGER) AS words FROM ({SENTIMENT})""",
    "f23_risk_case_text": """
        SELECT referral_id, 'LVEF: ' || lvef_percent::VARCHAR || '%, Peak METs: ' || gxt_peak_mets::VARCHAR ||
               ', Diagnosis: ' || qualifying_diagnosis AS case_text FROM fact_rehab_referral""",
}
