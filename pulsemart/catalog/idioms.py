"""One query per scan, expression, join, aggregate, window, sort, set and scalar idiom."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from pulsemart.functions import dates, masks, numbers as num, rules
from pulsemart.operators.latest import latest_by, newest_first
from pulsemart.operators.neighbours import windowed
from pulsemart.operators.sampling import sample
from pulsemart.operators.surrogates import registered
from pulsemart.plans import audit, dashboard as d, features as f, gold, governance, quality, usage
from pulsemart.plans.health import Health
from pulsemart.plans.logs import Logs, recent
from pulsemart.sources import bridge, generators, lookups as L, store
from pulsemart.sources.schemas import schema
from pulsemart.sources.versions import VersionedTable

PATIENT = "PAT-000000000016"
READER = "CLINICIAN_3"
c = F.col


def _logs(h: Health) -> Logs:
    return Logs(h.spark, h.sf_dir)


def _folder(h: Health, name: str) -> str:
    return f"{store.shared_folder(h.spark)}/tables/{name}-{uuid.uuid4().hex}"


def _n(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


# ---- scans, sources, sinks -------------------------------------------------------------------


def typed_scan(h: Health):
    declared = schema("raw_medications")
    path = _folder(h, "raw_medications")
    store.save(store.align(h.raw_medications, declared), path)
    loaded = store.load(h.spark, path, declared)
    return loaded.select("medication_id", "medication_name", "start_date").filter(c("start_date") >= "2000-01-01")


def ctas(h: Health):
    """Builds the table anew over an older version, which stays readable until the new one is complete."""
    table = VersionedTable(h.spark, _folder(h, "fact_encounter"), "encounter_id")
    table.overwrite(h.fact_encounter.where("encounter_type = 'EMERGENCY'"))
    table.overwrite(h.fact_encounter)
    return _n(table.read(), "encounter_type")


def insert_select(h: Health):
    declared = schema("fact_rehab_referral")
    path = _folder(h, "fact_rehab_referral")
    known, high = h.stored("fact_rehab_referral"), c("computed_risk").eqNullSafe(F.lit("HIGH"))
    store.append(known.filter(high), path, declared)
    rest = known.filter(~high).drop("ischemic_threshold")
    table = store.append(rest, path, declared, {"load_timestamp": h.as_of})
    return table.select("referral_id", "computed_risk", "ischemic_threshold", "load_timestamp", "referral_key")


def full_refresh(h: Health):
    """Reloads the table twice; the second load reads what the first has stored."""
    table = VersionedTable(h.spark, _folder(h, "fact_rehab_outcome"), "outcome_id")
    table.overwrite(h.fact_rehab_outcome)
    table.overwrite(table.read())
    table.remove_old()
    return _n(table.read(), "measurement_point")


def named_view(h: Health):
    name = f"v_claims_{uuid.uuid4().hex}"
    store.view(gold.claims_summary(h.raw_claims), name)
    return h.spark.sql(f"SELECT payer_name, count(*) AS n, sum(denials) AS denials FROM {name} GROUP BY payer_name")


def values_lookup(h: Health):
    facts = h.fact_diagnosis.withColumn("dx_code", F.upper("icd_code"))
    joined = facts.join(F.broadcast(L.diagnoses(h.spark)), "dx_code")
    return _n(joined, "dx_code", "dx_name", "lookup_category")


def row_generator(h: Health):
    size = bridge.star(h.spark, h.sf_dir, "customer").count()
    return generators.rows(h.spark, size).select("id", num.uniform(c("id"), 1, 16000, 32000).alias("days"))


def surrogate_keys(h: Health):
    return h.stored("fact_encounter").select("encounter_key", "encounter_id")


def key_registry(h: Health):
    """Numbers of two loads: patients of even customers first, then all of them."""
    registry = VersionedTable(h.spark, _folder(h, "patient_keys"), "patient_id")
    registered(registry, h.dim_patient.where(F.right("patient_id", F.lit(1)).cast("int") % 2 == 0), "patient_id", "patient_key")
    return registered(registry, h.dim_patient, "patient_id", "patient_key")


def versioned_snapshot(h: Health):
    rows = h.fact_rehab_referral.select("referral_id", "computed_risk")
    saved = store.save(store.snapshot(rows, "V1", h.as_of), _folder(h, "training"), ["dataset_version"])
    return _n(saved, "dataset_version", "created_at", "computed_risk")


def register_models(h: Health):
    columns = ["model_id", "model_name", "model_version", "model_type", "task", "target_platform", "training_dataset",
               "description"]
    declared, path = schema("model_catalog"), _folder(h, "model_catalog")
    models = L.lookup(h.spark, L.MODELS, columns)
    table = store.append(models, path, declared, {"status": F.lit("ACTIVE"), "created_at": h.as_of})
    sizes = store.table_counts({"HEALTH_TRANSFORM_DB.MEDICATIONS.FACT_MEDICATION": h.fact_medication})
    return f.catalogue_with_sizes(table, sizes).select("model_id", "status", "created_at", "training_rows")


KEY_COLUMNS = ["patient_id", "ssn", "date_of_birth", "lvef_percent", "gxt_peak_mets", "peak_hr", "resting_hr",
               "rpe_peak", "safety_flag", "achieved_hrr_percent", "six_min_walk_meters", "phq9_score",
               "cardiac_category", "drug_class"]

SCANS = {
    "s1_typed_scan": typed_scan,
    "s2_ctas_overwrite": ctas,
    "s3_insert_select_defaults": insert_select,
    "s4_full_refresh": full_refresh,
    "s5_named_view": named_view,
    "s6_values_lookup": values_lookup,
    "s7_row_generator": row_generator,
    "s8_surrogate_keys": surrogate_keys,
    "s8_key_registry": key_registry,
    "s9_versioned_snapshot": versioned_snapshot,
    "s10_log_scan": lambda h: recent(
        _logs(h).query_history, "start_time", _logs(h).as_of, 30, "DAY", {"warehouse_name": "HEALTH_%"}
    ).select("query_id", "warehouse_name", "start_time"),
    "s11_register_models": register_models,
    "s12_table_counts": lambda h: store.table_counts(h.silver_tables()),
    "s13_column_inventory": lambda h: store.column_inventory(h.silver_tables(), KEY_COLUMNS),
}

# ---- projections, predicates, conditions -----------------------------------------------------


def bound_parameters(h: Health):
    return h.spark.sql(
        "SELECT session_id, session_number, modality FROM {sessions} WHERE patient_id = :patient AND session_number <= :n",
        args={"patient": PATIENT, "n": 20}, sessions=h.fact_rehab_session,
    )


def scalar_projection(h: Health):
    """Every type beside the size of the whole table."""
    whole = h.fact_encounter.agg(F.count("*")).scalar()
    return _n(h.fact_encounter, "encounter_type").withColumn("all_encounters", whole)


def common_tables(h: Health):
    busy = _n(h.fact_encounter, "patient_id").filter(c("n") >= 10)
    oldest = h.dim_patient.filter(c("age") >= 65).select("patient_id", "age")
    return busy.join(oldest, "patient_id")


EXPRESSIONS = {
    "e1_projection_rename_literal": lambda h: h.fact_encounter.select(
        "encounter_id", c("department").alias("unit"), F.lit("EPIC").alias("source")
    ),
    "e2_ordered_case": lambda h: h.raw_diagnoses.select(
        "record_id", "icd_code", rules.icd_category(c("icd_code")).alias("category")
    ),
    "e3_nested_case": lambda h: h.raw_lab_results.select(
        "lab_id",
        rules.lab_flag(c("result_numeric"), c("reference_low"), c("reference_high"), c("abnormal_flag")).alias("flag"),
    ),
    "e4_range_bands": lambda h: h.dim_patient.select("patient_id", rules.age_group(c("age")).alias("age_group")),
    "e5_round_robin": lambda h: h.raw_encounters.select(
        "record_id", num.pick(["RED", "GREEN", "BLUE"], c("record_id")).alias("team")
    ),
    "e6_ilike": lambda h: h.fact_medication.filter(
        rules.any_ilike(c("medication_name"), ["metoprolol%", "%STATIN%"])
    ).select("medication_id", "medication_name"),
    "e7_like_and_not_like": lambda h: _n(
        _logs(h).query_history.filter(c("database_name").like("HEALTH_A%") & ~c("query_type").like("CREATE%")),
        "database_name", "query_type",
    ),
    "e8_in_and_not_in": lambda h: _n(
        h.raw_claims.filter(
            c("payer_name").isin("Medicare", "Aetna") & ~c("denial_reason").isin("CODING_ERROR", "TIMELY_FILING")
        ),
        "payer_name", "denial_reason",
    ),
    "e9_in_subquery": lambda h: h.dim_patient.join(h.fact_rehab_referral, "patient_id", "left_semi").select(
        "patient_id", "gender"
    ),
    "e10_correlated_exists": lambda h: h.dim_patient.join(
        governance.team_patients(h.care_team_assignments, READER), "patient_id", "left_semi"
    ).select("patient_id"),
    "e11_exists_flag": lambda h: h.fact_rehab_session.agg(
        (F.count(F.when(c("spo2_min") < 87.5, 1)) > 0).alias("low_oxygen_seen"),
        (F.count(F.when(c("peak_hr") > 220, 1)) > 0).alias("extreme_rate_seen"),
    ),
    "e12_between": lambda h: h.fact_rehab_referral.filter(c("lvef_percent").between(40, 49)).select(
        "referral_id", "lvef_percent"
    ),
    "e13_null_guards": lambda h: h.fact_rehab_session.filter(
        c("peak_hr").isNull() & c("recovery_hr").isNotNull()
    ).select("session_id", "recovery_hr"),
    "e14_coalesce_defaults": lambda h: h.dim_patient.join(
        f.lab_block(h.fact_lab_result).select("patient_id", "abnormal_lab_ratio"), "patient_id", "left"
    ).select("patient_id", F.coalesce("abnormal_lab_ratio", F.lit(0.0)).alias("abnormal_lab_ratio")),
    "e15_nullif_guard": lambda h: _logs(h).query_history.select(
        "query_id", num.ratio(c("partitions_scanned"), c("partitions_total")).alias("scanned_share")
    ),
    "e16_boolean_predicate": lambda h: h.fact_rehab_session.filter(
        c("safety_flag") | c("exercise_terminated_early")
    ).select("session_id", "safety_flag", "exercise_terminated_early"),
    "e17_casts": lambda h: h.fact_encounter.select(
        "encounter_id", c("length_of_stay_days").cast("double").alias("stay"), c("admit_date").cast("date").alias("day"),
        c("length_of_stay_days").cast("string").alias("stay_text"),
    ),
    "e18_bound_parameters": bound_parameters,
    "e19_scalar_projection": scalar_projection,
    "e20_scalar_filter": lambda h: h.fact_rehab_session.filter(
        c("session_date") == h.fact_rehab_session.agg(F.max("session_date")).scalar()
    ).select("session_id", "session_date"),
    "e21_common_tables": common_tables,
    "e22_all_plus_derived": lambda h: h.raw_vital_signs.withColumn("is_pain", c("vital_type") == "PAIN_SCALE"),
    "e23_quoted_names": lambda h: h.fact_encounter.select(
        c("encounter_id").alias("Encounter Id"), c("department").alias("unit name")
    ).selectExpr("`Encounter Id` AS id", "`unit name` AS unit"),
}

# ---- joins -----------------------------------------------------------------------------------


def six_way(h: Health):
    """Per-user aggregates of five logs beside the users that ran statements."""
    g = _logs(h)
    users = g.query_history.select("user_name").distinct()
    parts = {
        "statements": (g.query_history, "user_name"), "logins": (g.login_history, "user_name"),
        "sessions": (g.sessions, "user_name"), "roles_granted": (g.grants_to_users, "grantee_name"),
        "grants_made": (g.grants_to_roles, "granted_by"),
    }
    for name, (df, key) in parts.items():
        counted = df.groupBy(c(key).alias("user_name")).agg(F.count("*").alias(name))
        users = users.join(counted, "user_name", "left")
    return users.fillna(0)


JOINS = {
    "j1_inner": lambda h: _n(h.fact_encounter.join(h.dim_patient, "patient_id"), "gender", "encounter_type"),
    "j2_left_fan_out": lambda h: h.fact_rehab_referral.join(h.fact_rehab_session, "referral_id", "left")
    .groupBy("referral_id").agg(F.count("*").alias("joined_rows"), F.count("session_id").alias("sessions")),
    "j3_left_pre_aggregated": lambda h: h.fact_rehab_referral.join(
        gold.sessions_per_referral(h.fact_rehab_session), "referral_id", "left"
    ).select("referral_id", "total_sessions"),
    "j4_self_join_roles": lambda h: gold.outcome_comparison(h.fact_rehab_outcome).select(
        "referral_id", "baseline_6mwt", "discharge_6mwt"
    ),
    "j5_unordered_pairs": lambda h: d.comorbidity_pairs(h.fact_diagnosis, above=0, limit=None),
    "j6_predicate_in_on": lambda h: h.fact_encounter.join(
        h.fact_diagnosis.filter(c("diagnosis_type") == "PRIMARY").select("encounter_id", "icd_code"),
        "encounter_id", "left",
    ).select("encounter_id", "icd_code"),
    "j7_star": lambda h: gold.clinical_summary_counts(
        h.fact_encounter, h.dim_patient, h.fact_diagnosis, h.fact_medication, h.fact_rehab_referral,
        h.fact_rehab_session,
    ),
    "j8_composite_key": lambda h: _n(
        audit.masking_policy_usage(_logs(h).policy_references, _logs(h).masking_policies),
        "masking_policy_name", "protection_level",
    ),
    "j9_left_then_not_null": lambda h: _n(
        audit.phi_data_access(_logs(h).query_history, _logs(h).tag_references, _logs(h).as_of), "phi_classification"
    ),
    "j10_anti": lambda h: h.fact_rehab_session.filter(c("referral_id").isNotNull()).join(
        h.fact_rehab_referral, "referral_id", "left_anti"
    ).select("session_id", "referral_id"),
    "j11_semi": lambda h: h.fact_encounter.join(h.fact_rehab_referral, "patient_id", "left_semi").select("encounter_id"),
    "j12_six_way_left": six_way,
    "j13_cyclic_pick": lambda h: L.cyclic_pick(
        bridge.star(h.spark, h.sf_dir, "orders"), L.medications(h.spark), "med_name", c("o_orderkey"),
        len(L.MEDICATIONS),
    ).select("o_orderkey", "med_name"),
    "j14_replicate_rows": lambda h: h.fact_rehab_referral.select(
        "referral_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("copy")
    ),
}

# ---- aggregations ----------------------------------------------------------------------------

AGGREGATES = {
    "g1_group_by_expression": lambda h: _n(h.fact_encounter, F.year("admit_date").alias("admit_year"), "department"),
    "g2_count_rows_and_values": lambda h: h.fact_rehab_outcome.groupBy("measurement_point").agg(
        F.count("*").alias("rows"), F.count("phq9_score").alias("scored")
    ),
    "g3_count_distinct": lambda h: h.fact_diagnosis.groupBy("icd_version").agg(
        F.countDistinct("patient_id").alias("patients")
    ),
    "g4_filtered_distinct": lambda h: h.fact_diagnosis.groupBy("diagnosis_type").agg(
        F.countDistinct(F.when(c("cardiac_category") == "HEART_FAILURE", c("patient_id"))).alias("hf_patients")
    ),
    "g5_several_distincts": lambda h: h.fact_medication.groupBy("route").agg(
        F.countDistinct("patient_id").alias("patients"), F.countDistinct("drug_class").alias("classes"),
        F.countDistinct("prescriber").alias("prescribers"),
    ),
    "g6_sum_avg_min_max": lambda h: h.raw_claims.groupBy("payer_name").agg(
        F.sum("billed_amount").alias("billed"), F.min("paid_amount").alias("least"), F.max("paid_amount").alias("most")
    ),
    "g7_conditional_sum": lambda h: h.fact_rehab_session.groupBy("therapist").agg(
        num.count_where(c("safety_flag")).alias("flagged")
    ),
    "g8_conditional_count": lambda h: h.dim_patient.agg(
        F.count(F.when(c("ssn").isNull(), 1)).alias("null_ssn"), F.count(F.when(c("email").isNull(), 1)).alias("null_email")
    ),
    "g9_boolean_any": lambda h: h.fact_diagnosis.groupBy("patient_id").agg(
        F.bool_or(c("cardiac_category") == "ACUTE_MI").alias("has_mi")
    ),
    "g10_conditional_pivot": lambda h: f.lab_block(h.fact_lab_result).select("patient_id", "latest_ldl", "latest_hdl"),
    "g11_rate": lambda h: h.fact_encounter.groupBy("department").agg(
        F.round(F.avg(F.when(c("discharge_status") == "EXPIRED", 1.0).otherwise(0.0)) * 100, 2).alias("mortality_pct")
    ),
    "g12_guarded_ratio": lambda h: h.raw_claims.groupBy("claim_type").agg(
        num.percent(F.sum("paid_amount"), F.sum("billed_amount"), 1).alias("collection_pct")
    ),
    "g13_sum_of_expression": lambda h: h.raw_claims.groupBy("payer_name").agg(
        F.sum(c("billed_amount") - c("paid_amount")).alias("write_off")
    ),
    "g14_having": lambda h: _n(h.fact_diagnosis, "icd_code").filter(c("n") > 1000),
    "g15_having_without_groups": lambda h: h.fact_encounter.agg(F.count("*").alias("n")).filter(c("n") > 100),
    "g16_global_aggregate": lambda h: h.raw_claims.agg(
        F.count("*").alias("claims"), F.sum("billed_amount").alias("billed"), F.max("service_date").alias("latest")
    ),
    "g17_share_of_total": lambda h: d.diagnosis_prevalence(h.fact_diagnosis, h.dim_patient).select(
        "cardiac_category", "prevalence_pct"
    ),
    "g18_distinct_rows": lambda h: h.fact_medication.select("medication_name", "drug_class").distinct(),
    "g19_group_by_month": lambda h: _n(h.fact_diagnosis, dates.month_of(c("diagnosis_date")).alias("month")),
    "g20_active_days": lambda h: usage.cost_by_month(_logs(h).warehouse_metering_history, _logs(h).as_of).select(
        "warehouse_name", "usage_month", "active_days"
    ),
    "g21_aggregate_of_aggregate": lambda h: gold.cardiac_cohort(h.dim_patient, h.fact_rehab_referral)
    .groupBy("age_group").agg(F.sum("patient_count").alias("patients"), F.max("avg_lvef").alias("best_lvef")),
}

# ---- windows, sorts, sets --------------------------------------------------------------------


def three_row_means(h: Health):
    def columns(window):
        return {"mean_peak_hr": F.avg("peak_hr").over(window.rowsBetween(-2, 0))}

    return windowed(
        h.fact_rehab_session.select("patient_id", "session_number", "session_id", "peak_hr"),
        "patient_id", ["session_number", "session_id"], 2, columns, sized_by=h.raw_rehab_sessions,
    )


def change_to_previous(h: Health):
    return windowed(
        h.fact_encounter.select("patient_id", "encounter_id", "admit_date", "length_of_stay_days"),
        "patient_id", ["admit_date", "encounter_id"], 1,
        lambda w: {"stay_change": c("length_of_stay_days") - F.lag("length_of_stay_days").over(w)},
        sized_by=h.raw_encounters,
    ).select("encounter_id", "stay_change")


def daily_growth(h: Health):
    """Growth day on day; one row per day, so a single ordered window is small."""
    before = F.lag("storage_bytes").over(Window.orderBy("usage_date"))
    return _logs(h).storage_usage.select("usage_date", "storage_bytes", before.alias("before")).filter(
        (c("before") > 0) & ((c("storage_bytes") - c("before")) / c("before") > 0.1)
    ).select("usage_date", "storage_bytes")


def share_of_group(h: Health):
    counted = _n(h.fact_medication, "route", "drug_class")
    whole = F.sum("n").over(Window.partitionBy("route"))
    return counted.withColumn("share", F.round(c("n") * 100.0 / whole, 2))


def indexed_lookup_usage(h: Health):
    ranked = L.indexed(L.diagnoses(h.spark), "dx_code").select("dx_code", "rn")
    used = _n(h.fact_diagnosis.withColumn("dx_code", F.upper("icd_code")), "dx_code")
    return used.join(F.broadcast(ranked), "dx_code")


def labelled_totals(h: Health):
    return store.table_counts({"patients": h.dim_patient, "claims": h.raw_claims, "notes": h.raw_clinical_notes})


ORDERED = {
    "w1_latest_row": lambda h: latest_by(
        h.raw_diagnoses, "diagnosis_id", newest_first("load_timestamp", "record_id")
    ).select("diagnosis_id", "record_id"),
    "w2_latest_encounter": lambda h: f.latest_encounter(h.fact_encounter),
    "w3_rolling_mean": three_row_means,
    "w4_change_to_previous": change_to_previous,
    "w5_daily_growth": daily_growth,
    "w6_share_of_group": share_of_group,
    "w7_share_of_total": lambda h: quality.distribution(h.fact_encounter, "department"),
    "w8_indexed_lookup": indexed_lookup_usage,
    "k1_mixed_order": lambda h: h.fact_rehab_referral.orderBy(F.desc("referral_date"), "referral_id").select(
        "referral_id", "referral_date"
    ),
    "k2_top_k": lambda h: _n(h.fact_diagnosis, "icd_code").orderBy(F.desc("n"), "icd_code").limit(10),
    "k3_nulls_last": lambda h: h.fact_rehab_outcome.orderBy(F.desc_nulls_last("phq9_score"), "outcome_id")
    .select("outcome_id", "phq9_score"),
    "k5_scattered_sample": lambda h: sample(
        bridge.star(h.spark, h.sf_dir, "customer"), c("c_custkey"), 10
    ).select("c_custkey", "c_name"),
    "u1_labelled_union": labelled_totals,
    "u2_two_sources_one_shape": lambda h: _n(
        audit.role_grant_history(_logs(h).grants_to_users, _logs(h).grants_to_roles, _logs(h).as_of),
        "grant_type", "sensitivity_level",
    ),
    "u3_stacked_points": lambda h: _n(
        h.fact_rehab_outcome.filter(c("measurement_point") == "BASELINE").unionByName(
            h.fact_rehab_outcome.filter(c("measurement_point") == "DISCHARGE")
        ),
        "measurement_point", "depression_severity",
    ),
}

# ---- scalar functions ------------------------------------------------------------------------

SCALARS = {
    "f1_case_and_trim": lambda h: h.raw_patients.select(
        "record_id", F.upper(F.trim("first_name")).alias("first_name"), F.lower(F.trim("email")).alias("email")
    ),
    "f2_concat": lambda h: h.dim_patient.select(
        "patient_id", F.concat("first_name", F.lit(" "), "last_name", F.lit("/"), "gender").alias("label")
    ),
    "f3_left_right_substr": lambda h: h.dim_patient.select(
        "patient_id", F.left("last_name", F.lit(2)).alias("head"), F.right("ssn", F.lit(4)).alias("tail"),
        F.substring("address", 2, 3).alias("middle"),
    ),
    "f4_length_repeat_contains": lambda h: h.dim_patient.select(
        "patient_id", F.length("email").alias("size"), F.repeat(F.lit("*"), F.length("last_name")).alias("stars"),
        F.contains("email", F.lit("@")).alias("is_email"),
    ),
    "f5_zero_padding": lambda h: bridge.star(h.spark, h.sf_dir, "orders").select(
        "o_orderkey", F.lpad(c("o_orderkey").cast("string"), 8, "0").alias("padded"),
        F.lpad(c("o_orderkey").cast("string"), 2, "0").alias("cut"),
    ),
    "f6_first_match": lambda h: h.fact_medication.select(
        "medication_id", F.regexp_substr("medication_name", F.lit("[0-9]+[a-zA-Z]+")).alias("dose")
    ),
    "f7_array_text": lambda h: _logs(h).access_history.filter(
        F.array_join("direct_objects_accessed", ",").ilike("%patient%")
    ).select("query_id", F.array_join("direct_objects_accessed", ",").alias("objects")),
    "f8_round": lambda h: h.raw_lab_results.select(
        "lab_id", F.round(c("result_numeric") / 3, 1).alias("third"), F.round("result_numeric", 0).alias("whole")
    ),
    "f9_power_floor_abs_mod": lambda h: h.fact_encounter.select(
        "encounter_id", F.pow(c("length_of_stay_days"), 2).alias("squared"),
        F.floor(c("length_of_stay_days") / 7).alias("weeks"), F.abs(c("length_of_stay_days") - 5).alias("distance"),
        (c("length_of_stay_days") % 3).alias("rest"),
    ),
    "f10_integer_division": lambda h: _logs(h).query_history.select(
        "query_id", (c("total_elapsed_time") / 1000).alias("seconds")
    ),
    "f11_days_between": lambda h: h.fact_encounter.select(
        "encounter_id", dates.days_between(c("admit_date"), c("discharge_date")).alias("days")
    ),
    "f12_weeks_between": lambda h: h.fact_medication.select(
        "medication_id", dates.weeks_between(c("start_date"), c("end_date")).alias("weeks")
    ),
    "f13_years_between": lambda h: h.dim_patient.select(
        "patient_id", dates.years_between(c("date_of_birth"), h.as_of).alias("years")
    ),
    "f14_hours_between": lambda h: _logs(h).sessions.select(
        "session_id", dates.hours_between(c("created_on"), _logs(h).as_of).alias("hours")
    ),
    "f15_date_add": lambda h: h.fact_rehab_referral.select(
        "referral_id", F.date_add("referral_date", 30).alias("plus_days"),
        F.add_months("referral_date", -1).alias("minus_month"),
        (c("referral_date").cast("timestamp_ntz") + F.expr("INTERVAL 7 YEARS")).cast("date").alias("plus_years"),
    ),
    "f16_truncate": lambda h: _logs(h).login_history.select(
        "event_id", dates.month_of(c("event_timestamp")).alias("month"), dates.day_of(c("event_timestamp")).alias("day"),
        dates.hour_of(c("event_timestamp")).alias("hour"),
    ),
    "f17_date_parts": lambda h: h.dim_patient.select(
        "patient_id", F.make_date(F.year("date_of_birth"), F.lit(1), F.lit(1)).alias("first_of_year")
    ),
    "f18_explicit_today": lambda h: _n(
        h.fact_medication.filter(c("end_date") >= F.to_date(h.as_of) - F.expr("INTERVAL 6 MONTHS")), "drug_class"
    ),
    "f19_explicit_role": lambda h: governance.filter_by_care_team(
        h.dim_patient, h.care_team_assignments, "HEALTH_READONLY", "CLINICIAN_5"
    ).select("patient_id"),
    "f20_hash_spread": lambda h: bridge.star(h.spark, h.sf_dir, "events").select(
        "event_id", num.mix(c("event_id"), 5, 10000).alias("spread")
    ),
    "f21_uniform": lambda h: bridge.star(h.spark, h.sf_dir, "events").select(
        "event_id", num.uniform(c("event_id"), 9, 10, 99).alias("drawn")
    ),
    "f22_unit_conversion": lambda h: _logs(h).data_transfer_history.groupBy("transfer_type").agg(
        F.round(num.gigabytes(F.sum("bytes_transferred")), 4).alias("gb"),
        F.round(num.terabytes(F.sum("bytes_transferred")), 6).alias("tb"),
    ),
    "v1_scalar_policy": lambda h: h.dim_patient.select(
        "patient_id", masks.mask_ssn(c("ssn"), "HEALTH_ANALYST").alias("ssn"),
        masks.mask_phone_email(c("phone"), "HEALTH_READONLY").alias("phone"),
    ),
    "v2_boolean_policy": lambda h: quality.quality_status(h.dim_patient).select(
        "patient_id", masks.may_read_quality(c("dq_status"), "HEALTH_ML_ENGINEER").alias("may_read")
    ),
    "v3_replicating_generator": lambda h: _n(
        generators.sessions(bridge.star(h.spark, h.sf_dir, "customer").select(c("c_custkey").alias("id")), h.as_of, 4),
        "modality",
    ),
}

QUERIES = {**SCANS, **EXPRESSIONS, **JOINS, **AGGREGATES, **ORDERED, **SCALARS}
