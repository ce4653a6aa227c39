"""Gold marts. Sorting is left to the reader of a mart; no mart sorts its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions import dates, rules
from pulsemart.functions.numbers import count_where, percent

PROGRAM_SESSIONS = 36  # sessions of a complete program


def sessions_per_referral(sessions: DataFrame) -> DataFrame:
    """Session count per referral: combined on the map side, so a hot referral costs one row per task."""
    return sessions.filter(F.col("referral_id").isNotNull()).groupBy("referral_id").agg(
        F.count("*").alias("total_sessions")
    )


def rehab_program_summary(referrals: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per referral. Sessions are aggregated first, so the join is one to one."""
    per_referral = sessions.groupBy("referral_id").agg(
        F.count("session_id").alias("n"),
        F.min("session_date").alias("first_session_date"),
        F.max("session_date").alias("last_session_date"),
        F.avg("duration_minutes").alias("avg_duration_min"),
        F.avg("achieved_hrr_percent").alias("avg_hrr_percent"),
        F.avg("rpe_peak").alias("avg_rpe"),
        count_where(F.col("safety_flag")).alias("flags"),
        count_where(F.col("exercise_terminated_early")).alias("stops"),
    )
    total = F.coalesce("n", F.lit(0))
    return referrals.join(per_referral, "referral_id", "left").select(
        "patient_id",
        "referral_id",
        "qualifying_diagnosis",
        F.col("computed_risk").alias("risk_category"),
        "lvef_percent",
        "referral_date",
        "days_event_to_referral",
        total.alias("total_sessions"),
        "first_session_date",
        "last_session_date",
        dates.weeks_between(F.col("first_session_date"), F.col("last_session_date")).alias("program_weeks"),
        "avg_duration_min",
        "avg_hrr_percent",
        "avg_rpe",
        F.coalesce("flags", F.lit(0)).alias("safety_flag_count"),
        F.coalesce("stops", F.lit(0)).alias("early_terminations"),
        F.round(total.cast("double") / PROGRAM_SESSIONS * 100, 1).alias("adherence_rate_pct"),
    )


def outcome_comparison(outcomes: DataFrame) -> DataFrame:
    """Baseline against discharge of the same referral; several baselines give several rows."""
    def point(name: str, prefix: str) -> DataFrame:
        return outcomes.filter(F.col("measurement_point") == name).select(
            "referral_id",
            F.col("patient_id").alias(f"{prefix}_patient"),
            F.col("six_min_walk_meters").alias(f"{prefix}_6mwt"),
            F.col("peak_mets").alias(f"{prefix}_mets"),
            F.col("phq9_score").alias(f"{prefix}_phq9"),
            F.col("bmi").alias(f"{prefix}_bmi"),
            F.col("ldl").alias(f"{prefix}_ldl"),
            F.col("hba1c").alias(f"{prefix}_hba1c"),
        )

    def change(name: str):
        return F.col(f"discharge_{name}") - F.col(f"baseline_{name}")

    pairs = point("BASELINE", "baseline").join(point("DISCHARGE", "discharge"), "referral_id")
    return pairs.select(
        F.col("baseline_patient").alias("patient_id"),
        "referral_id",
        "baseline_6mwt",
        "discharge_6mwt",
        change("6mwt").alias("delta_6mwt"),
        rules.walk_significance(change("6mwt")).alias("mcid_6mwt"),
        "baseline_mets",
        "discharge_mets",
        change("mets").alias("delta_mets"),
        "baseline_phq9",
        "discharge_phq9",
        change("phq9").alias("delta_phq9"),
        "baseline_bmi",
        "discharge_bmi",
        "baseline_ldl",
        "discharge_ldl",
        "baseline_hba1c",
        "discharge_hba1c",
    )


def cardiac_cohort(patients: DataFrame, referrals: DataFrame) -> DataFrame:
    return (
        patients.select("patient_id", "gender", "ethnicity", rules.age_group(F.col("age")).alias("age_group"))
        .join(referrals, "patient_id")
        .groupBy("gender", "ethnicity", "age_group", F.col("computed_risk").alias("risk_category"),
                 "qualifying_diagnosis")
        .agg(
            F.countDistinct("patient_id").alias("patient_count"),
            F.avg("lvef_percent").alias("avg_lvef"),
            F.avg("gxt_peak_mets").alias("avg_peak_mets"),
        )
    )


def daily_session_metrics(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("session_date").agg(
        F.count("*").alias("sessions_conducted"),
        F.countDistinct("patient_id").alias("unique_patients"),
        F.avg("duration_minutes").alias("avg_duration"),
        F.avg("peak_hr").alias("avg_peak_hr"),
        F.avg("rpe_peak").alias("avg_rpe"),
        count_where(F.col("safety_flag")).alias("safety_incidents"),
        F.sum("ecg_monitor_minutes").alias("total_ecg_minutes"),
    )


def cms_cardiac_rehab(referrals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Monthly enrolment and completion.

    The mean wait is weighted by the sessions of each referral (a referral without sessions
    counts once), which is what averaging over the joined rows means. The weights come from
    the per-referral counts, so the session rows are never joined.
    """
    n, days = F.col("total_sessions"), F.col("days_event_to_referral")
    weight = F.when(days.isNotNull(), F.coalesce(n, F.lit(1)))
    enrolled, completed = F.count(n), count_where(n >= PROGRAM_SESSIONS)
    return (
        referrals.join(sessions_per_referral(sessions), "referral_id", "left")
        .groupBy(dates.month_of(F.col("referral_date")).alias("referral_month"))
        .agg(
            F.count("referral_id").alias("total_referrals"),
            enrolled.alias("referrals_with_sessions"),
            percent(enrolled, F.count("referral_id"), 1).alias("enrollment_rate_pct"),
            (F.sum(days * weight) / F.sum(weight)).alias("avg_days_to_referral"),
            completed.alias("completed_programs"),
            percent(completed, enrolled, 1).alias("completion_rate_pct"),
        )
    )


def claims_summary(claims: DataFrame) -> DataFrame:
    return claims.groupBy(
        dates.month_of(F.col("service_date")).alias("service_month"), "payer_name", "claim_type"
    ).agg(
        F.count("*").alias("claim_count"),
        F.sum("billed_amount").alias("total_billed"),
        F.sum("allowed_amount").alias("total_allowed"),
        F.sum("paid_amount").alias("total_paid"),
        F.sum(F.col("billed_amount") - F.col("paid_amount")).alias("total_write_off"),
        percent(F.sum("paid_amount"), F.sum("billed_amount"), 1).alias("collection_rate_pct"),
        count_where(F.col("claim_status") == "DENIED").alias("denials"),
    )


def patient_hemodynamic_trend(sessions: DataFrame) -> DataFrame:
    def pressure(name: str):
        return F.concat(F.col(f"{name}_bp_systolic").cast("string"), F.lit("/"),
                        F.col(f"{name}_bp_diastolic").cast("string")).alias(f"{name}_bp")

    return sessions.select(
        "patient_id", "session_number", "session_date", "modality", "resting_hr", "peak_hr", "recovery_hr",
        "hr_recovery_delta", pressure("resting"), pressure("peak"), "rpe_peak", "achieved_hrr_percent",
        "spo2_min", "ecg_rhythm", "safety_flag", "duration_minutes",
    )


SUMMARY_COLUMNS = [
    "encounter_id", "patient_id", "patient_name", "age", "gender", "ethnicity", "encounter_type",
    "department", "attending_provider", "admit_date", "discharge_date", "length_of_stay_days",
    "discharge_status", "icd_code", "diagnosis_description", "cardiac_category", "medication_name",
    "drug_class", "rehab_qualifying_dx", "rehab_risk_category", "lvef_percent", "latest_rehab_session",
    "achieved_hrr_percent", "rehab_safety_flag",
]


def _summary_parts(
    patients: DataFrame, diagnoses: DataFrame, medications: DataFrame, referrals: DataFrame, sessions: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What the clinical summary takes from each table beside the encounters."""
    people = patients.filter("is_current").select(
        "patient_id",
        F.concat("first_name", F.lit(" "), "last_name").alias("patient_name"),
        "age", "gender", "ethnicity",
    )
    primary = diagnoses.filter(F.col("diagnosis_type") == "PRIMARY").select(
        "encounter_id", "icd_code", F.col("description").alias("diagnosis_description"), "cardiac_category"
    )
    drugs = medications.select("encounter_id", "medication_name", "drug_class")
    rehab = referrals.select(
        "patient_id", "referral_id",
        F.col("qualifying_diagnosis").alias("rehab_qualifying_dx"),
        F.col("computed_risk").alias("rehab_risk_category"), "lvef_percent",
    )
    exercise = sessions.select(
        "referral_id", F.col("session_number").alias("latest_rehab_session"), "achieved_hrr_percent",
        F.col("safety_flag").alias("rehab_safety_flag"),
    )
    return people, primary, drugs, rehab, exercise


def clinical_summary(
    encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame,
    referrals: DataFrame, sessions: DataFrame,
) -> DataFrame:
    """Encounter joined with patient, primary diagnosis, medications, referrals and all sessions.

    The fan-out (encounters times sessions of a patient) is part of the view, so read it for few
    encounters; for totals use the digest or the counts below, which do not make its rows.
    """
    people, primary, drugs, rehab, exercise = _summary_parts(patients, diagnoses, medications, referrals, sessions)
    return (
        encounters.join(people, "patient_id")
        .join(primary, "encounter_id", "left")
        .join(drugs, "encounter_id", "left")
        .join(rehab, "patient_id", "left")
        .join(exercise, "referral_id", "left")
        .select(*SUMMARY_COLUMNS)
    )


def row_digest(columns: list[str], types: dict[str, str]) -> Column:
    """A 32-bit number from all columns of a row: sums of it do not depend on the order of rows.

    Numbers that are not whole count in thousandths, times in seconds, unset values as nothing between two bars.
    """
    def text(name: str) -> Column:
        kind, value = types[name], F.col(name)
        if kind in ("double", "float"):
            value = F.round(value * 1000).cast("long")
        elif kind.startswith("timestamp"):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return F.coalesce(value.cast("string"), F.lit(""))

    return F.conv(F.left(F.md5(F.concat_ws("|", *[text(c) for c in columns])), F.lit(8)), 16, 10).cast("long")


def clinical_summary_checksums(
    encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame,
    referrals: DataFrame, sessions: DataFrame,
) -> DataFrame:
    """Per encounter: the rows of the clinical summary and the sum of the digests of all their columns.

    Every row of the view is made, but none is exchanged: an encounter travels once, to its patient, with its primary
    diagnoses and medications as two lists, and meets there the sessions of the patient's referrals, joined before;
    where a patient has very many, adaptive execution splits both sides.
    """
    people, primary, drugs, rehab, exercise = _summary_parts(patients, diagnoses, medications, referrals, sessions)

    def listed(branch: DataFrame, name: str) -> DataFrame:
        row = F.struct(*[c for c in branch.columns if c != "encounter_id"])
        return branch.filter("encounter_id is not null").groupBy("encounter_id").agg(F.collect_list(row).alias(name))

    whole = (
        encounters.join(listed(primary, "primary"), "encounter_id", "left")
        .join(listed(drugs, "drugs"), "encounter_id", "left")
        .join(people, "patient_id")
        .join(rehab.join(exercise, "referral_id", "left"), "patient_id", "left")
    )
    for name in ("primary", "drugs"):
        whole = whole.select(*[c for c in whole.columns if c != name], F.inline_outer(name))
    view = whole.select(*SUMMARY_COLUMNS)
    digest = row_digest(view.columns, dict(view.dtypes))
    return view.select("encounter_id", "patient_id", digest.alias("digest")).groupBy("encounter_id", "patient_id").agg(
        F.count("*").alias("summary_rows"), F.sum("digest").alias("row_digests")
    )


def _encounter_branches(encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame):
    """Encounters of current patients with the size of their diagnosis and medication branch."""
    people = patients.filter("is_current").select(
        "patient_id", F.concat("first_name", F.lit(" "), "last_name").alias("patient_name"), "age"
    )
    primary = diagnoses.filter(F.col("diagnosis_type") == "PRIMARY").groupBy("encounter_id").agg(
        F.count("*").alias("n_dx"), F.count("icd_code").alias("n_icd"), F.max("cardiac_category").alias("cardiac_category")
    )
    drugs = medications.groupBy("encounter_id").agg(
        F.count("*").alias("n_med"), F.count("medication_name").alias("n_name"), F.min("drug_class").alias("drug_class")
    )
    return (
        encounters.join(people, "patient_id")
        .join(primary, "encounter_id", "left")
        .join(drugs, "encounter_id", "left")
        .withColumn("dx_rows", F.coalesce("n_dx", F.lit(1)))
        .withColumn("med_rows", F.coalesce("n_med", F.lit(1)))
    )


def _rehab_branches(referrals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per patient and risk: how many rows referrals with their sessions contribute, and their totals."""
    per_referral = sessions.filter(F.col("referral_id").isNotNull()).groupBy("referral_id").agg(
        F.count("*").alias("n_s"), F.sum("session_number").alias("numbers"), F.max("achieved_hrr_percent").alias("hrr"),
        count_where(F.col("safety_flag")).alias("flags"),
    )
    return referrals.join(per_referral, "referral_id", "left").groupBy(
        "patient_id", F.col("computed_risk").alias("rehab_risk_category")
    ).agg(
        F.sum(F.coalesce("n_s", F.lit(1))).alias("rehab_rows"), F.sum("numbers").alias("numbers"),
        F.max("hrr").alias("hrr"), F.sum("flags").alias("flags"), F.max("lvef_percent").alias("lvef_percent"),
    )


def clinical_summary_digest(
    encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame,
    referrals: DataFrame, sessions: DataFrame,
) -> DataFrame:
    """Per encounter: size and content totals of the clinical summary.

    The branches of the star are independent given encounter and patient, so the totals are
    products of branch counts. The summary's rows, encounters times sessions of a patient, are
    never made.
    """
    rehab = _rehab_branches(referrals, sessions).groupBy("patient_id").agg(
        F.sum("rehab_rows").alias("rehab_rows"), F.sum("numbers").alias("numbers"), F.max("hrr").alias("hrr"),
        F.sum("flags").alias("flags"), F.min("rehab_risk_category").alias("rehab_risk_category"),
        F.max("lvef_percent").alias("lvef_percent"),
    )
    joined = _encounter_branches(encounters, patients, diagnoses, medications).join(rehab, "patient_id", "left")
    dx, med, rows = F.col("dx_rows"), F.col("med_rows"), F.coalesce("rehab_rows", F.lit(1))
    return joined.select(
        "encounter_id", "patient_id", "patient_name",
        (dx * med * rows).alias("summary_rows"),
        "age", "length_of_stay_days",
        (F.coalesce("n_icd", F.lit(0)) * med * rows).alias("diagnosis_rows"), "cardiac_category",
        (F.coalesce("n_name", F.lit(0)) * dx * rows).alias("medication_rows"), "drug_class",
        "rehab_risk_category", "lvef_percent",
        (F.col("numbers") * dx * med).alias("session_number_sum"),
        F.col("hrr").alias("max_hrr_percent"),
        (F.coalesce("flags", F.lit(0)) * dx * med).alias("flagged_rows"),
    )


def clinical_summary_counts(
    encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame,
    referrals: DataFrame, sessions: DataFrame,
) -> DataFrame:
    """Rows of the clinical summary per encounter type and risk, from branch counts."""
    rehab = _rehab_branches(referrals, sessions).select("patient_id", "rehab_risk_category", "rehab_rows")
    rows = F.col("dx_rows") * F.col("med_rows") * F.coalesce("rehab_rows", F.lit(1))
    return (
        _encounter_branches(encounters, patients, diagnoses, medications)
        .join(rehab, "patient_id", "left")
        .groupBy("encounter_type", "rehab_risk_category")
        .agg(F.sum(rows).alias("n"))
    )


def clinical_summary_sample(
    encounters: DataFrame, patients: DataFrame, diagnoses: DataFrame, medications: DataFrame,
    referrals: DataFrame, sessions: DataFrame, limit: int = 20,
) -> DataFrame:
    """The first rows of the clinical summary in encounter order.

    Every encounter of a current patient gives at least one row, so the first ``limit`` rows
    come from the first ``limit`` such encounters; only those are joined further.
    """
    current = patients.filter("is_current")
    first = encounters.join(current.select("patient_id"), "patient_id", "left_semi").orderBy("encounter_id").limit(limit)
    summary = clinical_summary(first, current, diagnoses, medications, referrals, sessions)
    return summary.orderBy(
        "encounter_id", "icd_code", "medication_name", "rehab_qualifying_dx", "latest_rehab_session"
    ).limit(limit)


def diagnosis_category_counts(diagnoses: DataFrame) -> DataFrame:
    return diagnoses.filter(F.col("cardiac_category").isNotNull()).groupBy("cardiac_category").agg(
        F.count("*").alias("num_diagnoses"), F.countDistinct("patient_id").alias("unique_patients")
    )
