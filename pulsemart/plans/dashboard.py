"""The dashboard's queries. Second-stage roll-ups stay in the plan as a second aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsemart.functions import dates, rules
from pulsemart.functions.numbers import count_where, percent
from pulsemart.operators.latest import latest_by
from pulsemart.plans import gold


def _rate(condition, places: int):
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100, places)


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One wide row from several one-row aggregates, computed in one job."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row_frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def platform_kpis(t: dict[str, DataFrame], claims: DataFrame) -> DataFrame:
    """Every table is scanned once, whatever the number of figures taken from it."""
    def total(name: str, alias: str) -> DataFrame:
        return t[name].agg(F.count("*").alias(alias))

    return side_by_side(
        t["dim_patient"].filter("is_current").agg(F.count("*").alias("total_patients")),
        t["fact_encounter"].agg(
            F.count("*").alias("total_encounters"),
            _rate(F.col("discharge_status") == "EXPIRED", 2).alias("mortality_pct"),
        ),
        total("fact_rehab_referral", "total_referrals"),
        t["fact_rehab_session"].agg(
            F.count("*").alias("total_sessions"),
            _rate(F.col("safety_flag"), 2).alias("safety_pct"),
            F.countDistinct("patient_id").alias("active_rehab"),
        ),
        total("fact_diagnosis", "total_diagnoses"),
        total("fact_medication", "total_medications"),
        total("fact_lab_result", "total_labs"),
        claims.agg(
            F.count("*").alias("total_claims"), _rate(F.col("claim_status") == "DENIED", 1).alias("denial_pct")
        ),
    )


def daily_sessions(sessions: DataFrame, days: int = 90) -> DataFrame:
    return (
        sessions.groupBy("session_date")
        .agg(
            F.count("*").alias("sessions"),
            F.countDistinct("patient_id").alias("patients"),
            F.round(F.avg("peak_hr"), 1).alias("avg_peak_hr"),
            count_where(F.col("safety_flag")).alias("safety_events"),
        )
        .orderBy(F.desc("session_date"))
        .limit(days)
    )


def counts_by(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.groupBy(F.col(column).alias(alias)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), alias)


def rehab_patient_list(patients: DataFrame, referrals: DataFrame, limit: int = 500) -> DataFrame:
    return (
        patients.filter("is_current")
        .join(referrals, "patient_id", "left_semi")
        .select("patient_id", F.concat("first_name", F.lit(" "), "last_name").alias("patient_name"),
                "age", "gender", "ethnicity")
        .orderBy("patient_id")
        .limit(limit)
    )


def patient_sessions(sessions: DataFrame, patient_id: str) -> DataFrame:
    return (
        sessions.filter(F.col("patient_id") == patient_id)
        .select("session_number", "session_date", "modality", "duration_minutes", "resting_hr", "peak_hr",
                "recovery_hr", "hr_recovery_delta", "rpe_peak", "spo2_min", "achieved_hrr_percent", "safety_flag",
                "resting_bp_systolic", "peak_bp_systolic", "ecg_rhythm")
        .orderBy("session_number")
    )


def patient_outcomes(outcomes: DataFrame, patient_id: str) -> DataFrame:
    return (
        outcomes.filter(F.col("patient_id") == patient_id)
        .select("measurement_point", "six_min_walk_meters", "peak_mets", "dasi_score", "phq9_score", "weight_kg",
                "bmi", "hba1c", "ldl", "hdl", "total_cholesterol", "depression_severity")
        .orderBy("measurement_point")
    )


def patient_referral(referrals: DataFrame, patient_id: str) -> DataFrame:
    """One referral of the patient; the lowest id makes the choice repeatable."""
    return (
        referrals.filter(F.col("patient_id") == patient_id)
        .select("referral_id", "qualifying_diagnosis", "cardiac_event_date", "lvef_percent", "gxt_peak_hr",
                "gxt_peak_mets", "computed_risk", "referral_date", "days_event_to_referral")
        .orderBy("referral_id")
        .limit(1)
    )


def patient_medications(medications: DataFrame, patient_id: str, limit: int = 20) -> DataFrame:
    return (
        medications.filter(F.col("patient_id") == patient_id)
        .orderBy(F.desc("start_date"), "medication_id")
        .limit(limit)
        .select("medication_name", "drug_class", "dosage", "route", "frequency", "start_date")
    )


def patient_diagnoses(diagnoses: DataFrame, patient_id: str, limit: int = 20) -> DataFrame:
    return (
        diagnoses.filter(F.col("patient_id") == patient_id)
        .orderBy(F.desc("diagnosis_date"), "diagnosis_id")
        .limit(limit)
        .select("icd_code", "description", "cardiac_category", "diagnosis_type", "diagnosis_date")
    )


def outcome_deltas(outcomes: DataFrame) -> DataFrame:
    """First baseline against first discharge per patient, with the walk-test verdict.

    A zero or missing reading gives no difference, except for the depression score where
    only a missing one does.
    """
    measures = ["six_min_walk_meters", "peak_mets", "phq9_score", "bmi", "ldl"]

    def first(point: str, prefix: str) -> DataFrame:
        rows = outcomes.filter(F.col("measurement_point") == point)
        return latest_by(rows, "patient_id", [F.col("outcome_id")]).select(
            "patient_id", *[F.col(m).alias(f"{prefix}_{m}") for m in measures]
        )

    def change(name: str):
        before, after = F.col(f"b_{name}"), F.col(f"d_{name}")
        return F.when((before != 0) & (after != 0), after - before)

    walk = change("six_min_walk_meters").cast("long")
    return first("BASELINE", "b").join(first("DISCHARGE", "d"), "patient_id").select(
        "patient_id",
        walk.alias("delta_6mwt"),
        F.round(change("peak_mets"), 1).alias("delta_mets"),
        (F.col("d_phq9_score") - F.col("b_phq9_score")).cast("long").alias("delta_phq9"),
        F.round(change("bmi"), 1).alias("delta_bmi"),
        change("ldl").cast("long").alias("delta_ldl"),
        F.when(walk >= 25, "CLINICALLY SIGNIFICANT").otherwise("Not significant").alias("mcid_assessment"),
    )


def cohort(patients: DataFrame, referrals: DataFrame) -> DataFrame:
    return (
        gold.cardiac_cohort(patients, referrals)
        .withColumn("avg_lvef", F.round("avg_lvef", 1))
        .withColumn("avg_peak_mets", F.round("avg_peak_mets", 1))
    )


def demographics(patients: DataFrame) -> DataFrame:
    return (
        patients.filter("is_current")
        .groupBy("gender", "ethnicity", rules.age_group(F.col("age")).alias("age_group"))
        .agg(F.count("*").alias("patient_count"), F.round(F.avg("age"), 1).alias("avg_age"))
    )


def diagnosis_prevalence(diagnoses: DataFrame, patients: DataFrame) -> DataFrame:
    population = patients.filter("is_current").agg(F.count("*")).scalar()
    return (
        diagnoses.filter(F.col("cardiac_category").isNotNull())
        .groupBy("cardiac_category")
        .agg(F.countDistinct("patient_id").alias("patients"), F.count("*").alias("total_diagnoses"))
        .withColumn("prevalence_pct", F.round(F.col("patients") * 100.0 / population, 1))
        .orderBy(F.desc("patients"), "cardiac_category")
    )


def comorbidity_pairs(diagnoses: DataFrame, above: int = 5, limit: int | None = 20) -> DataFrame:
    """Category pairs that share more than ``above`` patients.

    A patient's diagnoses shrink to the set of distinct categories first (at most eight), and
    pairs come from that small array. The diagnosis rows of a patient are never paired.
    """
    sets = (
        diagnoses.filter(F.col("cardiac_category").isNotNull())
        .groupBy("patient_id", "cardiac_category").agg(F.lit(1))
        .groupBy("patient_id")
        .agg(F.array_sort(F.collect_set("cardiac_category")).alias("categories"))
    )
    pairs = F.flatten(
        F.transform(
            "categories",
            lambda a: F.transform(
                F.filter("categories", lambda b: b > a),
                lambda b: F.struct(a.alias("condition_1"), b.alias("condition_2")),
            ),
        )
    )
    found = (
        sets.select(F.explode(pairs).alias("pair"))
        .groupBy("pair.condition_1", "pair.condition_2")
        .agg(F.count("*").alias("co_occurrence"))
        .filter(F.col("co_occurrence") > above)
        .orderBy(F.desc("co_occurrence"), "condition_1", "condition_2")
    )
    return found if limit is None else found.limit(limit)


def demographic_rollups(demographic_cells: DataFrame) -> DataFrame:
    """Patient totals by age group, gender and ethnicity from the demographic cells."""
    axes = F.array(
        F.struct(F.lit("age_group").alias("axis"), F.col("age_group").alias("value")),
        F.struct(F.lit("gender").alias("axis"), F.col("gender").alias("value")),
        F.struct(F.lit("ethnicity").alias("axis"), F.col("ethnicity").alias("value")),
    )
    return (
        demographic_cells.select(F.explode(axes).alias("a"), "patient_count")
        .filter(F.col("a.value").isNotNull())
        .groupBy("a.axis", "a.value")
        .agg(F.sum("patient_count").alias("patient_count"))
    )


def cohort_by_risk_and_diagnosis(cohort_cells: DataFrame, risks: list[str]) -> DataFrame:
    return (
        cohort_cells.filter(F.col("risk_category").isin(risks))
        .groupBy("risk_category", "qualifying_diagnosis")
        .agg(F.sum("patient_count").alias("patient_count"))
    )


def cohort_totals(cohort_cells: DataFrame, risks: list[str]) -> DataFrame:
    """Headline figures: the means are unweighted over the cohort cells."""
    return cohort_cells.filter(F.col("risk_category").isin(risks)).agg(
        F.sum("patient_count").alias("total_cohort"),
        F.round(F.avg("avg_lvef"), 1).alias("avg_lvef"),
        F.round(F.avg("avg_peak_mets"), 1).alias("avg_peak_mets"),
    )


def cms_metrics(referrals: DataFrame, sessions: DataFrame) -> DataFrame:
    return (
        gold.cms_cardiac_rehab(referrals, sessions)
        .withColumn("avg_days_to_referral", F.round("avg_days_to_referral", 1))
        .drop("completion_rate_pct")
        .orderBy(F.desc("referral_month"))
    )


def adherence_by_risk(referrals: DataFrame, sessions: DataFrame) -> DataFrame:
    """Mean sessions skip referrals without any; the completion rate counts them."""
    n = F.col("total_sessions")
    completed = count_where(n >= gold.PROGRAM_SESSIONS)
    return (
        referrals.join(gold.sessions_per_referral(sessions), "referral_id", "left")
        .groupBy(F.col("computed_risk").alias("risk_category"))
        .agg(
            F.countDistinct("referral_id").alias("total_programs"),
            F.round(F.avg(n), 1).alias("avg_sessions"),
            F.round(F.avg(n) * 100.0 / gold.PROGRAM_SESSIONS, 1).alias("avg_adherence_pct"),
            completed.alias("completed"),
            F.round(completed * 100.0 / F.count("*"), 1).alias("completion_rate"),
        )
    )


def safety_by_modality(sessions: DataFrame) -> DataFrame:
    flagged = count_where(F.col("safety_flag"))
    return (
        sessions.groupBy("modality")
        .agg(
            F.count("*").alias("total_sessions"),
            flagged.alias("safety_events"),
            F.round(flagged * 100.0 / F.count("*"), 2).alias("safety_rate_pct"),
            count_where(F.col("exercise_terminated_early")).alias("early_terminations"),
            F.round(F.avg("ecg_monitor_minutes"), 1).alias("avg_ecg_minutes"),
        )
        .orderBy(F.desc("total_sessions"), "modality")
    )


def outcome_improvement(referrals: DataFrame, outcomes: DataFrame) -> DataFrame:
    met = count_where(F.col("delta_6mwt") >= 25)
    return (
        gold.outcome_comparison(outcomes)
        .join(referrals.select("referral_id", "computed_risk"), "referral_id")
        .groupBy("computed_risk")
        .agg(
            F.round(F.avg("delta_6mwt"), 1).alias("avg_6mwt_change"),
            F.round(F.avg("delta_mets"), 2).alias("avg_mets_change"),
            F.round(F.avg("delta_phq9"), 1).alias("avg_phq9_change"),
            met.alias("mcid_met"),
            F.count("*").alias("total_measured"),
            F.round(met * 100.0 / F.count("*"), 1).alias("mcid_rate"),
        )
    )


def _denied():
    return count_where(F.col("claim_status") == "DENIED")


def claims_by_payer(claims: DataFrame) -> DataFrame:
    return (
        claims.groupBy("payer_name", "claim_type")
        .agg(
            F.count("*").alias("claim_count"),
            F.sum("billed_amount").alias("total_billed"),
            F.sum("allowed_amount").alias("total_allowed"),
            F.sum("paid_amount").alias("total_paid"),
            F.sum("patient_responsibility").alias("total_patient_resp"),
            _denied().alias("denials"),
            F.round(_denied() * 100.0 / F.count("*"), 1).alias("denial_rate"),
            percent(F.sum("paid_amount"), F.sum("billed_amount"), 1).alias("collection_rate"),
        )
        .orderBy(F.desc("total_billed"))
    )


def denial_reasons(claims: DataFrame) -> DataFrame:
    return (
        claims.filter((F.col("claim_status") == "DENIED") & F.col("denial_reason").isNotNull())
        .groupBy("denial_reason", "payer_name")
        .agg(F.count("*").alias("denial_count"), F.sum("billed_amount").alias("denied_amount"))
        .orderBy(F.desc("denial_count"), "denial_reason", "payer_name")
    )


def revenue_summary(claims: DataFrame) -> DataFrame:
    whole = lambda c: F.round(c, 0)
    billed, paid = F.sum("billed_amount"), F.sum("paid_amount")
    return claims.agg(
        whole(billed).alias("total_billed"),
        whole(F.sum("allowed_amount")).alias("total_allowed"),
        whole(paid).alias("total_paid"),
        whole(billed - paid).alias("total_write_off"),
        whole(F.sum("patient_responsibility")).alias("total_patient_resp"),
        F.count("*").alias("total_claims"),
        _denied().alias("total_denials"),
        count_where(F.col("claim_status") == "PAID").alias("total_paid_claims"),
        percent(paid, billed, 1).alias("net_collection_rate"),
    )


def monthly_revenue(claims: DataFrame, months: int = 24) -> DataFrame:
    return (
        claims.filter(F.col("service_date").isNotNull())
        .groupBy(dates.month_of(F.col("service_date")).alias("service_month"))
        .agg(
            F.round(F.sum("billed_amount"), 0).alias("billed"),
            F.round(F.sum("paid_amount"), 0).alias("paid"),
            F.count("*").alias("claims"),
        )
        .orderBy(F.desc("service_month"))
        .limit(months)
    )


def payer_rollup(claims: DataFrame) -> DataFrame:
    return claims_by_payer(claims).groupBy("payer_name").agg(
        F.sum("claim_count").alias("claim_count"),
        F.sum("total_billed").alias("total_billed"),
        F.sum("total_paid").alias("total_paid"),
        F.sum("denials").alias("denials"),
    )


def denial_reason_rollup(claims: DataFrame) -> DataFrame:
    return denial_reasons(claims).groupBy("denial_reason").agg(
        F.sum("denial_count").alias("denial_count"), F.sum("denied_amount").alias("denied_amount")
    )
