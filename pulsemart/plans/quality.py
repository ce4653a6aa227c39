"""Data-quality checks. Each returns a small frame with a test name and, where defined, a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemart.functions.numbers import count_where
from pulsemart.functions.rules import first_match
from pulsemart.sources.lookups import lookup
from pulsemart.sources.store import table_counts

# Minimum rows per table.
TARGETS = {
    "DIM_PATIENT": 500, "FACT_ENCOUNTER": 2000, "FACT_DIAGNOSIS": 3000, "FACT_MEDICATION": 2500,
    "FACT_REHAB_REFERRAL": 200, "FACT_REHAB_SESSION": 4000, "FACT_REHAB_OUTCOME": 400, "RAW_CLAIMS": 1000,
}


def _nulls(column: str) -> Column:
    return F.count(F.when(F.col(column).isNull(), 1))


def _outside(column: str, low: float, high: float) -> Column:
    return F.count(F.when((F.col(column) < low) | (F.col(column) > high), 1))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their share of all rows; the share window runs over the few values."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    whole = F.sum("count").over(Window.partitionBy())
    return counted.withColumn("percentage", F.round(F.col("count") * 100.0 / whole, 2))


def patient_nulls(patients: DataFrame) -> DataFrame:
    verdict = F.when(_nulls("patient_id") == 0, "PASS: No NULL patient_id").otherwise("FAIL: NULL patient_id found")
    return patients.agg(
        F.count("*").alias("total_patients"), _nulls("ssn").alias("null_ssn"), _nulls("date_of_birth").alias("null_dob"),
        _nulls("gender").alias("null_gender"), verdict.alias("quality_check"),
    )


def safety_rate(sessions: DataFrame) -> DataFrame:
    flagged = count_where(F.col("safety_flag"))
    rate = flagged * 100.0 / F.count("*")
    return sessions.agg(
        F.count("*").alias("total_sessions"), flagged.alias("safety_flagged"),
        F.round(rate, 2).alias("pct_safety_flagged"),
        F.when(rate < 10, "PASS: Safety flag rate < 10%").otherwise("CHECK: High safety flag rate")
        .alias("validation_result"),
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, alias: str, fine: str, noun: str) -> DataFrame:
    """Child rows with a key that no parent row has."""
    lost = child.filter(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
    n = F.count("*")
    text = F.concat(F.lit("FAIL: "), n.cast("string"), F.lit(f" {noun}"))
    return lost.agg(n.alias(alias), F.when(n == 0, fine).otherwise(text).alias("validation_result"))


def hemodynamic_ranges(sessions: DataFrame) -> DataFrame:
    bad_peak = _outside("peak_hr", 50, 220)
    return sessions.agg(
        F.count("*").alias("total_sessions"), bad_peak.alias("invalid_peak_hr"),
        _outside("resting_hr", 30, 150).alias("invalid_resting_hr"), _outside("rpe_peak", 6, 20).alias("invalid_rpe"),
        _outside("spo2_min", 70, 100).alias("invalid_spo2"),
        F.when(bad_peak == 0, "PASS: All hemodynamics in valid range").otherwise("CHECK: Some out-of-range values")
        .alias("range_check"),
    )


def drug_class_distribution(medications: DataFrame) -> DataFrame:
    return medications.filter(F.col("drug_class").isNotNull()).groupBy("drug_class").agg(
        F.count("*").alias("count"), F.countDistinct("patient_id").alias("unique_patients")
    )


def outcome_completeness(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("measurement_point").agg(
        F.count("*").alias("total_records"), F.count("six_min_walk_meters").alias("has_6mwt"),
        F.count("peak_mets").alias("has_mets"), F.count("phq9_score").alias("has_phq9"), F.count("bmi").alias("has_bmi"),
    )


def key_checks(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Repeated and missing keys per table: the guarantee that declared keys do not give."""
    parts = []
    for name, (df, key) in tables.items():
        per_key = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        repeated = F.count(F.when(F.col("key").isNotNull() & (F.col("n") > 1), 1))
        missing = F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0))
        verdict = F.when((repeated == 0) & (missing == 0), "PASS").otherwise("FAIL")
        parts.append(per_key.agg(
            F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), repeated.alias("repeated_keys"),
            missing.alias("missing_keys"), verdict.alias("verdict"),
        ))
    return reduce(DataFrame.unionByName, parts)


def total_records(tables: dict[str, DataFrame]) -> DataFrame:
    n = F.sum("row_count")
    return table_counts(tables).agg(
        n.alias("total_records"),
        F.when(n >= 10000, "PASS: Target met (10,000+)").when(n >= 8000, "PARTIAL: Close to target")
        .otherwise("FAIL: Below target").alias("validation_result"),
    )


def target_checks(tables: dict[str, DataFrame]) -> DataFrame:
    name, n = F.col("table_name"), F.col("row_count")
    verdict = first_match(
        [((name == t) & (n >= low), f"PASS: Target {low}") for t, low in TARGETS.items()], "CHECK: Below target"
    )
    return table_counts(tables).select(name, n.alias("record_count"), verdict.alias("target_check"))


def risk_distribution(referrals: DataFrame) -> DataFrame:
    return referrals.groupBy(F.col("computed_risk").alias("risk_category")).agg(
        F.count("*").alias("referral_count"), F.avg("lvef_percent").alias("avg_lvef"),
        F.avg("gxt_peak_mets").alias("avg_peak_mets"),
    )


def encounter_distribution(encounters: DataFrame) -> DataFrame:
    return encounters.groupBy("encounter_type").agg(
        F.count("*").alias("count"), F.avg("length_of_stay_days").alias("avg_los")
    )


def payer_distribution(claims: DataFrame) -> DataFrame:
    """The mean paid amount stays in decimals, so no cent is lost before rounding."""
    mean = F.sum("paid_amount").cast("decimal(28,2)") / F.count("paid_amount").cast("decimal(10,0)")
    return claims.groupBy("payer_name").agg(
        F.count("*").alias("claim_count"), count_where(F.col("claim_status") == "DENIED").alias("denials"),
        F.round(mean, 2).alias("avg_paid"),
    )


def first_sessions(patients: DataFrame, referrals: DataFrame, sessions: DataFrame, limit: int = 15) -> DataFrame:
    return (
        sessions.filter(F.col("session_number") == 1)
        .select("referral_id", "session_id", "session_number", "peak_hr", "rpe_peak", "achieved_hrr_percent",
                "safety_flag")
        .join(referrals.select("referral_id", "patient_id", "qualifying_diagnosis", "computed_risk", "lvef_percent"),
              "referral_id")
        .join(patients.select("patient_id", "first_name", "last_name", "age", "gender"), "patient_id")
        .orderBy(F.asc_nulls_last("lvef_percent"), "session_id")
        .limit(limit)
        .select(
            F.concat("first_name", F.lit(" "), "last_name").alias("patient_name"), "age", "gender",
            "qualifying_diagnosis", "computed_risk", "lvef_percent", "session_number", "peak_hr", "rpe_peak",
            "achieved_hrr_percent", "safety_flag",
        )
    )


def program_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count("*").alias("total_programs"), F.countDistinct("patient_id").alias("unique_patients"),
        F.avg("total_sessions").alias("avg_sessions_per_program"), F.avg("adherence_rate_pct").alias("avg_adherence_pct"),
    )


def comparison_totals(comparison: DataFrame) -> DataFrame:
    return comparison.agg(
        F.count("*").alias("total_comparisons"), F.avg("delta_6mwt").alias("avg_6mwt_improvement"),
        F.avg("delta_mets").alias("avg_mets_improvement"), F.avg("delta_phq9").alias("avg_phq9_change"),
    )


def cohort_by_risk(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("risk_category").agg(
        F.sum("patient_count").alias("total_patients"), F.avg("avg_lvef").alias("avg_lvef"),
        F.avg("avg_peak_mets").alias("avg_mets"),
    )


def latest_cms(cms: DataFrame, months: int = 6) -> DataFrame:
    return cms.orderBy(F.desc("referral_month")).limit(months).select(
        "referral_month", "total_referrals", "enrollment_rate_pct", "completion_rate_pct"
    )


def claims_by_payer(summary: DataFrame, limit: int = 6) -> DataFrame:
    return (
        summary.groupBy("payer_name")
        .agg(
            F.sum("claim_count").alias("total_claims"), F.sum("total_paid").alias("total_paid"),
            F.avg("collection_rate_pct").alias("avg_collection_rate"),
        )
        .orderBy(F.desc("total_paid"))
        .limit(limit)
    )


def platform_health(
    tables: dict[str, DataFrame], roles: DataFrame, recent_queries: DataFrame, tags: DataFrame, marts: list[str]
) -> DataFrame:
    """Expected against actual figures with a status, one row per component.

    Databases are those the recent queries used, tags those assigned, views the ``marts`` that exist.
    """
    views = lookup(roles.sparkSession, [(name,) for name in marts], ["name"])
    def part(component: str, expected: int, df: DataFrame, actual: Column, healthy, otherwise: str, details: str):
        return df.agg(actual.cast("long").alias("actual")).select(
            F.lit(component).alias("component"), F.lit(expected).cast("long").alias("expected"), "actual",
            F.when(healthy(F.col("actual")), "HEALTHY").otherwise(otherwise).alias("status"),
            F.lit(details).alias("details"),
        )

    ours = roles.filter(F.col("name").like("HEALTH_%") & F.col("deleted_on").isNull())
    houses = recent_queries.filter(F.col("warehouse_name").like("HEALTH_%"))
    rows = F.count("*")
    parts = [
        part("01. RBAC Roles", 7, ours, rows, lambda n: n >= 7, "ISSUE", "Custom healthcare roles"),
        part("02. Warehouses", 4, houses, F.countDistinct("warehouse_name"), lambda n: n >= 1, "CHECK",
             "Dedicated warehouses"),
        part("03. Databases", 5, recent_queries.filter(F.col("database_name").like("HEALTH_%")),
             F.countDistinct("database_name"), lambda n: n >= 5, "ISSUE", "Medallion + Governance DBs"),
        part("04. DIM_PATIENT", 500, tables["dim_patient"], rows, lambda n: n >= 400, "CHECK", "Patient demographics"),
        part("05. FACT_ENCOUNTER", 2000, tables["fact_encounter"], rows, lambda n: n >= 1500, "CHECK",
             "Clinical encounters"),
        part("06. FACT_REHAB_SESSION", 4000, tables["fact_rehab_session"], rows, lambda n: n >= 3000, "CHECK",
             "Cardiac rehab sessions"),
        part("07. FACT_DIAGNOSIS", 3000, tables["fact_diagnosis"], rows, lambda n: n >= 2000, "CHECK",
             "ICD diagnoses"),
        part("08. Analytics Views", 6, views, rows, lambda n: n >= 4, "CHECK", "Clinical + reporting views"),
        part("09. Governance Tags", 8, tags, F.countDistinct("tag_name"), lambda n: n >= 6, "CHECK",
             "HIPAA data classification tags"),
        part("10. Data Quality", 0, tables["dim_patient"], count_where(F.col("patient_id").isNull()),
             lambda n: n == 0, "NULL values", "No NULL patient identifiers"),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("component")


def quality_status(patients: DataFrame) -> DataFrame:
    """Certification of each patient row, the input of the row filter by data quality."""
    status = first_match(
        [
            (F.col("patient_id").isNull() | F.col("date_of_birth").isNull(), "QUARANTINED"),
            (F.col("ssn").isNull() | F.col("gender").isNull(), "UNDER_REVIEW"),
            (F.col("load_timestamp") < F.lit("2001-02-01").cast("timestamp_ntz"), "DEPRECATED"),
            (F.col("load_timestamp").isNull(), F.lit(None).cast("string")),
        ],
        "CERTIFIED",
    )
    return patients.withColumn("dq_status", status)
