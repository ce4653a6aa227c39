"""Deterministic synthetic health tables.

Each generator turns a frame of integer ids (column ``id``) into rows with arithmetic on the
id only, so any id range can be produced in parallel and again with the same result. Use
``rows(spark, n)`` for a range, or the ids of an existing table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.functions.numbers import mix, padded, pick, uniform
from pulsemart.sources import lookups as L

PATIENTS, ENCOUNTERS, REFERRALS = 5000, 15000, 2000


def rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def _id() -> Column:
    return F.col("id")


def _patient(modulus: int = PATIENTS) -> Column:
    return padded("PAT-", _id() % modulus, 6)


def _encounter() -> Column:
    return padded("ENC-", _id() % ENCOUNTERS, 8)


def _days_back(as_of: Column, salt: int, low: int, high: int) -> Column:
    return F.date_sub(F.to_date(as_of), uniform(_id(), salt, low, high).cast("int"))


def _minutes_back(as_of: Column, salt: int, high: int) -> Column:
    return as_of - F.make_dt_interval(mins=uniform(_id(), salt, 1, high).cast("int"))


def _tenths(salt: int, low: int, high: int) -> Column:
    """Value with one decimal between low/10 and high/10."""
    return uniform(_id(), salt, low, high) / 10


def _text(salt: int, low: int, high: int) -> Column:
    return uniform(_id(), salt, low, high).cast("string")


def patients(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    return ids.select(
        padded("PAT-", i, 6).alias("patient_id"),
        pick(L.FIRST_NAMES, i).alias("first_name"),
        pick(L.LAST_NAMES, F.floor(i / 20)).alias("last_name"),
        _days_back(as_of, 1, 16000, 32000).alias("date_of_birth"),
        uniform(i, 2, 44, 88).alias("age"),
        F.when((i % 20).isin(L.MALE_POSITIONS), "M").otherwise("F").alias("gender"),
        pick(L.ETHNICITIES, i).alias("ethnicity"),
        F.concat_ws("-", _text(3, 100, 999), _text(4, 10, 99), _text(5, 1000, 9999)).alias("ssn"),
        F.concat(_text(6, 100, 9999), F.lit(" "), pick(L.STREETS, i)).alias("address"),
        F.concat(F.lit("("), _text(7, 200, 999), F.lit(") 555-"), _text(8, 1000, 9999)).alias("phone"),
        F.concat(F.lit("patient"), i.cast("string"), F.lit("@email.com")).alias("email"),
        F.concat(F.lit("INS-"), _text(9, 10000, 99999)).alias("insurance_id"),
        pick(L.LANGUAGES, i).alias("primary_language"),
        pick(L.MARITAL, i).alias("marital_status"),
        F.lit(True).alias("is_current"),
    )


def encounters(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    stay = uniform(i, 12, 1, 14)
    admitted = F.date_sub(F.to_date(as_of), uniform(i, 11, 1, 1095).cast("int"))
    return ids.select(
        padded("ENC-", i, 8).alias("encounter_id"), _patient().alias("patient_id"),
        pick(L.ENCOUNTER_TYPES, i).alias("encounter_type"), admitted.alias("admit_date"),
        F.date_add(admitted, stay.cast("int")).alias("discharge_date"), stay.alias("length_of_stay_days"),
        pick(L.DEPARTMENTS, i).alias("department"), pick(L.PROVIDERS, i).alias("attending_provider"),
        pick(L.FACILITIES, i).alias("facility_code"), pick(L.ADMIT_CODES, i).alias("admit_diagnosis_code"),
        F.when(i % 20 == 0, "EXPIRED").when(i % 15 == 0, "TRANSFERRED").otherwise("DISCHARGED_HOME")
        .alias("discharge_status"),
    )


def diagnoses(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    return L.cyclic_pick(ids, L.diagnoses(ids.sparkSession), "dx_code", i, len(L.DIAGNOSES)).select(
        padded("DX-", i, 8).alias("diagnosis_id"), _encounter().alias("encounter_id"), _patient().alias("patient_id"),
        F.col("dx_code").alias("icd_code"), F.lit("10").alias("icd_version"), F.col("dx_name").alias("description"),
        pick(L.DIAGNOSIS_TYPES, i).alias("diagnosis_type"), _days_back(as_of, 21, 1, 1095).alias("diagnosis_date"),
        F.col("lookup_category").alias("cardiac_category"),
    )


def medications(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    return L.cyclic_pick(ids, L.medications(ids.sparkSession), "med_name", i, len(L.MEDICATIONS)).select(
        padded("MED-", i, 8).alias("medication_id"), _encounter().alias("encounter_id"), _patient().alias("patient_id"),
        F.lpad(_text(31, 10000, 99999), 11, "0").alias("ndc_code"), F.col("med_name").alias("medication_name"),
        F.regexp_substr("med_name", F.lit("[0-9]+[a-zA-Z]+")).alias("dosage"), pick(L.ROUTES, i).alias("route"),
        pick(L.FREQUENCIES, i).alias("frequency"), pick(L.PROVIDERS, i).alias("prescriber"),
        _days_back(as_of, 32, 30, 730).alias("start_date"),
        F.date_add(F.to_date(as_of), uniform(i, 33, 30, 365).cast("int")).alias("end_date"),
        F.col("lookup_class").alias("drug_class"),
    )


def referrals(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    return ids.select(
        padded("REF-", i, 6).alias("referral_id"), _patient().alias("patient_id"),
        pick(L.PROVIDERS, i).alias("referring_physician"), pick(L.QUALIFYING, i).alias("qualifying_diagnosis"),
        _days_back(as_of, 41, 30, 730).alias("cardiac_event_date"), uniform(i, 42, 20, 65).alias("lvef_percent"),
        uniform(i, 43, 80, 170).alias("gxt_peak_hr"), _tenths(44, 30, 120).alias("gxt_peak_mets"),
        pick(["LOW", "MODERATE", "HIGH"], mix(i, 45, 3)).alias("aacvpr_risk_category"),
        _days_back(as_of, 46, 1, 60).alias("referral_date"), uniform(i, 47, 2, 30).alias("days_event_to_referral"),
    )


def sessions(ids: DataFrame, as_of: Column, per_referral: int = 10) -> DataFrame:
    """``per_referral`` sessions for every id: each id row is replicated, three days apart."""
    numbered = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(per_referral))).alias("session_number"))
    i = F.col("id") * per_referral + F.col("session_number") - 1
    keyed = numbered.withColumn("ref", F.col("id")).withColumn("id", i)
    k = _id()
    day = F.date_add(F.date_sub(F.to_date(as_of), 90),
                     ((F.col("session_number") - 1) * 3 + uniform(k, 51, 0, 2)).cast("int"))
    drawn = {
        "duration_minutes": (20, 55), "target_hr_low": (88, 112), "target_hr_high": (118, 148), "resting_hr": (58, 88),
        "peak_hr": (92, 160), "recovery_hr": (68, 105), "resting_bp_systolic": (108, 145),
        "resting_bp_diastolic": (62, 88), "peak_bp_systolic": (128, 185), "peak_bp_diastolic": (68, 98),
        "rpe_peak": (10, 17), "ecg_monitor_minutes": (15, 50),
    }
    return keyed.select(
        padded("SES-", k, 8).alias("session_id"), padded("REF-", F.col("ref") % REFERRALS, 6).alias("referral_id"),
        padded("PAT-", F.col("ref") % PATIENTS, 6).alias("patient_id"), "session_number", day.alias("session_date"),
        pick(L.MODALITIES, k).alias("modality"),
        *[uniform(k, 52 + n, low, high).alias(c) for n, (c, (low, high)) in enumerate(drawn.items())],
        _tenths(70, 880, 1000).alias("spo2_min"), pick(L.RHYTHMS, k).alias("ecg_rhythm"),
        (uniform(k, 71, 0, 100) < 3).alias("exercise_terminated_early"), pick(L.THERAPISTS, k).alias("therapist"),
    )


def outcomes(ids: DataFrame, as_of: Column) -> DataFrame:
    """A baseline and a discharge row per id."""
    i = _id()

    def point(name: str, mark: str, salt: int, days: tuple, walk: tuple, mets: tuple, phq9: tuple) -> DataFrame:
        return ids.select(
            padded(f"OUT-{mark}-", i, 6).alias("outcome_id"), padded("REF-", i, 6).alias("referral_id"),
            _patient().alias("patient_id"), F.lit("COMPREHENSIVE").alias("measurement_type"),
            F.lit(name).alias("measurement_point"), _days_back(as_of, salt, *days).alias("measurement_date"),
            uniform(i, salt + 1, *walk).alias("six_min_walk_meters"), _tenths(salt + 2, *mets).alias("peak_mets"),
            uniform(i, salt + 3, *phq9).alias("phq9_score"), _tenths(salt + 4, 180, 450).alias("bmi"),
            uniform(i, salt + 5, 55, 200).alias("ldl"), uniform(i, salt + 6, 25, 80).alias("hdl"),
        )

    return point("BASELINE", "B", 81, (60, 180), (180, 520), (25, 85), (1, 24)).unionByName(
        point("DISCHARGE", "D", 91, (1, 30), (220, 620), (35, 110), (0, 20))
    )


def labs(ids: DataFrame, as_of: Column) -> DataFrame:
    """Results spread from half the lower to 1.8 times the upper reference bound."""
    i = _id()
    low, high = F.col("ref_low"), F.col("ref_high")
    value = F.round(low * 0.5 + (high * 1.8 - low * 0.5) * mix(i, 101, 10000) / 10000.0, 2)
    drawn = L.cyclic_pick(ids, L.lab_tests(ids.sparkSession), "lookup_loinc", i, len(L.LAB_TESTS))
    flag = F.when(F.col("result_numeric") < low, "LOW").when(F.col("result_numeric") > high, "HIGH").otherwise("NORMAL")
    return drawn.withColumn("result_numeric", value).select(
        padded("LAB-", i, 8).alias("lab_id"), _encounter().alias("encounter_id"), _patient().alias("patient_id"),
        F.col("lookup_loinc").alias("loinc_code"), F.col("lookup_test").alias("test_name"), "result_numeric",
        F.col("lookup_unit").alias("unit"), low.alias("reference_low"), high.alias("reference_high"),
        flag.alias("computed_flag"), _minutes_back(as_of, 102, 1500000).alias("collected_at"),
    )


def vitals(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    value = F.lit(None).cast("long")
    for position, (_, _, low, high) in enumerate(L.VITALS):
        value = F.when(i % len(L.VITALS) == position, uniform(i, 111, low, high)).otherwise(value)
    return ids.select(
        padded("VIT-", i, 8).alias("vital_id"), _patient().alias("patient_id"), _encounter().alias("encounter_id"),
        pick([v[0] for v in L.VITALS], i).alias("vital_type"), value.alias("value_numeric"),
        pick([v[1] for v in L.VITALS], i).alias("unit"), _minutes_back(as_of, 112, 1500000).alias("measured_at"),
        pick(L.NURSES, i).alias("measured_by"), F.lit("BEDSIDE_MONITOR").alias("source_system"),
    )


def claims(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    money = lambda salt, low, high: (uniform(i, salt, low * 100, high * 100) / 100).cast("decimal(12,2)")
    draw = uniform(i, 125, 0, 100)
    status = F.when(draw < 12, "DENIED").when(uniform(i, 126, 0, 100) < 5, "PENDING").otherwise("PAID")
    return ids.select(
        padded("CLM-", i, 8).alias("claim_id"), _patient().alias("patient_id"), _encounter().alias("encounter_id"),
        padded("PAY-", i % 10, 3).alias("payer_id"), pick(L.PAYERS, i).alias("payer_name"),
        pick(L.CLAIM_TYPES, i).alias("claim_type"), _days_back(as_of, 120, 1, 730).alias("service_date"),
        pick(L.CPT_CODES, i).alias("cpt_code"), pick(L.DRG_CODES, i).alias("drg_code"),
        money(121, 150, 35000).alias("billed_amount"), money(122, 100, 28000).alias("allowed_amount"),
        money(123, 80, 25000).alias("paid_amount"), money(124, 0, 5000).alias("patient_responsibility"),
        status.alias("claim_status"),
        F.when(uniform(i, 127, 0, 100) < 12, pick(L.DENIAL_REASONS, i)).alias("denial_reason"),
    )


def clinical_notes(ids: DataFrame, as_of: Column) -> DataFrame:
    i = _id()
    return ids.select(
        padded("NOTE-", i, 8).alias("note_id"), _patient().alias("patient_id"), _encounter().alias("encounter_id"),
        pick(L.NOTE_TYPES, i).alias("note_type"),
        F.concat(pick(L.NOTE_TYPES, i), F.lit(": "), pick(L.NOTE_TEXTS, i)).alias("note_text"),
        pick(L.AUTHORS, i).alias("author"), _minutes_back(as_of, 131, 1500000).alias("authored_at"),
    )
