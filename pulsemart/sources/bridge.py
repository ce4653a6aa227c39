"""Raw health tables derived from the star-schema tables.

The star tables (customer, orders, lineitem, events, documents) play the feeding systems.
Each function maps one of them to a bronze health table with integer arithmetic on its keys,
including the faults real feeds have: repeated keys, missing load times, stray blanks, mixed
case, missing values and orphans. No window or sort is used, so every table is produced in a
single pass (plus one join to orders for the line-level tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.functions.numbers import padded, pick
from pulsemart.sources import lookups as L


def star(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Redistributes an input that arrives in fewer splits than there are cores.

    A file with a single row group is read by one task. At scale an input has far more splits
    than cores and is left as it is, so no exchange is added there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _days(base: str, days: Column) -> Column:
    return F.date_add(F.lit(base).cast("date"), days.cast("int"))


def _shift(moment: Column, amount: Column, unit: str) -> Column:
    """Zone-free timestamp moved by an integer column of DAY, HOUR or MINUTE."""
    seconds = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60}[unit]
    interval = F.make_dt_interval(secs=(amount * seconds).cast("decimal(18,6)"))
    return moment + interval


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def lines_with_patient(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Line items with the patient of their order (the only join line-level tables need)."""
    lines = spread(star(spark, sf_dir, "lineitem")) if lines is None else lines
    orders = star(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").cast("long").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("o_custkey").alias("ck"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").alias("shipped"),
    )


def _line_id(prefix: str) -> Column:
    return F.concat(padded(prefix, F.col("ok")), F.lit("-"), F.col("ln").cast("string"))


def _line_record() -> Column:
    return F.col("pk") * 1000003 + F.col("sk")


def _line_load() -> Column:
    return _unless((F.col("ok") + F.col("pk")) % 200 == 0, F.col("shipped"))


def raw_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = star(spark, sf_dir, "customer")
    nation, region = star(spark, sf_dir, "nation"), star(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    k, v = F.col("c_custkey"), F.col("version")
    versions = F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    loaded = _shift(F.lit("2001-01-01").cast("timestamp_ntz"), k % 300 + (v - 1) * 90, "DAY")
    return (
        customer.join(places, customer.c_nationkey == places.n_nationkey)
        .withColumn("version", F.explode(versions))
        .select(
            (k * 2 + v - 1).alias("record_id"),
            padded("PAT-", k).alias("patient_id"),
            F.concat(F.lit(" "), F.lower(pick(L.FIRST_NAMES, k)), F.lit(" ")).alias("first_name"),
            F.concat(pick(L.LAST_NAMES, F.floor(k / 20)), F.lit("  ")).alias("last_name"),
            _unless(k % 53 == 0, _days("1921-01-01", (k * 37) % 21900)).alias("date_of_birth"),
            _unless(k % 41 == 0, pick([" m", "F "], k)).alias("gender"),
            F.concat(F.lit(" "), F.col("r_name")).alias("ethnicity"),
            _unless(
                k % 29 == 0,
                F.concat_ws(
                    "-",
                    (k % 900 + 100).cast("string"),
                    (k % 90 + 10).cast("string"),
                    ((k * 7) % 9000 + 1000).cast("string"),
                ),
            ).alias("ssn"),
            F.concat((k % 9900 + 100 + v).cast("string"), F.lit(" "), pick(L.STREETS, k + v)).alias("address"),
            F.concat(F.lit("("), (k % 800 + 200).cast("string"), F.lit(") 555-"),
                     ((k * 11) % 9000 + 1000).cast("string")).alias("phone"),
            _unless(k % 13 == 0, F.concat(F.lit(" Patient"), k.cast("string"), F.lit("@Email.COM "))).alias("email"),
            F.concat(F.lit("INS-"), ((k * 3) % 90000 + 10000).cast("string")).alias("insurance_id"),
            pick(L.LANGUAGES, k).alias("primary_language"),
            pick(L.MARITAL, k + v).alias("marital_status"),
            F.lit("EPIC").alias("source_system"),
            F.lit("patients.parquet").alias("source_file"),
            _unless((k % 35 == 0) & (v == 1), loaded).alias("load_timestamp"),
        )
    )


def raw_encounters(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("version")
    versions = F.when(k % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    admitted = _shift(F.col("o_orderdate"), k % 24, "HOUR")
    stay = (k % 14) * 24 + k % 20
    kinds = {
        "1-URGENT": "emergency", "2-HIGH": " Inpatient", "3-MEDIUM": "INPATIENT ",
        "4-NOT SPECIFIED": "observation", "5-LOW": "outpatient",
    }
    kind = F.lit(None).cast("string")
    for priority, name in kinds.items():
        kind = F.when(F.col("o_orderpriority") == priority, name).otherwise(kind)
    status = (
        F.when(v == 2, "TRANSFERRED").when(k % 20 == 0, "EXPIRED").when(k % 15 == 0, "TRANSFERRED")
        .otherwise("DISCHARGED_HOME")
    )
    return (
        (star(spark, sf_dir, "orders") if orders is None else orders)
        .withColumn("version", F.explode(versions))
        .select(
            (k * 2 + v - 1).alias("record_id"),
            padded("ENC-", k).alias("encounter_id"),
            F.when(k % 101 == 0, padded("PAT-X", F.col("o_custkey")))
            .otherwise(padded("PAT-", F.col("o_custkey"))).alias("patient_id"),
            kind.alias("encounter_type"),
            admitted.alias("admit_date"),
            _unless(k % 17 == 0, _shift(admitted, stay, "HOUR")).alias("discharge_date"),
            pick(L.DEPARTMENTS, k).alias("department"),
            pick(L.PROVIDERS, k).alias("attending_provider"),
            pick(L.FACILITIES, k).alias("facility_code"),
            pick(L.ADMIT_CODES, k).alias("admit_diagnosis_code"),
            status.alias("discharge_status"),
            F.lit("EPIC").alias("source_system"),
            _shift(F.col("o_orderdate"), v, "DAY").alias("load_timestamp"),
        )
    )


def raw_diagnoses(spark: SparkSession, lines: DataFrame) -> DataFrame:
    ok, ln, pk, sk = F.col("ok"), F.col("ln"), F.col("pk"), F.col("sk")
    lines = L.cyclic_pick(lines, L.diagnoses(spark), "dx_code", pk, len(L.DIAGNOSES))
    old = sk % 11 == 0
    code = (
        F.when(old, pick(["410.1", "414.0", "428.0", "413.9"], sk))
        .when(ok % 50 == 0, F.concat(F.lit(" "), F.col("dx_code")))
        .when(pk % 7 == 0, F.lower(F.col("dx_code")))
        .otherwise(F.col("dx_code"))
    )
    return lines.select(
        _line_record().alias("record_id"),
        _line_id("DX-").alias("diagnosis_id"),
        padded("PAT-", F.col("ck")).alias("patient_id"),
        padded("ENC-", ok).alias("encounter_id"),
        code.alias("icd_code"),
        F.when(old, "9").otherwise("10").alias("icd_version"),
        _unless(pk % 23 == 0, F.col("dx_name")).alias("description"),
        pick(L.DIAGNOSIS_TYPES, ln - 1).alias("diagnosis_type"),
        F.col("shipped").cast("date").alias("diagnosis_date"),
        F.lit("EPIC").alias("source_system"),
        _line_load().alias("load_timestamp"),
    )


def raw_medications(spark: SparkSession, lines: DataFrame) -> DataFrame:
    ok, pk, sk, qty = F.col("ok"), F.col("pk"), F.col("sk"), F.col("qty")
    lines = L.cyclic_pick(lines, L.medications(spark), "med_name", pk + sk, len(L.MEDICATIONS))
    start = F.col("shipped").cast("date")
    return lines.select(
        _line_record().alias("record_id"),
        _line_id("MED-").alias("medication_id"),
        padded("PAT-", F.col("ck")).alias("patient_id"),
        padded("ENC-", ok).alias("encounter_id"),
        F.lpad(pk.cast("string"), 11, "0").alias("ndc_code"),
        _unless(pk % 37 == 0, F.col("med_name")).alias("medication_name"),
        F.nullif(F.regexp_extract("med_name", "[0-9]+[a-zA-Z]+", 0), F.lit("")).alias("dosage"),
        pick(L.ROUTES, pk).alias("route"),
        pick(L.FREQUENCIES, sk).alias("frequency"),
        pick(L.PROVIDERS, ok).alias("prescriber"),
        start.alias("start_date"),
        F.date_add(start, (qty + 30).cast("int")).alias("end_date"),
        F.lit("EPIC").alias("source_system"),
        _line_load().alias("load_timestamp"),
    )


def raw_lab_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    labs = L.cyclic_pick(star(spark, sf_dir, "events"), L.lab_tests(spark), "lookup_loinc", e, len(L.LAB_TESTS))
    result = _unless(e % 19 == 0, F.col("value"))
    ranged = e % 11 != 0
    name = F.when((F.col("lookup_test") == "Hemoglobin A1c") & (e % 4 == 0), "HbA1c (glycated)")
    return labs.select(
        e.alias("record_id"),
        padded("LAB-", e).alias("lab_id"),
        padded("PAT-", F.col("user_id")).alias("patient_id"),
        padded("ENC-", F.floor(e / 2)).alias("encounter_id"),
        F.col("lookup_loinc").alias("loinc_code"),
        name.otherwise(F.col("lookup_test")).alias("test_name"),
        result.alias("result_numeric"),
        F.col("lookup_unit").alias("unit"),
        F.when(ranged, F.col("ref_low")).alias("reference_low"),
        F.when(ranged, F.col("ref_high")).alias("reference_high"),
        F.when(e % 2 == 0, "A").alias("abnormal_flag"),
        F.col("ts").alias("collected_at"),
        F.lit("LIS").alias("source_system"),
        _shift(F.col("ts"), F.lit(1), "HOUR").alias("load_timestamp"),
    )


def raw_vital_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return star(spark, sf_dir, "events").select(
        padded("VIT-", e).alias("vital_id"),
        padded("PAT-", F.col("user_id")).alias("patient_id"),
        padded("ENC-", F.floor(e / 2)).alias("encounter_id"),
        pick([v[0] for v in L.VITALS], e).alias("vital_type"),
        F.col("value").alias("value_numeric"),
        pick([v[1] for v in L.VITALS], e).alias("unit"),
        F.col("ts").alias("measured_at"),
        pick(L.NURSES, e).alias("measured_by"),
        F.lit("BEDSIDE_MONITOR").alias("source_system"),
    )


def raw_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return star(spark, sf_dir, "orders").select(
        k.alias("record_id"),
        padded("PRC-", k).alias("procedure_id"),
        padded("PAT-", F.col("o_custkey")).alias("patient_id"),
        padded("ENC-", k).alias("encounter_id"),
        pick(L.CPT_CODES, k).alias("cpt_code"),
        F.col("o_orderdate").cast("date").alias("procedure_date"),
        pick(L.PROVIDERS, k).alias("performing_provider"),
        F.lit("EPIC").alias("source_system"),
    )


def _referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One referral per patient, a second for some; one patient in five, by key, is not referred."""
    k = F.col("c_custkey")
    parts = F.when(k % 8 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        star(spark, sf_dir, "customer")
        .filter(k % 5 != 3)
        .withColumn("part", F.explode(parts))
        .select(k.alias("k"), "part", _referral_id(k, F.col("part") == 2).alias("referral_id"))
    )


def _referral_id(patient_key: Column, second: Column) -> Column:
    return F.when(second, F.concat(padded("REF-", patient_key), F.lit("-2"))).otherwise(padded("REF-", patient_key))


def raw_rehab_referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("k"), F.col("part")
    event = _days("1995-06-01", (k * 13) % 1800 + (part - 1) * 200)
    referred = F.date_add(event, (k % 29 + 2).cast("int"))
    return _referrals(spark, sf_dir).select(
        (k * 2 + part - 1).alias("record_id"),
        "referral_id",
        padded("PAT-", k).alias("patient_id"),
        pick(L.PROVIDERS, k).alias("referring_physician"),
        pick(L.QUALIFYING, k + part).alias("qualifying_diagnosis"),
        _unless(k % 31 == 0, event).alias("cardiac_event_date"),
        _unless(k % 37 == 0, (k * 7) % 92 / 2.0 + 20).alias("lvef_percent"),
        (k % 91 + 80).cast("int").alias("gxt_peak_hr"),
        _unless(k % 59 == 0, (k * 5) % 37 / 4.0 + 3).alias("gxt_peak_mets"),
        pick(["NONE", "ST_DEPRESSION", "ANGINA"], k).alias("ischemic_threshold"),
        _unless(k % 43 == 0, pick([" low", "Moderate ", "HIGH"], k)).alias("aacvpr_risk_category"),
        referred.alias("referral_date"),
        F.lit("EPIC").alias("source_system"),
        F.date_add(referred, 1).cast("timestamp_ntz").alias("load_timestamp"),
    )


def raw_rehab_sessions(spark: SparkSession, lines: DataFrame) -> DataFrame:
    ok, ln, pk, sk, ck, qty = (F.col(c) for c in ("ok", "ln", "pk", "sk", "ck", "qty"))
    as_int = lambda c: c.cast("int")
    return lines.select(
        _line_record().alias("record_id"),
        _line_id("SES-").alias("session_id"),
        _unless(ok % 25 == 0, _referral_id(ck, (ck % 8 == 0) & (ok % 2 == 1))).alias("referral_id"),
        padded("PAT-", ck).alias("patient_id"),
        as_int((ok * 7 + ln * 3) % 36 + 1).alias("session_number"),
        F.col("shipped").cast("date").alias("session_date"),
        pick(L.MODALITIES, pk).alias("modality"),
        as_int(pk % 36 + 20).alias("duration_minutes"),
        as_int(sk % 25 + 88).alias("target_hr_low"),
        _unless(sk % 47 == 0, as_int(F.when(sk % 43 == 1, 0).otherwise(sk % 31 + 118))).alias("target_hr_high"),
        as_int(pk % 31 + 58).alias("resting_hr"),
        _unless(pk % 61 == 0, as_int((pk * 3 + ln) % 69 + 92)).alias("peak_hr"),
        _unless(sk % 53 == 0, as_int(sk % 38 + 68)).alias("recovery_hr"),
        as_int(pk % 38 + 108).alias("resting_bp_systolic"),
        as_int(sk % 27 + 62).alias("resting_bp_diastolic"),
        as_int((pk * 7) % 90 + 110).alias("peak_bp_systolic"),
        as_int(sk % 52 + 65).alias("peak_bp_diastolic"),
        as_int(pk % 37 + 112).alias("post_bp_systolic"),
        as_int(sk % 27 + 62).alias("post_bp_diastolic"),
        _unless(qty == 50, as_int(qty % 8 + 10)).alias("rpe_peak"),
        _unless(pk % 71 == 0, pk % 27 / 2.0 + 87).alias("spo2_min"),
        pick(L.RHYTHMS, pk).alias("ecg_rhythm"),
        as_int(sk % 36 + 15).alias("ecg_monitor_minutes"),
        F.when(pk % 17 == 0, "FATIGUE").alias("symptoms"),
        F.when(pk % 97 == 0, "DIZZINESS").alias("adverse_events"),
        _unless((pk + sk) % 34 == 1, (pk + sk) % 33 == 0).alias("exercise_terminated_early"),
        F.when((pk + sk) % 33 == 0, "SYMPTOMS").alias("termination_reason"),
        pick(L.THERAPISTS, sk).alias("therapist"),
        F.lit("CARDIAC_DEVICE").alias("source_system"),
        _line_load().alias("load_timestamp"),
    )


def raw_rehab_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, part = F.col("k"), F.col("part")
    kinds = F.concat(
        F.array(F.lit("B")),
        F.when(k % 19 == 0, F.array(F.lit("B2"))).otherwise(F.array().cast("array<string>")),
        F.when(k % 7 != 0, F.array(F.lit("D"))).otherwise(F.array().cast("array<string>")),
    )
    done = F.col("kind") == "D"
    gain = F.when(done, k % 60 - 10).when(F.col("kind") == "B2", 5).otherwise(0)
    return (
        _referrals(spark, sf_dir)
        .withColumn("kind", F.explode(kinds))
        .select(
            (k * 2 + part - 1).alias("record_id"),
            F.concat(F.lit("OUT-"), F.col("kind"), F.lit("-"), F.col("referral_id")).alias("outcome_id"),
            "referral_id",
            padded("PAT-", k).alias("patient_id"),
            F.lit("COMPREHENSIVE").alias("measurement_type"),
            F.when(done, "DISCHARGE").otherwise("BASELINE").alias("measurement_point"),
            _days("1996-01-01", (k * 13) % 1800 + F.when(done, 120).otherwise(0)).alias("measurement_date"),
            _unless(k % 23 == 0, ((k * 11) % 341 + 180 + gain).cast("double")).alias("six_min_walk_meters"),
            ((k % 25) / 4.0 + 2.5 + F.when(done, 1.25).otherwise(0.0)).alias("peak_mets"),
            ((k % 80) / 2.0 + 8).alias("dasi_score"),
            _unless(k % 17 == 0, (F.when(done, (k * 2) % 21).otherwise((k * 3) % 25)).cast("int")).alias("phq9_score"),
            ((k % 181) / 2.0 + 50).alias("weight_kg"),
            ((k % 54) / 2.0 + 18.5 - F.when(done, 0.5).otherwise(0.0)).alias("bmi"),
            ((k % 140) / 2.0 + 65).alias("waist_cm"),
            ((k % 41) / 8.0 + 5 - F.when(done, 0.25).otherwise(0.0)).alias("hba1c"),
            (k % 131 + 70 - F.when(done, 15).otherwise(0)).cast("double").alias("ldl"),
            (k % 51 + 25).cast("double").alias("hdl"),
            (k % 161 + 140).cast("double").alias("total_cholesterol"),
            (k % 281 + 70).cast("double").alias("triglycerides"),
            F.lit("EPIC").alias("source_system"),
            _shift(F.lit("2001-06-01").cast("timestamp_ntz"), k % 100, "DAY").alias("load_timestamp"),
        )
    )


def raw_claims(spark: SparkSession, lines: DataFrame) -> DataFrame:
    ok, ln, pk, sk = (F.col(c) for c in ("ok", "ln", "pk", "sk"))
    money = lambda cents: (cents / 100).cast("decimal(12,2)")
    allowed = F.floor(F.col("cents") * (100 - F.col("disc")) / 100)
    paid = F.when(F.col("flag") == "R", 0).otherwise(F.floor(allowed * 4 / 5))
    return lines.select(
        _line_record().alias("record_id"),
        _line_id("CLM-").alias("claim_id"),
        padded("PAT-", F.col("ck")).alias("patient_id"),
        padded("ENC-", ok).alias("encounter_id"),
        padded("PAY-", sk % 10, 3).alias("payer_id"),
        pick(L.PAYERS, sk).alias("payer_name"),
        pick(L.CLAIM_TYPES, ln).alias("claim_type"),
        _unless(ok % 211 == 0, F.col("shipped").cast("date")).alias("service_date"),
        pick(L.CPT_CODES, pk).alias("cpt_code"),
        pick(L.DRG_CODES, pk).alias("drg_code"),
        money(F.col("cents")).alias("billed_amount"),
        _unless(pk % 83 == 0, money(allowed)).alias("allowed_amount"),
        _unless(pk % 89 == 0, money(paid)).alias("paid_amount"),
        money(allowed - paid).alias("patient_responsibility"),
        F.when(F.col("flag") == "R", "DENIED").when((F.col("flag") == "A") & (ln == 1), "PENDING")
        .otherwise("PAID").alias("claim_status"),
        _unless(pk % 5 == 0, pick(L.DENIAL_REASONS, pk)).alias("denial_reason"),
        F.lit("CLAIMS_SYSTEM").alias("source_system"),
        F.col("shipped").alias("load_timestamp"),
    )


def raw_clinical_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the whole text followed by the clinical paragraph of the note type."""
    d = F.col("doc_id")
    return spread(star(spark, sf_dir, "documents")).select(
        padded("NOTE-", d).alias("note_id"),
        padded("PAT-", F.floor(d * 3 / 2)).alias("patient_id"),
        padded("ENC-", d * 5).alias("encounter_id"),
        pick(L.NOTE_TYPES, d).alias("note_type"),
        F.concat(F.col("text"), F.lit("\n"), pick(L.NOTE_TEXTS, d)).alias("note_text"),
        pick(L.AUTHORS, d).alias("author"),
        _shift(F.lit("2001-01-01").cast("timestamp_ntz"), (d * 37) % 500000, "MINUTE").alias("authored_at"),
        F.lit("EHR").alias("source_system"),
    )


def care_team_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return star(spark, sf_dir, "customer").select(
        k.alias("assignment_id"),
        padded("PAT-", k).alias("patient_id"),
        pick(["TEAM-CARDIO", "TEAM-ORTHO", "TEAM-REHAB"], k).alias("care_team_id"),
        F.concat(F.lit("CLINICIAN_"), (k % 12).cast("string")).alias("clinician_user"),
        pick(["LEAD", "NURSE", "THERAPIST"], F.floor(k / 3)).alias("role_in_team"),
        _days("1998-01-01", (k * 17) % 1200).alias("assigned_date"),
        _unless(k % 4 == 0, _days("1998-01-01", (k * 17) % 1200 + (k * 23) % 1500)).alias("end_date"),
    )
