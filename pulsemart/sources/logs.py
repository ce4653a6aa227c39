"""Platform log tables derived from the event stream.

Every event stands for one statement, login, transfer or grant. The derivation is integer
arithmetic on the event and user ids; the daily and per-user tables are aggregates of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.functions.dates import hour_of
from pulsemart.functions.numbers import padded, pick
from pulsemart.sources import lookups
from pulsemart.sources.bridge import star

# Names used in the logs.
ROLES = ["HEALTH_DATA_ADMIN", "HEALTH_ML_ADMIN", "HEALTH_ANALYST", "HEALTH_DATA_ENGINEER", "HEALTH_ML_ENGINEER",
         "HEALTH_READONLY", "HEALTH_APP_ADMIN", "ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ORGADMIN"]
WAREHOUSES = ["HEALTH_INGEST_WH", "HEALTH_TRANSFORM_WH", "HEALTH_ANALYTICS_WH", "HEALTH_AI_WH", "COMPUTE_WH"]
SIZES = ["Small", "Medium", "Large", "X-Large", "Small"]
DATABASES = ["HEALTH_RAW_DB", "HEALTH_TRANSFORM_DB", "HEALTH_ANALYTICS_DB", "HEALTH_AI_READY_DB",
             "HEALTH_GOVERNANCE_DB"]
SCHEMAS = ["CLINICAL_DATA", "MASTER", "CLEANSED", "CORE", "REPORTING"]
STATEMENTS = [
    ("SELECT", "SELECT * FROM DIM_PATIENT"),
    ("INSERT", "INSERT INTO FACT_ENCOUNTER SELECT * FROM RAW_ENCOUNTERS"),
    ("UPDATE", "UPDATE DIM_PATIENT SET IS_CURRENT = FALSE"),
    ("MERGE", "MERGE INTO DIM_PATIENT USING RAW_PATIENTS"),
    ("DELETE", "DELETE FROM RAW_CLAIMS"),
    ("CREATE_TABLE", "CREATE TABLE FACT_PREDICTIONS (ID INT)"),
    ("ALTER_TABLE_MODIFY_COLUMN", "ALTER TABLE DIM_PATIENT MODIFY COLUMN SSN SET TAG PHI_CLASSIFICATION = 'DIRECT_PHI'"),
    ("ALTER", "ALTER TABLE DIM_PATIENT UNSET TAG DATA_DOMAIN"),
    ("DROP", "drop tag OLD_TAG"),
    ("CREATE", "create masking policy MASK_SSN"),
    ("ALTER_MASKING_POLICY", "ALTER MASKING POLICY MASK_DOB SET BODY"),
    ("DROP_ROW_ACCESS_POLICY", "DROP ROW ACCESS POLICY ROW_ACCESS_CARE_TEAM"),
    ("GRANT", "GRANT ROLE HEALTH_ANALYST TO USER SOMEONE"),
    ("CREATE_USER", "CREATE USER SOMEONE"),
    ("CREATE_ROLE", "CREATE ROLE HEALTH_GUEST"),
    ("DROP_VIEW", "DROP VIEW VW_OLD"),
    ("CREATE", "CREATE TAG REFRESH_FREQUENCY"),
    ("ALTER_TABLE", "ALTER TABLE RAW_CLAIMS ADD COLUMN NOTE STRING"),
]
POLICIES = ["MASK_PATIENT_PHI", "MASK_SSN", "MASK_DOB", "MASK_PHONE_EMAIL", "MASK_OLD", "ROW_ACCESS_CARE_TEAM",
            "ROW_ACCESS_DATA_QUALITY", "ROW_ACCESS_OTHER"]
POLICY_OWNERS = [(p, "HEALTH_GOVERNANCE_DB", "MONITORING", "HEALTH_DATA_ADMIN") for p in POLICIES]
# Tagged objects (tag, value, database, schema, object, column).
TAGS = [
    ("PHI_CLASSIFICATION", "DIRECT_PHI", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "FIRST_NAME"),
    ("PHI_CLASSIFICATION", "DIRECT_PHI", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "LAST_NAME"),
    ("PHI_CLASSIFICATION", "DIRECT_PHI", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "SSN"),
    ("PHI_CLASSIFICATION", "QUASI_PHI", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "GENDER"),
    ("PHI_CLASSIFICATION", "CLINICAL", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_DIAGNOSIS", "ICD_CODE"),
    ("PHI_CLASSIFICATION", "NON_PHI", "HEALTH_RAW_DB", "CLINICAL_DATA", "RAW_ENCOUNTERS", "FACILITY_CODE"),
    ("DATA_SENSITIVITY", "HIGHLY_CONFIDENTIAL", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "PATIENT_ID"),
    ("DATA_SENSITIVITY", "CONFIDENTIAL", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
    ("DATA_DOMAIN", "PATIENT", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "PATIENT_ID"),
    ("DATA_DOMAIN", "CARDIAC_REHAB", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
    ("DATA_DOMAIN", "FINANCIAL", "HEALTH_RAW_DB", "REFERENCE_DATA", "RAW_CLAIMS", "CLAIM_ID"),
    ("MEDALLION_LAYER", "SILVER", "HEALTH_TRANSFORM_DB", "MASTER", "DIM_PATIENT", "PATIENT_ID"),
    ("MEDALLION_LAYER", "SILVER", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
    ("MEDALLION_LAYER", "BRONZE", "HEALTH_RAW_DB", "REFERENCE_DATA", "RAW_CLAIMS", "CLAIM_ID"),
    ("SOURCE_SYSTEM", "CARDIAC_DEVICE", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
    ("SOURCE_SYSTEM", "CLAIMS_SYSTEM", "HEALTH_RAW_DB", "REFERENCE_DATA", "RAW_CLAIMS", "CLAIM_ID"),
    ("REFRESH_FREQUENCY", "DAILY", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
    ("DATA_QUALITY_STATUS", "CERTIFIED", "HEALTH_TRANSFORM_DB", "CLEANSED", "FACT_REHAB_SESSION", "SESSION_ID"),
]
RETENTION = ["7_YEARS", "10_YEARS", "PERMANENT", "1_YEAR", None]
# Monthly credit quota per warehouse.
QUOTAS = {"HEALTH_INGEST_WH": 500.0, "HEALTH_TRANSFORM_WH": 1500.0, "HEALTH_ANALYTICS_WH": 2000.0,
          "HEALTH_AI_WH": 1000.0, "COMPUTE_WH": 0.0}

E = "event_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a spread-out log time: some as they are, some 40 to 160 days earlier."""
    e = F.col(E)
    back = F.make_dt_interval(days=(F.floor(e / 11) % 5 * 40).cast("int"))
    return star(spark, sf_dir, "events").withColumn("log_time", F.col("ts") - back)


def _at(step: int) -> Column:
    return F.floor(F.col(E) / step)


def _user() -> Column:
    return F.concat(F.lit("USER_"), F.col("user_id").cast("string"))


def _failed() -> Column:
    return F.col("event_type") == "error"


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    elapsed = F.round(F.col("value") * 1000).cast("long")
    return _events(spark, sf_dir).select(
        padded("Q-", e).alias("query_id"),
        pick([s[1] for s in STATEMENTS], e).alias("query_text"),
        _user().alias("user_name"),
        pick(ROLES, _at(7)).alias("role_name"),
        pick(WAREHOUSES, e).alias("warehouse_name"),
        pick(SIZES, e).alias("warehouse_size"),
        pick(DATABASES, _at(3)).alias("database_name"),
        pick(SCHEMAS, _at(13)).alias("schema_name"),
        pick([s[0] for s in STATEMENTS], e).alias("query_type"),
        F.when(_failed(), "FAIL").otherwise("SUCCESS").alias("execution_status"),
        F.when(_failed(), F.concat(F.lit("100"), (e % 10).cast("string"))).alias("error_code"),
        F.when(_failed(), "Statement failed").alias("error_message"),
        F.col("log_time").alias("start_time"),
        (F.col("log_time") + F.make_dt_interval(mins=F.floor(elapsed / 60000).cast("int"))).alias("end_time"),
        elapsed.alias("total_elapsed_time"),
        (e % 900).alias("compilation_time"),
        (e % 4000).alias("queued_overload_time"),
        ((e * 7919) % 100003 * 1048576).alias("bytes_scanned"),
        (e % 5000).alias("rows_produced"),
        (e % 100).alias("partitions_scanned"),
        (e % 400).alias("partitions_total"),
        (e % 64 / 64.0).alias("credits_used_cloud_services"),
    )


def warehouse_load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).select(
        pick(WAREHOUSES, e).alias("warehouse_name"),
        F.col("log_time").alias("start_time"),
        (F.col("log_time") + F.expr("INTERVAL 5 MINUTES")).alias("end_time"),
        (e % 48 / 4.0).alias("avg_running"),
        (_at(5) % 28 / 4.0).alias("avg_queued_load"),
        (_at(9) % 8 / 8.0).alias("avg_queued_provisioning"),
        (_at(17) % 3 / 2.0).alias("avg_blocked"),
    )


def warehouse_metering_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).select(
        pick(WAREHOUSES, e).alias("warehouse_name"),
        hour_of(F.col("log_time")).alias("start_time"),
        (_at(5) % 32 / 16.0).alias("credits_used"),
        (_at(5) % 32 / 32.0).alias("credits_used_compute"),
        (_at(5) % 32 / 32.0).alias("credits_used_cloud_services"),
    )


def login_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).select(
        E,
        F.col("log_time").alias("event_timestamp"),
        _user().alias("user_name"),
        F.when(e % 23 != 0, pick(["10.1.1.1", "192.168.0.7", "8.8.8.8", "172.16.0.9"], e)).alias("client_ip"),
        pick(["WEB", "JDBC", "PYTHON"], e).alias("reported_client_type"),
        pick(["1.0", "1.1"], e).alias("reported_client_version"),
        F.lit("PASSWORD").alias("first_authentication_factor"),
        F.when(_at(2) % 3 == 0, "MFA_TOKEN").alias("second_authentication_factor"),
        F.when(_failed(), "NO").otherwise("YES").alias("is_success"),
        F.when(_failed(), "390100").alias("error_code"),
        F.when(_failed(), "Incorrect password").alias("error_message"),
        F.lit("DIRECT").alias("connection"),
    )


def data_transfer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).select(
        F.col("log_time").alias("start_time"),
        pick(["AWS", "AZURE"], e).alias("source_cloud"),
        pick(["us-east-1", "us-west-2"], e).alias("source_region"),
        pick(["AWS", "GCP"], _at(2)).alias("target_cloud"),
        pick(["eu-west-1", "us-east-1"], _at(2)).alias("target_region"),
        pick(["COPY", "REPLICATION", "EXTERNAL_ACCESS"], e).alias("transfer_type"),
        ((e * 104729) % 1000003 * 1024).alias("bytes_transferred"),
    )


def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("usage_date")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) * 1000000).alias("storage_bytes"),
        (F.count("*") * 1000000000).alias("stage_bytes"),
        (F.count(F.when(_failed(), 1)) * 1000000000).alias("failsafe_bytes"),
    )


def database_storage_usage_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        star(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("usage_date"), pick(DATABASES, _at(3)).alias("database_name"))
        .agg(
            (F.count("*") * 1500000000).cast("double").alias("average_database_bytes"),
            (F.count(F.when(_failed(), 1)) * 1000000000).cast("double").alias("average_failsafe_bytes"),
        )
    )


def resource_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monitor per warehouse: its quota against the credits metered so far."""
    quota = F.lit(None).cast("double")
    for name, credits in QUOTAS.items():
        quota = F.when(F.col("warehouse_name") == name, credits).otherwise(quota)
    used = warehouse_metering_history(spark, sf_dir).groupBy("warehouse_name").agg(
        F.sum("credits_used").alias("used_credits")
    )
    return used.select(
        F.concat(F.lit("HEALTH_"), F.replace("warehouse_name", F.lit("HEALTH_"), F.lit("")), F.lit("_MONITOR"))
        .alias("name"),
        quota.alias("credit_quota"),
        "used_credits",
        (quota - F.col("used_credits")).alias("remaining_credits"),
        F.lit("75%").alias("notify"),
        F.lit("90%").alias("suspend"),
        F.lit("100%").alias("suspend_immediate"),
        F.col("warehouse_name").alias("warehouses"),
        F.lit("2023-01-01").cast("timestamp_ntz").alias("created"),
    )


def grants_to_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).filter(F.col("event_type") == "signup").select(
        F.col("log_time").alias("created_on"),
        F.when(e % 6 == 0, F.col("ts")).alias("deleted_on"),
        pick(ROLES, _at(7)).alias("role"),
        _user().alias("grantee_name"),
        F.concat(F.lit("USER_"), (e % 50).cast("string")).alias("granted_by"),
    )


def grants_to_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    privileges = ["USAGE", "OWNERSHIP", "APPLY MASKING POLICY", "SELECT", "APPLY TAG", "APPLY ROW ACCESS POLICY"]
    return _events(spark, sf_dir).filter(F.col("event_type") == "click").select(
        F.col("log_time").alias("created_on"),
        F.when(e % 9 == 0, F.col("ts")).alias("deleted_on"),
        pick(privileges, e).alias("privilege"),
        pick(["ROLE", "TABLE"], _at(6)).alias("granted_on"),
        pick(ROLES, _at(7)).alias("name"),
        pick(ROLES, _at(5)).alias("grantee_name"),
        _user().alias("granted_by"),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extract table per user, sized by the user's events."""
    return star(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("created"), F.count("*").alias("row_count")
    ).select(
        F.lit("HEALTH_ANALYTICS_DB").alias("table_catalog"),
        F.lit("REPORTING").alias("table_schema"),
        F.concat(F.lit("EXTRACT_"), F.col("user_id").cast("string")).alias("table_name"),
        "created",
        "row_count",
        (F.col("row_count") * 134217728).alias("bytes"),
        F.when(F.col("user_id") % 17 == 0, F.col("created")).alias("deleted"),
    )


def tag_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed classification tags plus a retention tag per extract table."""
    fixed = lookups.lookup(
        spark, TAGS, ["tag_name", "tag_value", "object_database", "object_schema", "object_name", "column_name"]
    )
    number = F.replace("table_name", F.lit("EXTRACT_"), F.lit("")).cast("long")
    values = F.array(*[F.lit(v).cast("string") for v in RETENTION])
    retention = tables(spark, sf_dir).select(
        F.lit("RETENTION_POLICY").alias("tag_name"),
        F.element_at(values, (number % len(RETENTION) + 1).cast("int")).alias("tag_value"),
        F.col("table_catalog").alias("object_database"),
        F.col("table_schema").alias("object_schema"),
        F.col("table_name").alias("object_name"),
        F.lit(None).cast("string").alias("column_name"),
    )
    return fixed.unionByName(retention).select(
        F.lit("HEALTH_GOVERNANCE_DB").alias("tag_database"), F.lit("SECURITY").alias("tag_schema"), "*"
    )


def access_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    base = "HEALTH_TRANSFORM_DB."
    objects = [
        F.array(F.lit(base + "MASTER.DIM_PATIENT"), F.lit(base + "CLEANSED.FACT_ENCOUNTER")),
        F.array(F.lit(base + "CLEANSED.FACT_LAB_RESULT")),
        F.array(F.lit(base + "CLEANSED.FACT_DIAGNOSIS"), F.lit("raw_patients")),
        F.array().cast("array<string>"),
    ]
    return star(spark, sf_dir, "events").filter(F.col("event_type") != "view").select(
        padded("Q-", e).alias("query_id"),
        F.element_at(F.array(*objects), (e % 4 + 1).cast("int")).alias("direct_objects_accessed"),
    )


def policy_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    name = pick(POLICIES, e)
    return star(spark, sf_dir, "events").filter(F.col("event_type") == "view").select(
        name.alias("policy_name"),
        F.lit("HEALTH_GOVERNANCE_DB").alias("policy_db"),
        F.lit("MONITORING").alias("policy_schema"),
        F.when(name.like("MASK%"), "MASKING_POLICY").otherwise("ROW_ACCESS_POLICY").alias("policy_kind"),
        F.when(e % 31 == 0, "TEST_DB").otherwise(pick(DATABASES, _at(3))).alias("ref_database_name"),
        pick(SCHEMAS, _at(13)).alias("ref_schema_name"),
        F.concat(F.lit("EXTRACT_"), F.col("user_id").cast("string")).alias("ref_entity_name"),
        F.when(name.like("MASK%"), F.concat(F.lit("COLUMN_"), e.cast("string"))).alias("ref_column_name"),
        F.lit("TABLE").alias("ref_entity_domain"),
    )


def policies(spark: SparkSession, prefix: str) -> DataFrame:
    owners = lookups.lookup(spark, POLICY_OWNERS, ["policy_name", "policy_catalog", "policy_schema", "policy_owner"])
    return owners.filter(F.col("policy_name").like(f"{prefix}%")).select(
        "*",
        F.lit("2023-02-01").cast("timestamp_ntz").alias("created"),
        F.when(F.col("policy_name") == "MASK_OLD", F.lit("2023-12-01").cast("timestamp_ntz")).alias("deleted"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    seen = star(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max(F.when(~_failed(), F.col("ts"))).alias("last_ts")
    )
    return seen.select(
        _user().alias("name"),
        F.lower(_user()).alias("login_name"),
        F.concat(F.lit("User "), u.cast("string")).alias("display_name"),
        F.concat(F.lit("user"), u.cast("string"), F.lit("@example.org")).alias("email"),
        pick(ROLES, u).alias("default_role"),
        pick(WAREHOUSES, u).alias("default_warehouse"),
        (F.col("first_ts") - F.expr("INTERVAL 400 DAYS")).alias("created_on"),
        F.when(u % 10 != 9, F.col("last_ts") - F.make_dt_interval(days=(u % 5 * 30).cast("int")))
        .alias("last_success_login"),
        F.when(u % 13 == 0, "true").otherwise("false").alias("disabled"),
        F.when(u % 3 == 0, "false").otherwise("true").alias("has_mfa"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col(E)
    return _events(spark, sf_dir).filter(F.col("event_type") == "purchase").select(
        e.alias("session_id"),
        _user().alias("user_name"),
        F.col("log_time").alias("created_on"),
        (e % 2 == 0).alias("is_open"),
        F.when(e % 2 == 1, "LOGOUT").alias("closed_reason"),
        pick(["WEB_UI", "JDBC_DRIVER"], e).alias("client_application_id"),
        pick(["7.1", "7.2", "8.0"], e).alias("client_application_version"),
        F.lit("PROD").alias("client_environment"),
        F.when(e % 7 != 0, pick(["PASSWORD", "PASSWORD_MFA", "MULTI_FACTOR", "KEYPAIR"], _at(3)))
        .alias("authentication_method"),
    )


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles that occur in grants, with the time of their first grant."""
    return grants_to_roles(spark, sf_dir).groupBy("name").agg(
        F.min("created_on").alias("created_on"), F.count("*").alias("n")
    ).select(
        "name", pick(["ACCOUNTADMIN", "USERADMIN", "SYSADMIN"], F.col("n")).alias("owner"), "created_on",
        F.lit(None).cast("timestamp_ntz").alias("deleted_on"),
    )
