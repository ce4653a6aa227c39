"""Security audit views and the user risk score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions import dates
from pulsemart.functions.rules import first_match
from pulsemart.plans.logs import recent

# Roles and statement types the rules name.
TOP_ROLES = ["ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN", "ORGADMIN"]
PHI_ROLES = ["HEALTH_DATA_ADMIN", "HEALTH_ANALYST", "ACCOUNTADMIN"]
GOVERNANCE_PRIVILEGES = ["APPLY MASKING POLICY", "APPLY ROW ACCESS POLICY", "APPLY TAG"]
TAG_STATEMENTS = ["CREATE", "ALTER", "DROP", "ALTER_TABLE", "ALTER_TABLE_MODIFY_COLUMN"]
POLICY_STATEMENTS = ["CREATE_MASKING_POLICY", "CREATE_ROW_ACCESS_POLICY", "ALTER_MASKING_POLICY",
                     "ALTER_ROW_ACCESS_POLICY", "DROP_MASKING_POLICY", "DROP_ROW_ACCESS_POLICY",
                     "CREATE", "ALTER", "DROP"]
DDL_STATEMENTS = ["CREATE_TABLE", "ALTER_TABLE", "DROP_TABLE", "CREATE_VIEW", "ALTER_VIEW", "DROP_VIEW",
                  "CREATE_SCHEMA", "DROP_SCHEMA", "CREATE_DATABASE", "DROP_DATABASE", "GRANT", "REVOKE"]
RISK_POINTS = {"admin": 50, "escalation": 30, "phi": 25, "confidential": 40, "logins": 20}


def login_audit(logins: DataFrame, as_of: Column) -> DataFrame:
    ip, failed = F.col("client_ip"), F.col("is_success") == "NO"
    status = first_match(
        [(failed, "FAILED"), (F.col("second_authentication_factor").isNotNull(), "SUCCESS_MFA")], "SUCCESS"
    )
    risk = first_match([(failed, "HIGH"), (~ip.like("10.%") & ~ip.like("192.168.%"), "MEDIUM")], "LOW")
    return recent(logins, "event_timestamp", as_of, 90, "DAY").select(
        "event_id", F.col("event_timestamp").alias("login_timestamp"), "user_name", "client_ip",
        F.col("reported_client_type").alias("client_type"), F.col("reported_client_version").alias("client_version"),
        F.col("first_authentication_factor").alias("auth_method"),
        F.col("second_authentication_factor").alias("mfa_method"), F.col("is_success").alias("login_success"),
        "error_code", "error_message", status.alias("login_status"), risk.alias("risk_level"),
    )


def role_grant_history(grants_to_users: DataFrame, grants_to_roles: DataFrame, as_of: Column) -> DataFrame:
    def shape(df: DataFrame, kind: str, role: str, grantee_type: str) -> DataFrame:
        name = F.col(role)
        level = first_match([(name.isin(TOP_ROLES), "CRITICAL"), (name.like("%ADMIN%"), "HIGH")], "NORMAL")
        live = recent(df, "created_on", as_of, 180, "DAY").filter(F.col("deleted_on").isNull())
        return live.select(
            F.col("created_on").alias("grant_timestamp"), F.lit(kind).alias("grant_type"), name.alias("granted_role"),
            "grantee_name", F.lit(grantee_type).alias("grantee_type"), "granted_by", level.alias("sensitivity_level"),
        )

    to_roles = grants_to_roles.filter((F.col("granted_on") == "ROLE") & (F.col("privilege") == "USAGE"))
    return shape(grants_to_users, "USER_GRANT", "role", "USER").unionByName(
        shape(to_roles, "ROLE_GRANT", "name", "ROLE")
    )


def privilege_escalation_events(grants_to_roles: DataFrame, as_of: Column) -> DataFrame:
    privilege, name = F.col("privilege"), F.col("name")
    owner, governs = privilege == "OWNERSHIP", privilege.isin(GOVERNANCE_PRIVILEGES)
    kind = first_match(
        [
            (owner, "OWNERSHIP_TRANSFER"),
            (governs, "GOVERNANCE_PRIVILEGE"),
            (name.isin("ACCOUNTADMIN", "SECURITYADMIN", "ORGADMIN"), "ADMIN_ROLE_GRANT"),
        ],
        "OTHER_ESCALATION",
    )
    severity = first_match(
        [
            (name.isin("ACCOUNTADMIN", "ORGADMIN"), "CRITICAL"),
            (owner, "CRITICAL"),
            (name == "SECURITYADMIN", "HIGH"),
            (privilege.like("APPLY%"), "HIGH"),
        ],
        "MEDIUM",
    )
    risky = owner | governs | ((F.col("granted_on") == "ROLE") & name.isin(TOP_ROLES))
    return recent(grants_to_roles, "created_on", as_of, 180, "DAY").filter(risky & F.col("deleted_on").isNull()).select(
        F.col("created_on").alias("event_timestamp"), privilege.alias("privilege_granted"),
        F.col("granted_on").alias("object_type"), name.alias("object_name"), F.col("grantee_name").alias("grantee"),
        "granted_by", F.lit("HIGH_RISK").alias("risk_flag"), kind.alias("escalation_type"), severity.alias("severity"),
    )


def phi_data_access(queries: DataFrame, tags: DataFrame, as_of: Column) -> DataFrame:
    """Statements against schemas with tagged columns: one row per statement and tagged column."""
    tagged = tags.filter(
        (F.col("tag_database") == "HEALTH_GOVERNANCE_DB") & (F.col("tag_schema") == "SECURITY")
        & (F.col("tag_name") == "PHI_CLASSIFICATION")
        & F.col("tag_value").isin("DIRECT_PHI", "QUASI_PHI", "CLINICAL")
    ).select("object_database", "object_schema", "object_name", "column_name", "tag_value")
    warehouse, tag = F.col("warehouse_name"), F.col("tag_value")
    ran = recent(queries, "start_time", as_of, 90, "DAY").filter(
        (warehouse.like("HEALTH_%") | (warehouse == "COMPUTE_WH"))
        & F.col("query_type").isin("SELECT", "INSERT", "UPDATE", "MERGE", "DELETE")
    )
    level = first_match(
        [(tag == "DIRECT_PHI", "CRITICAL"), (tag == "CLINICAL", "HIGH"), (tag == "QUASI_PHI", "MEDIUM")], "LOW"
    )
    violation = ~F.col("role_name").isin(PHI_ROLES) & (tag == "DIRECT_PHI")
    on = [ran.database_name == tagged.object_database, ran.schema_name == tagged.object_schema]
    return ran.join(tagged, on).select(
        "query_id", F.col("start_time").alias("access_timestamp"), "user_name", "role_name", "warehouse_name",
        F.col("database_name").alias("database_accessed"), F.col("schema_name").alias("schema_accessed"),
        F.coalesce("object_name", F.lit("UNKNOWN")).alias("table_accessed"),
        F.coalesce("column_name", F.lit("UNKNOWN")).alias("column_accessed"), tag.alias("phi_classification"),
        F.left("query_text", F.lit(500)).alias("query_text_preview"), "execution_status",
        (F.col("total_elapsed_time") / 1000).alias("execution_seconds"), level.alias("sensitivity_level"),
        F.when(violation, "POTENTIAL_VIOLATION").otherwise("AUTHORIZED").alias("access_assessment"),
    )


def phi_access_log(queries: DataFrame, access: DataFrame, as_of: Column) -> DataFrame:
    touched = access.filter(F.array_join("direct_objects_accessed", ",").ilike("%PATIENT%"))
    review = ~F.col("role_name").isin(PHI_ROLES)
    return recent(queries, "start_time", as_of, 90, "DAY").join(touched, "query_id").select(
        "query_id", F.col("start_time").alias("access_timestamp"), "user_name", "role_name", "warehouse_name",
        F.array_join("direct_objects_accessed", ",").alias("objects_accessed"),
        F.left("query_text", F.lit(500)).alias("query_text_preview"), "execution_status",
        F.when(review, "REQUIRES_REVIEW").otherwise("AUTHORIZED").alias("access_assessment"),
    )


def _policy_usage(references: DataFrame, policies: DataFrame, kind: str, levels: list) -> DataFrame:
    live = policies.filter(F.col("deleted").isNull()).select(
        "policy_name", F.col("policy_catalog").alias("policy_db"), "policy_schema", "policy_owner",
        F.col("created").alias("policy_created"),
    )
    name = F.col("policy_name")
    return (
        references.filter((F.col("policy_kind") == kind) & F.col("ref_database_name").like("HEALTH_%"))
        .join(live, ["policy_name", "policy_db", "policy_schema"])
        .select(
            name, F.col("policy_db").alias("policy_database"), "policy_schema",
            F.col("ref_database_name").alias("protected_database"), F.col("ref_schema_name").alias("protected_schema"),
            F.col("ref_entity_name").alias("protected_table"), F.col("ref_column_name").alias("protected_column"),
            F.col("ref_entity_domain").alias("object_type"), "policy_owner", "policy_created",
            first_match([(name.like(p), level) for p, level in levels], "STANDARD").alias("protection_level"),
        )
    )


def masking_policy_usage(references: DataFrame, policies: DataFrame) -> DataFrame:
    levels = [("%SSN%", "CRITICAL"), ("%PHI%", "CRITICAL"), ("%DOB%", "HIGH"), ("%PHONE%", "HIGH"), ("%EMAIL%", "HIGH")]
    return _policy_usage(references, policies, "MASKING_POLICY", levels).withColumnRenamed(
        "policy_name", "masking_policy_name"
    )


def row_policy_usage(references: DataFrame, policies: DataFrame) -> DataFrame:
    levels = [("%CARE_TEAM%", "HIGH"), ("%DATA_QUALITY%", "MEDIUM")]
    return _policy_usage(references, policies, "ROW_ACCESS_POLICY", levels).withColumnRenamed(
        "policy_name", "row_access_policy_name"
    ).drop("protected_column")


def _change(df: DataFrame, statement_length: int, *extra: Column) -> DataFrame:
    return df.select(
        "query_id", F.col("start_time").alias("change_timestamp"), F.col("user_name").alias("changed_by"),
        F.col("role_name").alias("role_used"), F.col("query_type").alias("operation_type"),
        F.col("database_name").alias("target_database"), F.col("schema_name").alias("target_schema"),
        F.left("query_text", F.lit(statement_length)).alias("ddl_statement"),
        F.col("execution_status").alias("status"), *extra,
    )


def tag_change_history(queries: DataFrame, as_of: Column) -> DataFrame:
    """Tag statements. Removing a tag from an object is tested before setting one."""
    text = F.col("query_text")
    says = lambda words: text.ilike(f"%{words}%")
    severity = first_match(
        [(says("DROP TAG"), "CRITICAL"), (says("UNSET TAG"), "HIGH"), (says("ALTER TAG"), "MEDIUM"),
         (says("SET TAG"), "MEDIUM")],
        "LOW",
    )
    about_tags = says("CREATE TAG") | says("ALTER TAG") | says("DROP TAG") | says("SET TAG") | says("UNSET TAG")
    found = recent(queries, "start_time", as_of, 180, "DAY").filter(
        F.col("query_type").isin(TAG_STATEMENTS) & about_tags
    )
    return _change(found, 1000, severity.alias("change_severity"))


def policy_change_history(queries: DataFrame, as_of: Column) -> DataFrame:
    text = F.col("query_text")
    masking, rows = text.ilike("%MASKING POLICY%"), text.ilike("%ROW ACCESS POLICY%")
    kind = first_match([(masking, "MASKING_POLICY"), (rows, "ROW_ACCESS_POLICY")], "OTHER_POLICY")
    severity = first_match(
        [(text.ilike("%DROP%POLICY%"), "CRITICAL"), (text.ilike("%ALTER%POLICY%"), "HIGH"),
         (text.ilike("%CREATE%POLICY%"), "MEDIUM")],
        "LOW",
    )
    found = recent(queries, "start_time", as_of, 180, "DAY").filter(
        F.col("query_type").isin(POLICY_STATEMENTS) & (masking | rows)
    )
    return _change(found, 1000, kind.alias("policy_type"), severity.alias("change_severity"))


def user_inventory(users: DataFrame, as_of: Column) -> DataFrame:
    last, off = F.col("last_success_login"), F.col("disabled")
    idle = dates.days_between(last, as_of)
    status = first_match(
        [(off == "true", "DISABLED"), (last.isNull(), "NEVER_LOGGED_IN"), (idle > 90, "DORMANT_90D"),
         (idle > 30, "DORMANT_30D")],
        "ACTIVE",
    )
    risk = first_match([((F.col("has_mfa") == "false") & (off == "false"), "HIGH"), (idle > 90, "MEDIUM")], "LOW")
    return users.select(
        F.col("name").alias("user_name"), "login_name", "display_name", "email", "default_role", "default_warehouse",
        "created_on", last.alias("last_login"), off.alias("is_disabled"), "has_mfa",
        idle.alias("days_since_last_login"), status.alias("account_status"), risk.alias("risk_level"),
    ).orderBy(F.desc_nulls_last("last_login"), "user_name")


def session_audit(sessions: DataFrame, as_of: Column) -> DataFrame:
    method = F.col("authentication_method")
    flag = first_match(
        [
            (F.col("is_open") & (dates.hours_between(F.col("created_on"), as_of) > 8), "EXTENDED_SESSION"),
            (~method.like("%MFA%") & ~method.like("%MULTI%"), "NO_MFA"),
        ],
        "NORMAL",
    )
    return recent(sessions, "created_on", as_of, 90, "DAY").select(
        "session_id", "user_name", F.col("created_on").alias("login_time"), F.col("is_open").alias("is_session_open"),
        "closed_reason", F.col("client_application_id").alias("client_application"),
        F.col("client_application_version").alias("client_version"), "client_environment",
        method.alias("auth_method"), flag.alias("session_flag"),
    )


def admin_activity(queries: DataFrame, as_of: Column) -> DataFrame:
    role, kind = F.col("role_name"), F.col("query_type")
    level = first_match(
        [(role == "ACCOUNTADMIN", "CRITICAL"), (role == "SECURITYADMIN", "HIGH"), (role == "SYSADMIN", "MEDIUM")], "OTHER"
    )
    category = first_match(
        [
            (kind.isin("GRANT", "REVOKE"), "PRIVILEGE_CHANGE"),
            (kind.isin("CREATE_USER", "ALTER_USER", "DROP_USER"), "USER_MANAGEMENT"),
            (kind.isin("CREATE_ROLE", "DROP_ROLE"), "ROLE_MANAGEMENT"),
            (kind.like("CREATE%") | kind.like("DROP%"), "DDL_OPERATION"),
        ],
        "OTHER_OPERATION",
    )
    return recent(queries, "start_time", as_of, 90, "DAY").filter(
        role.isin("ACCOUNTADMIN", "SECURITYADMIN", "SYSADMIN") & (F.col("execution_status") == "SUCCESS")
    ).select(
        "query_id", F.col("start_time").alias("activity_timestamp"), "user_name", role.alias("admin_role"),
        kind.alias("operation_type"), F.col("database_name").alias("target_database"),
        F.col("schema_name").alias("target_schema"), "warehouse_name",
        F.left("query_text", F.lit(500)).alias("query_text_preview"), F.col("execution_status").alias("status"),
        (F.col("total_elapsed_time") / 1000).alias("execution_seconds"), F.col("rows_produced").alias("rows_affected"),
        level.alias("privilege_level"), category.alias("activity_category"),
    )


def ddl_change_log(queries: DataFrame, as_of: Column) -> DataFrame:
    kind = F.col("query_type")
    severity = first_match(
        [(kind.like("DROP%"), "HIGH"), (kind.isin("GRANT", "REVOKE"), "HIGH"), (kind.like("ALTER%"), "MEDIUM")], "LOW"
    )
    found = recent(queries, "start_time", as_of, 90, "DAY").filter(kind.isin(DDL_STATEMENTS))
    return _change(found, 500, severity.alias("change_severity"))


def retention_compliance(tags: DataFrame, tables: DataFrame) -> DataFrame:
    tagged = tags.filter(
        (F.col("tag_database") == "HEALTH_GOVERNANCE_DB") & (F.col("tag_schema") == "SECURITY")
        & (F.col("tag_name") == "RETENTION_POLICY") & F.col("object_database").like("HEALTH_%")
    )
    value, created = F.col("tag_value"), F.col("created")
    until = (
        F.when(value == "7_YEARS", created + F.expr("INTERVAL 7 YEARS"))
        .when(value == "10_YEARS", created + F.expr("INTERVAL 10 YEARS"))
        .when(value == "1_YEAR", created + F.expr("INTERVAL 1 YEAR"))
    )
    status = first_match(
        [(value == "PERMANENT", "NEVER_DELETE"), (value.isNull(), "UNTAGGED_REVIEW_REQUIRED")], "RETENTION_ACTIVE"
    )
    on = [
        tagged.object_database == tables.table_catalog, tagged.object_schema == tables.table_schema,
        tagged.object_name == tables.table_name,
    ]
    return tagged.join(tables.filter(F.col("deleted").isNull()), on).select(
        F.col("object_database").alias("database_name"), F.col("object_schema").alias("schema_name"),
        F.col("object_name").alias("table_name"), value.alias("retention_policy"), created.alias("table_created"),
        "row_count", (F.col("bytes") / 1073741824).alias("size_gb"), until.alias("earliest_deletion_date"),
        status.alias("retention_status"), F.lit("HIPAA/CMS").alias("regulatory_reference"),
    )


def user_risk_score(
    queries: DataFrame, grants_to_roles: DataFrame, tags: DataFrame, logins: DataFrame, as_of: Column
) -> DataFrame:
    """Five signals per user that ran a statement in the last 90 days.

    Each tagged column of a database counts once per statement against that database. Tags are
    counted per database and statements per user and database before the two meet.
    """
    ran = recent(queries, "start_time", as_of, 90, "DAY")
    outside = ~F.col("role_name").isin(PHI_ROLES)
    admin = (F.col("role_name") == "ACCOUNTADMIN") & (F.col("execution_status") == "SUCCESS")
    per_database = ran.groupBy("user_name", "database_name").agg(
        F.count("*").alias("statements"),
        F.count(F.when(outside, 1)).alias("outside_statements"),
        F.count(F.when(admin, 1)).alias("admin_statements"),
    )
    direct = (F.col("tag_name") == "PHI_CLASSIFICATION") & (F.col("tag_value") == "DIRECT_PHI")
    secret = (F.col("tag_name") == "DATA_SENSITIVITY") & (F.col("tag_value") == "HIGHLY_CONFIDENTIAL")
    tag_counts = tags.groupBy(F.col("object_database").alias("database_name")).agg(
        F.count(F.when(direct, 1)).alias("direct_tags"), F.count(F.when(secret, 1)).alias("secret_tags")
    )
    access = per_database.join(tag_counts, "database_name", "left").groupBy("user_name").agg(
        F.sum("admin_statements").alias("accountadmin_queries"),
        F.sum(F.col("statements") * F.coalesce("direct_tags", F.lit(0))).alias("phi_access_count"),
        F.sum(F.col("outside_statements") * F.coalesce("secret_tags", F.lit(0))).alias("confidential_access_count"),
    )
    raised = (
        recent(grants_to_roles, "created_on", as_of, 90, "DAY")
        .filter((F.col("privilege") == "OWNERSHIP") | F.col("name").isin("ACCOUNTADMIN", "SECURITYADMIN"))
        .filter(F.col("deleted_on").isNull())
        .groupBy(F.col("granted_by").alias("user_name"))
        .agg(F.count("*").alias("privilege_escalations"))
    )
    failed = (
        recent(logins, "event_timestamp", as_of, 90, "DAY")
        .filter(F.col("is_success") == "NO")
        .groupBy("user_name").agg(F.count("*").alias("failed_logins"))
        .filter(F.col("failed_logins") >= 3)
    )
    signals = {
        "accountadmin_queries": "admin", "privilege_escalations": "escalation", "phi_access_count": "phi",
        "confidential_access_count": "confidential", "failed_logins": "logins",
    }
    wide = access.join(raised, "user_name", "left").join(failed, "user_name", "left").fillna(0)
    score = sum((F.when(F.col(c) > 0, RISK_POINTS[s]).otherwise(0) for c, s in signals.items()), F.lit(0))
    level = first_match(
        [(F.col("risk_score") >= 101, "CRITICAL"), (F.col("risk_score") >= 51, "HIGH"),
         (F.col("risk_score") >= 26, "MEDIUM")],
        "LOW",
    )
    return wide.withColumn("risk_score", score).withColumn("risk_level", level).select(
        "user_name", *signals, "risk_score", "risk_level"
    )
