"""Log tables in SQL and the expected results of the usage, alert and audit queries."""

from __future__ import annotations

from checks.sqltext import LOG_DAY, pad, pick, r, values
from pulsemart.sources import logs as G

USER = "('USER_' || user_id::VARCHAR)"
TEXTS = pick([s[1] for s in G.STATEMENTS], "event_id")
KINDS = pick([s[0] for s in G.STATEMENTS], "event_id")
QUOTA = "CASE warehouse_name " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in G.QUOTAS.items()) + " END"
PRIVILEGES = ["USAGE", "OWNERSHIP", "APPLY MASKING POLICY", "SELECT", "APPLY TAG", "APPLY ROW ACCESS POLICY"]

TABLES = {
    "log_events": "SELECT *, ts - to_days(CAST(event_id // 11 % 5 * 40 AS INTEGER)) AS log_time FROM events",
    "query_history": f"""
        SELECT {pad('Q-', 'event_id')} AS query_id, {TEXTS} AS query_text, {USER} AS user_name,
               {pick(G.ROLES, 'event_id // 7')} AS role_name, {pick(G.WAREHOUSES, 'event_id')} AS warehouse_name,
               {pick(G.SIZES, 'event_id')} AS warehouse_size, {pick(G.DATABASES, 'event_id // 3')} AS database_name,
               {pick(G.SCHEMAS, 'event_id // 13')} AS schema_name, {KINDS} AS query_type,
               CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'SUCCESS' END AS execution_status,
               CASE WHEN event_type = 'error' THEN '100' || (event_id % 10)::VARCHAR END AS error_code,
               CASE WHEN event_type = 'error' THEN 'Statement failed' END AS error_message, log_time AS start_time,
               log_time + to_minutes(CAST(round(value * 1000) AS BIGINT) // 60000) AS end_time,
               CAST(round(value * 1000) AS BIGINT) AS total_elapsed_time, event_id % 900 AS compilation_time,
               event_id % 4000 AS queued_overload_time, (event_id * 7919) % 100003 * 1048576 AS bytes_scanned,
               event_id % 5000 AS rows_produced, event_id % 100 AS partitions_scanned, event_id % 400 AS partitions_total,
               (event_id % 64) / 64.0::DOUBLE AS credits_used_cloud_services FROM log_events""",
    "warehouse_load_history": f"""
        SELECT {pick(G.WAREHOUSES, 'event_id')} AS warehouse_name, log_time AS start_time,
               log_time + INTERVAL 5 MINUTES AS end_time, (event_id % 48) / 4.0::DOUBLE AS avg_running,
               (event_id // 5 % 28) / 4.0::DOUBLE AS avg_queued_load,
               (event_id // 9 % 8) / 8.0::DOUBLE AS avg_queued_provisioning,
               (event_id // 17 % 3) / 2.0::DOUBLE AS avg_blocked FROM log_events""",
    "warehouse_metering_history": f"""
        SELECT {pick(G.WAREHOUSES, 'event_id')} AS warehouse_name, date_trunc('hour', log_time) AS start_time,
               (event_id // 5 % 32) / 16.0::DOUBLE AS credits_used,
               (event_id // 5 % 32) / 32.0::DOUBLE AS credits_used_compute,
               (event_id // 5 % 32) / 32.0::DOUBLE AS credits_used_cloud_services FROM log_events""",
    "login_history": f"""
        SELECT event_id, log_time AS event_timestamp, {USER} AS user_name,
               CASE WHEN event_id % 23 <> 0 THEN
                 {pick(['10.1.1.1', '192.168.0.7', '8.8.8.8', '172.16.0.9'], 'event_id')} END AS client_ip,
               {pick(['WEB', 'JDBC', 'PYTHON'], 'event_id')} AS reported_client_type,
               {pick(['1.0', '1.1'], 'event_id')} AS reported_client_version,
               'PASSWORD' AS first_authentication_factor,
               CASE WHEN event_id // 2 % 3 = 0 THEN 'MFA_TOKEN' END AS second_authentication_factor,
               CASE WHEN event_type = 'error' THEN 'NO' ELSE 'YES' END AS is_success,
               CASE WHEN event_type = 'error' THEN '390100' END AS error_code,
               CASE WHEN event_type = 'error' THEN 'Incorrect password' END AS error_message,
               'DIRECT' AS connection FROM log_events""",
    "data_transfer_history": f"""
        SELECT log_time AS start_time, {pick(['AWS', 'AZURE'], 'event_id')} AS source_cloud,
               {pick(['us-east-1', 'us-west-2'], 'event_id')} AS source_region,
               {pick(['AWS', 'GCP'], 'event_id // 2')} AS target_cloud,
               {pick(['eu-west-1', 'us-east-1'], 'event_id // 2')} AS target_region,
               {pick(['COPY', 'REPLICATION', 'EXTERNAL_ACCESS'], 'event_id')} AS transfer_type,
               (event_id * 104729) % 1000003 * 1024 AS bytes_transferred FROM log_events""",
    "storage_usage": """
        SELECT CAST(ts AS DATE) AS usage_date,
               CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 1000000 AS storage_bytes,
               count(*) * 1000000000 AS stage_bytes,
               count(CASE WHEN event_type = 'error' THEN 1 END) * 1000000000 AS failsafe_bytes
        FROM events GROUP BY 1""",
    "database_storage_usage_history": f"""
        SELECT CAST(ts AS DATE) AS usage_date, {pick(G.DATABASES, 'event_id // 3')} AS database_name,
               CAST(count(*) * 1500000000 AS DOUBLE) AS average_database_bytes,
               CAST(count(CASE WHEN event_type = 'error' THEN 1 END) * 1000000000 AS DOUBLE) AS average_failsafe_bytes
        FROM events GROUP BY 1, 2""",
    "resource_monitors": f"""
        SELECT 'HEALTH_' || replace(warehouse_name, 'HEALTH_', '') || '_MONITOR' AS name, {QUOTA} AS credit_quota,
               used_credits, {QUOTA} - used_credits AS remaining_credits, warehouse_name AS warehouses
        FROM (SELECT warehouse_name, sum(credits_used) AS used_credits FROM warehouse_metering_history GROUP BY 1)""",
    "grants_to_users": f"""
        SELECT log_time AS created_on, CASE WHEN event_id % 6 = 0 THEN ts END AS deleted_on,
               {pick(G.ROLES, 'event_id // 7')} AS role, {USER} AS grantee_name,
               'USER_' || (event_id % 50)::VARCHAR AS granted_by FROM log_events WHERE event_type = 'signup'""",
    "grants_to_roles": f"""
        SELECT log_time AS created_on, CASE WHEN event_id % 9 = 0 THEN ts END AS deleted_on,
               {pick(PRIVILEGES, 'event_id')} AS privilege, {pick(['ROLE', 'TABLE'], 'event_id // 6')} AS granted_on,
               {pick(G.ROLES, 'event_id // 7')} AS name, {pick(G.ROLES, 'event_id // 5')} AS grantee_name,
               {USER} AS granted_by FROM log_events WHERE event_type = 'click'""",
    "extract_tables": """
        SELECT 'HEALTH_ANALYTICS_DB' AS table_catalog, 'REPORTING' AS table_schema,
               'EXTRACT_' || user_id::VARCHAR AS table_name, user_id, min(ts) AS created, count(*) AS row_count,
               count(*) * 134217728 AS bytes, CASE WHEN user_id % 17 = 0 THEN min(ts) END AS deleted
        FROM events GROUP BY user_id""",
    "tag_references": f"""
        SELECT * FROM ({values(G.TAGS, ['tag_name', 'tag_value', 'object_database', 'object_schema', 'object_name',
                                        'column_name'])})
        UNION ALL
        SELECT 'RETENTION_POLICY', CASE user_id % 5 WHEN 0 THEN '7_YEARS' WHEN 1 THEN '10_YEARS' WHEN 2 THEN 'PERMANENT'
               WHEN 3 THEN '1_YEAR' END, table_catalog, table_schema, table_name, NULL FROM extract_tables""",
    "access_history": f"""
        SELECT {pad('Q-', 'event_id')} AS query_id,
               ([['HEALTH_TRANSFORM_DB.MASTER.DIM_PATIENT', 'HEALTH_TRANSFORM_DB.CLEANSED.FACT_ENCOUNTER'],
                 ['HEALTH_TRANSFORM_DB.CLEANSED.FACT_LAB_RESULT'],
                 ['HEALTH_TRANSFORM_DB.CLEANSED.FACT_DIAGNOSIS', 'raw_patients'], []])[event_id % 4 + 1]
                 AS direct_objects_accessed FROM events WHERE event_type <> 'view'""",
    "policy_references": f"""
        SELECT {pick(G.POLICIES, 'event_id')} AS policy_name,
               CASE WHEN event_id % 31 = 0 THEN 'TEST_DB' ELSE {pick(G.DATABASES, 'event_id // 3')} END
                 AS ref_database_name, {pick(G.SCHEMAS, 'event_id // 13')} AS ref_schema_name,
               'EXTRACT_' || user_id::VARCHAR AS ref_entity_name, 'COLUMN_' || event_id::VARCHAR AS ref_column_name
        FROM events WHERE event_type = 'view'""",
    "platform_users": f"""
        SELECT {USER} AS name, lower({USER}) AS login_name, 'User ' || user_id::VARCHAR AS display_name,
               'user' || user_id::VARCHAR || '@example.org' AS email, {pick(G.ROLES, 'user_id')} AS default_role,
               {pick(G.WAREHOUSES, 'user_id')} AS default_warehouse, min(ts) - INTERVAL 400 DAYS AS created_on,
               CASE WHEN user_id % 10 <> 9 THEN max(CASE WHEN event_type <> 'error' THEN ts END)
                 - to_days(CAST(user_id % 5 * 30 AS INTEGER)) END AS last_success_login,
               CASE WHEN user_id % 13 = 0 THEN 'true' ELSE 'false' END AS disabled,
               CASE WHEN user_id % 3 = 0 THEN 'false' ELSE 'true' END AS has_mfa FROM events GROUP BY user_id""",
    "platform_sessions": f"""
        SELECT event_id AS session_id, {USER} AS user_name, log_time AS created_on, event_id % 2 = 0 AS is_open,
               CASE WHEN event_id % 2 = 1 THEN 'LOGOUT' END AS closed_reason,
               {pick(['WEB_UI', 'JDBC_DRIVER'], 'event_id')} AS client_application_id,
               {pick(['7.1', '7.2', '8.0'], 'event_id')} AS client_application_version,
               CASE WHEN event_id % 7 <> 0 THEN
                 {pick(['PASSWORD', 'PASSWORD_MFA', 'MULTI_FACTOR', 'KEYPAIR'], 'event_id // 3')} END
                 AS authentication_method FROM log_events WHERE event_type = 'purchase'""",
    "platform_roles": f"""
        SELECT name, min(created_on) AS created_on, {pick(['ACCOUNTADMIN', 'USERADMIN', 'SYSADMIN'], 'count(*)')} AS owner
        FROM grants_to_roles GROUP BY 1""",
}


def ago(column: str, amount: int, unit: str) -> str:
    return f"{column} >= {LOG_DAY} - INTERVAL {amount} {unit}"


def stamp(column: str, alias: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {alias or column}"


def text_date(expression: str, alias: str) -> str:
    return f"CAST(CAST({expression} AS DATE) AS VARCHAR) AS {alias}"


OURS = "warehouse_name LIKE 'HEALTH_%'"
MONTH_BACK = f"{ago('start_time', 30, 'DAY')} AND {OURS}"
GB, TB = "1073741824.0::DOUBLE", "1099511627776.0::DOUBLE"
CREDITS = "sum(credits_used_cloud_services)"
TOTAL = "(sum(credits_used) + sum(credits_used_cloud_services))"

LONG = f"SELECT * FROM query_history WHERE {MONTH_BACK} AND total_elapsed_time > 300000"
FAILED = f"SELECT * FROM query_history WHERE {MONTH_BACK} AND execution_status = 'FAIL'"
LOAD = f"""
    SELECT warehouse_name, count(*) AS sample_count, {r('avg(avg_running)', 2)} AS avg_queries_running,
           {r('avg(avg_queued_load)', 2)} AS avg_queries_queued, {r('avg(avg_blocked)', 2)} AS avg_queries_blocked,
           {r('max(avg_running)', 2)} AS peak_queries_running, {r('max(avg_queued_load)', 2)} AS peak_queries_queued,
           {stamp('min(start_time)', 'period_start')}, {stamp('max(end_time)', 'period_end')}
    FROM warehouse_load_history WHERE {ago('start_time', 24, 'HOUR')} AND {OURS} GROUP BY 1"""
COST = f"""
    SELECT warehouse_name, {text_date("date_trunc('month', start_time)", 'usage_month')},
           {r('sum(credits_used)', 4)} AS compute_credits,
           {r('sum(credits_used_cloud_services)', 4)} AS cloud_services_credits, {r(TOTAL, 4)} AS total_credits,
           count(DISTINCT CAST(start_time AS DATE)) AS active_days,
           {r(TOTAL + " / nullif(count(DISTINCT CAST(start_time AS DATE)), 0)", 4)} AS avg_credits_per_day,
           {r(TOTAL + ' * 3', 2)} AS estimated_cost_usd
    FROM warehouse_metering_history WHERE {ago('start_time', 12, 'MONTH')} AND {OURS} GROUP BY 1, 2"""
QUOTAS = f"""
    SELECT name AS monitor_name, credit_quota, used_credits, remaining_credits,
           {r('used_credits / nullif(credit_quota, 0) * 100', 2)} AS usage_percent, '75%' AS notify_at_percent,
           '90%' AS suspend_at_percent, '100%' AS suspend_immediate_at_percent, warehouses,
           '2023-01-01 00:00:00.000000' AS created FROM resource_monitors"""


def alert(name: str, value: str, fired: str, source: str) -> str:
    return f"SELECT '{name}' AS alert, {fired} AS fired, value FROM (SELECT CAST({value} AS DOUBLE) AS value FROM {source})"


def change(length: int, extra: str, where: str) -> str:
    return f"""
        SELECT query_id, {stamp('start_time', 'change_timestamp')}, user_name AS changed_by, role_name AS role_used,
               query_type AS operation_type, database_name AS target_database, schema_name AS target_schema,
               left(query_text, {length}) AS ddl_statement, execution_status AS status, {extra}
        FROM query_history WHERE {where}"""


def policy_usage(column: str, prefix: str, level: str, extra: str) -> str:
    return f"""
        SELECT policy_name AS {column}, 'HEALTH_GOVERNANCE_DB' AS policy_database, 'MONITORING' AS policy_schema,
               ref_database_name AS protected_database, ref_schema_name AS protected_schema,
               ref_entity_name AS protected_table, {extra} 'TABLE' AS object_type, 'HEALTH_DATA_ADMIN' AS policy_owner,
               '2023-02-01 00:00:00.000000' AS policy_created, {level} AS protection_level
        FROM policy_references
        WHERE policy_name LIKE '{prefix}%' AND ref_database_name LIKE 'HEALTH_%' AND policy_name <> 'MASK_OLD'"""


def sensitivity(role: str) -> str:
    return f"""CASE WHEN {role} IN ('ACCOUNTADMIN', 'SECURITYADMIN', 'SYSADMIN', 'ORGADMIN') THEN 'CRITICAL'
               WHEN {role} LIKE '%ADMIN%' THEN 'HIGH' ELSE 'NORMAL' END"""


INSIDE = "('HEALTH_DATA_ADMIN', 'HEALTH_ANALYST', 'ACCOUNTADMIN')"
IDLE = f"CAST(CAST({LOG_DAY} AS DATE) - CAST(last_success_login AS DATE) AS BIGINT)"
SCORE = """(CASE WHEN au.n IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN pe.n IS NOT NULL THEN 30 ELSE 0 END
            + CASE WHEN pa.n IS NOT NULL THEN 25 ELSE 0 END + CASE WHEN ca.n IS NOT NULL THEN 40 ELSE 0 END
            + CASE WHEN fl.n IS NOT NULL THEN 20 ELSE 0 END)"""

SQL = {
    "o1_daily_warehouse_credits": f"""
        SELECT {text_date('start_time', 'usage_date')}, warehouse_name, sum(credits_used) AS total_credits,
               sum(credits_used_compute) AS compute_credits,
               sum(credits_used_cloud_services) AS cloud_services_credits, count(*) AS query_count,
               {r('sum(credits_used) * 3', 2)} AS estimated_cost_usd
        FROM warehouse_metering_history WHERE {MONTH_BACK} GROUP BY 1, 2""",
    "o2_monthly_credit_summary": f"""
        SELECT {text_date("date_trunc('month', start_time)", 'usage_month')}, warehouse_name,
               sum(credits_used) AS total_credits, {r('sum(credits_used) * 3', 2)} AS estimated_cost_usd
        FROM warehouse_metering_history WHERE {ago('start_time', 12, 'MONTH')} AND {OURS} GROUP BY 1, 2""",
    "o3_credits_by_user": f"""
        SELECT user_name, count(DISTINCT query_id) AS total_queries, {CREDITS} AS total_credits,
               {r('avg(total_elapsed_time) / 1000', 2)} AS avg_query_seconds, {r(CREDITS + ' * 3', 2)} AS estimated_cost_usd
        FROM query_history WHERE {MONTH_BACK} GROUP BY 1""",
    "o4_credits_by_role": f"""
        SELECT role_name, count(DISTINCT user_name) AS unique_users, count(DISTINCT query_id) AS total_queries,
               {CREDITS} AS total_credits, {r(CREDITS + ' * 3', 2)} AS estimated_cost_usd
        FROM query_history WHERE {ago('start_time', 30, 'DAY')} AND role_name LIKE 'HEALTH_%' GROUP BY 1""",
    "o5_top_expensive_queries": f"""
        SELECT query_id, substr(query_text, 1, 200) AS query_preview, user_name, role_name, warehouse_name,
               database_name, execution_status, {stamp('start_time')},
               total_elapsed_time / 1000.0::DOUBLE AS elapsed_seconds, bytes_scanned / {GB} AS gb_scanned,
               credits_used_cloud_services AS credits_used,
               {r('credits_used_cloud_services * 3', 4)} AS estimated_cost_usd
        FROM (SELECT * FROM query_history WHERE {MONTH_BACK} AND credits_used_cloud_services > 0
              ORDER BY credits_used_cloud_services DESC, query_id LIMIT 100)""",
    "o6_storage_consumption": f"""
        SELECT CAST(usage_date AS VARCHAR) AS usage_date, {r(f'storage_bytes / {TB}', 4)} AS database_storage_tb,
               {r(f'stage_bytes / {TB}', 4)} AS stage_storage_tb, {r(f'failsafe_bytes / {TB}', 4)} AS failsafe_storage_tb,
               {r(f'(storage_bytes + stage_bytes + failsafe_bytes) / {TB}', 4)} AS total_storage_tb,
               {r(f'(storage_bytes + stage_bytes + failsafe_bytes) / {TB} * 23', 2)} AS estimated_monthly_cost_usd
        FROM storage_usage WHERE {ago('storage_usage.usage_date', 6, 'MONTH')}""",
    "o7_quota_usage": QUOTAS,
    "o8_query_performance": f"""
        SELECT query_id, substr(query_text, 1, 500) AS query_preview, user_name, role_name, warehouse_name,
               warehouse_size, database_name, schema_name, query_type, execution_status, {stamp('start_time')},
               {stamp('end_time')}, {r('total_elapsed_time / 1000.0::DOUBLE', 2)} AS execution_seconds,
               {r('compilation_time / 1000.0::DOUBLE', 2)} AS compile_seconds,
               {r('queued_overload_time / 1000.0::DOUBLE', 2)} AS queue_seconds, bytes_scanned,
               {r(f'bytes_scanned / {GB}', 4)} AS gb_scanned, rows_produced, partitions_scanned, partitions_total,
               {r('partitions_scanned::DOUBLE / nullif(partitions_total, 0) * 100', 2)} AS partition_scan_pct,
               credits_used_cloud_services AS credits_used
        FROM query_history WHERE query_history.{MONTH_BACK}""",
    "o9_long_running_queries": f"""
        SELECT query_id, substr(query_text, 1, 300) AS query_preview, user_name, role_name, warehouse_name,
               warehouse_size, database_name, query_type, execution_status, {stamp('start_time')}, {stamp('end_time')},
               {r('total_elapsed_time / 1000.0::DOUBLE', 2)} AS execution_seconds,
               {r('total_elapsed_time / 60000.0::DOUBLE', 2)} AS execution_minutes, bytes_scanned,
               {r(f'bytes_scanned / {GB}', 2)} AS gb_scanned, rows_produced, partitions_scanned FROM ({LONG})""",
    "o10_failed_queries": f"""
        SELECT query_id, substr(query_text, 1, 300) AS query_preview, user_name, role_name, warehouse_name,
               database_name, schema_name, query_type, execution_status, error_code, error_message,
               {stamp('start_time')}, {r('total_elapsed_time / 1000.0::DOUBLE', 2)} AS execution_seconds
        FROM ({FAILED})""",
    "o11_warehouse_utilization": f"""
        SELECT warehouse_name, {stamp('start_time')}, {stamp('end_time')},
               {r('avg_running', 2)} AS avg_queries_running, {r('avg_queued_load', 2)} AS avg_queries_queued,
               {r('avg_queued_provisioning', 2)} AS avg_queries_provisioning,
               {r('avg_blocked', 2)} AS avg_queries_blocked, {r('avg_running + avg_queued_load', 2)} AS total_load,
               CASE WHEN avg_queued_load > 5 THEN 'HIGH_QUEUE' WHEN avg_running > 10 THEN 'HIGH_LOAD'
                    WHEN avg_blocked > 0 THEN 'BLOCKED' ELSE 'NORMAL' END AS load_status,
               {stamp("date_trunc('hour', warehouse_load_history.start_time)", 'hour_bucket')}
        FROM warehouse_load_history WHERE warehouse_load_history.{MONTH_BACK}""",
    "o12_active_warehouse_load": LOAD,
    "o13_cost_by_month": COST,
    "o14_logins": f"""
        SELECT user_name, reported_client_type AS client_type, first_authentication_factor AS auth_factor_1,
               second_authentication_factor AS auth_factor_2, is_success, error_code, error_message,
               {stamp('event_timestamp', 'login_time')}, client_ip, connection AS connection_name
        FROM login_history WHERE {ago('event_timestamp', 30, 'DAY')}""",
    "o15_data_transfer": f"""
        SELECT {text_date('start_time', 'transfer_date')}, source_cloud, source_region, target_cloud, target_region,
               transfer_type, {r(f'CAST(sum(bytes_transferred) AS DOUBLE) / {GB}', 4)} AS gb_transferred,
               {r(f'CAST(sum(bytes_transferred) AS DOUBLE) / {TB}', 6)} AS tb_transferred
        FROM data_transfer_history WHERE {ago('start_time', 30, 'DAY')} GROUP BY 1, 2, 3, 4, 5, 6""",
    "o16_query_type_summary": f"""
        SELECT query_type, warehouse_name, count(*) AS query_count,
               {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY warehouse_name)', 2)} AS pct_of_warehouse,
               {CREDITS} AS total_credits, {r('avg(total_elapsed_time) / 1000', 2)} AS avg_execution_seconds,
               {r(f'CAST(sum(bytes_scanned) AS DOUBLE) / {TB}', 4)} AS tb_scanned
        FROM query_history WHERE {MONTH_BACK} GROUP BY 1, 2""",
    "o17_database_storage": f"""
        SELECT database_name, {r(f'sum(average_database_bytes) / {GB}', 4)} AS database_size_gb,
               {r(f'sum(average_failsafe_bytes) / {GB}', 4)} AS failsafe_size_gb,
               {r(f'(sum(average_database_bytes) + sum(average_failsafe_bytes)) / {GB}', 4)} AS total_size_gb,
               {r(f'(sum(average_database_bytes) + sum(average_failsafe_bytes)) / {GB} * 23 / 30', 2)}
                 AS estimated_daily_cost_usd
        FROM database_storage_usage_history
        WHERE usage_date = (SELECT max(usage_date) FROM database_storage_usage_history)
          AND database_name LIKE 'HEALTH_%' GROUP BY 1""",
    "o18_weekly_usage": f"""
        SELECT warehouse_name, count(*) AS query_count, {CREDITS} AS total_credits,
               {r('avg(total_elapsed_time) / 1000', 2)} AS avg_query_seconds, {stamp('max(start_time)', 'last_query_time')}
        FROM query_history WHERE {ago('start_time', 7, 'DAY')} AND {OURS} GROUP BY 1""",
    "o19_role_edges": f"""
        SELECT name AS child_role, grantee_name AS parent_role, granted_by, {stamp('created_on')},
               CASE WHEN name NOT IN ('HEALTH_DATA_ADMIN', 'HEALTH_ML_ADMIN', 'HEALTH_APP_ADMIN') THEN 'Functional role'
                    WHEN grantee_name = 'SYSADMIN' THEN 'Correctly grants to SYSADMIN' ELSE 'Check hierarchy' END
                 AS validation_status
        FROM grants_to_roles WHERE name LIKE 'HEALTH_%' AND granted_on = 'ROLE' AND deleted_on IS NULL""",
    "o19_role_owners": f"""
        SELECT name AS role_name, owner AS role_owner, {stamp('created_on')},
               CASE WHEN owner IN ('ACCOUNTADMIN', 'USERADMIN', 'SECURITYADMIN') THEN 'Valid Owner' ELSE 'Check Owner' END
                 AS ownership_status FROM platform_roles WHERE name LIKE 'HEALTH_%'""",
    "r1_quota_critical": alert("RESOURCE_MONITOR_CRITICAL", "count(*)", "value > 0",
                               f"({QUOTAS}) WHERE usage_percent >= 90"),
    "r2_long_running": alert("LONG_RUNNING_QUERY", "count(*)", "value > 0",
                             f"({LONG}) WHERE {ago('start_time', 15, 'MINUTE')}"),
    "r3_failed_spike": alert("FAILED_QUERY_SPIKE", "count(*)", "value > 10",
                             f"({FAILED}) WHERE {ago('start_time', 15, 'MINUTE')}"),
    "r4_high_queue": alert("HIGH_WAREHOUSE_QUEUE", "coalesce(max(avg_queries_queued), 0)", "value > 5", f"({LOAD})"),
    "r5_monthly_cost_spike": f"""
        SELECT 'MONTHLY_COST_SPIKE' AS alert, cur > prev * 1.2::DOUBLE AND prev > 0 AS fired, cur AS value FROM (
          SELECT sum(CASE WHEN usage_month = '2024-01-01' THEN total_credits ELSE 0 END) AS cur,
                 sum(CASE WHEN usage_month = '2023-12-01' THEN total_credits ELSE 0 END) AS prev FROM ({COST}))""",
    "r6_login_failures": alert("LOGIN_FAILURES", "count(*)", "value > 10",
                               f"login_history WHERE is_success = 'NO' AND {ago('event_timestamp', 1, 'HOUR')}"),
    "r7_privilege_escalation": alert("PRIVILEGE_ESCALATION", "count(*)", "value > 0",
                                     f"grants_to_users WHERE role = 'ACCOUNTADMIN' AND {ago('created_on', 1, 'HOUR')}"),
    "r8_data_export": alert("PHI_DATA_EXPORT", "coalesce(max(gb), 0)", "value > 10", f"""
        (SELECT CAST(sum(bytes_transferred) AS DOUBLE) / {GB} AS gb FROM data_transfer_history
         WHERE {ago('start_time', 1, 'DAY')} GROUP BY transfer_type)"""),
    "r9_ai_spend": alert("AI_WH_HIGH_SPEND", "coalesce(sum(credits_used), 0)", "value > 30", f"""
        warehouse_metering_history WHERE warehouse_name = 'HEALTH_AI_WH' AND {ago('start_time', 1, 'DAY')}"""),
    "r10_storage_growth": alert("STORAGE_GROWTH", "coalesce(max((today - yesterday)::DOUBLE / yesterday), 0)",
                                "value > 0.10", f"""
        (SELECT storage_bytes AS today, lag(storage_bytes) OVER (ORDER BY usage_date) AS yesterday
         FROM storage_usage WHERE {ago('usage_date', 2, 'DAY')}) WHERE yesterday > 0"""),
    "a1_login_audit": f"""
        SELECT event_id, {stamp('event_timestamp', 'login_timestamp')}, user_name, client_ip,
               reported_client_type AS client_type, reported_client_version AS client_version,
               first_authentication_factor AS auth_method, second_authentication_factor AS mfa_method,
               is_success AS login_success, error_code, error_message,
               CASE WHEN is_success = 'NO' THEN 'FAILED' WHEN second_authentication_factor IS NOT NULL
                    THEN 'SUCCESS_MFA' ELSE 'SUCCESS' END AS login_status,
               CASE WHEN is_success = 'NO' THEN 'HIGH' WHEN client_ip NOT LIKE '10.%'
                    AND client_ip NOT LIKE '192.168.%' THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
        FROM login_history WHERE {ago('event_timestamp', 90, 'DAY')}""",
    "a2_role_grant_history": f"""
        SELECT {stamp('created_on', 'grant_timestamp')}, 'USER_GRANT' AS grant_type, role AS granted_role, grantee_name,
               'USER' AS grantee_type, granted_by, {sensitivity('role')} AS sensitivity_level
        FROM grants_to_users WHERE {ago('created_on', 180, 'DAY')} AND deleted_on IS NULL
        UNION ALL SELECT {stamp('created_on', 'grant_timestamp')}, 'ROLE_GRANT', name, grantee_name, 'ROLE', granted_by,
               {sensitivity('name')}
        FROM grants_to_roles WHERE granted_on = 'ROLE' AND privilege = 'USAGE' AND {ago('created_on', 180, 'DAY')}
          AND deleted_on IS NULL""",
    "a3_privilege_escalation_events": f"""
        SELECT {stamp('created_on', 'event_timestamp')}, privilege AS privilege_granted, granted_on AS object_type,
               name AS object_name, grantee_name AS grantee, granted_by, 'HIGH_RISK' AS risk_flag,
               CASE WHEN privilege = 'OWNERSHIP' THEN 'OWNERSHIP_TRANSFER'
                    WHEN privilege IN ('APPLY MASKING POLICY', 'APPLY ROW ACCESS POLICY', 'APPLY TAG')
                    THEN 'GOVERNANCE_PRIVILEGE' WHEN name IN ('ACCOUNTADMIN', 'SECURITYADMIN', 'ORGADMIN')
                    THEN 'ADMIN_ROLE_GRANT' ELSE 'OTHER_ESCALATION' END AS escalation_type,
               CASE WHEN name IN ('ACCOUNTADMIN', 'ORGADMIN') THEN 'CRITICAL' WHEN privilege = 'OWNERSHIP' THEN 'CRITICAL'
                    WHEN name = 'SECURITYADMIN' THEN 'HIGH' WHEN privilege LIKE 'APPLY%' THEN 'HIGH' ELSE 'MEDIUM' END
                 AS severity
        FROM grants_to_roles
        WHERE (privilege IN ('OWNERSHIP', 'APPLY MASKING POLICY', 'APPLY ROW ACCESS POLICY', 'APPLY TAG')
               OR (granted_on = 'ROLE' AND name IN ('ACCOUNTADMIN', 'SECURITYADMIN', 'SYSADMIN', 'ORGADMIN')))
          AND {ago('created_on', 180, 'DAY')} AND deleted_on IS NULL""",
    "a4_phi_data_access": f"""
        SELECT query_id, {stamp('start_time', 'access_timestamp')}, user_name, role_name, warehouse_name,
               database_name AS database_accessed, schema_name AS schema_accessed,
               coalesce(object_name, 'UNKNOWN') AS table_accessed, coalesce(column_name, 'UNKNOWN') AS column_accessed,
               tag_value AS phi_classification, left(query_text, 500) AS query_text_preview, execution_status,
               total_elapsed_time / 1000.0::DOUBLE AS execution_seconds,
               CASE tag_value WHEN 'DIRECT_PHI' THEN 'CRITICAL' WHEN 'CLINICAL' THEN 'HIGH' WHEN 'QUASI_PHI' THEN 'MEDIUM'
                    ELSE 'LOW' END AS sensitivity_level,
               CASE WHEN role_name NOT IN {INSIDE} AND tag_value = 'DIRECT_PHI' THEN 'POTENTIAL_VIOLATION'
                    ELSE 'AUTHORIZED' END AS access_assessment
        FROM query_history LEFT JOIN tag_references ON object_database = database_name AND object_schema = schema_name
          AND tag_name = 'PHI_CLASSIFICATION' AND tag_value IN ('DIRECT_PHI', 'QUASI_PHI', 'CLINICAL')
        WHERE {ago('start_time', 90, 'DAY')} AND (warehouse_name LIKE 'HEALTH_%' OR warehouse_name = 'COMPUTE_WH')
          AND query_type IN ('SELECT', 'INSERT', 'UPDATE', 'MERGE', 'DELETE') AND tag_value IS NOT NULL""",
    "a5_phi_access_log": f"""
        SELECT q.query_id, {stamp('start_time', 'access_timestamp')}, user_name, role_name, warehouse_name,
               array_to_string(direct_objects_accessed, ',') AS objects_accessed,
               left(query_text, 500) AS query_text_preview, execution_status,
               CASE WHEN role_name NOT IN {INSIDE} THEN 'REQUIRES_REVIEW' ELSE 'AUTHORIZED' END AS access_assessment
        FROM query_history q JOIN access_history h ON q.query_id = h.query_id
        WHERE {ago('start_time', 90, 'DAY')} AND array_to_string(direct_objects_accessed, ',') ILIKE '%PATIENT%'""",
    "a6_masking_policy_usage": policy_usage(
        "masking_policy_name", "MASK",
        """CASE WHEN policy_name LIKE '%SSN%' THEN 'CRITICAL' WHEN policy_name LIKE '%PHI%' THEN 'CRITICAL'
           WHEN policy_name LIKE '%DOB%' THEN 'HIGH' WHEN policy_name LIKE '%PHONE%' OR policy_name LIKE '%EMAIL%'
           THEN 'HIGH' ELSE 'STANDARD' END""", "ref_column_name AS protected_column,"),
    "a7_row_policy_usage": policy_usage(
        "row_access_policy_name", "ROW",
        """CASE WHEN policy_name LIKE '%CARE_TEAM%' THEN 'HIGH' WHEN policy_name LIKE '%DATA_QUALITY%' THEN 'MEDIUM'
           ELSE 'STANDARD' END""", ""),
    "a8_tag_change_history": change(1000, """
        CASE WHEN query_text ILIKE '%DROP TAG%' THEN 'CRITICAL' WHEN query_text ILIKE '%UNSET TAG%' THEN 'HIGH'
             WHEN query_text ILIKE '%ALTER TAG%' THEN 'MEDIUM' WHEN query_text ILIKE '%SET TAG%' THEN 'MEDIUM'
             ELSE 'LOW' END AS change_severity""", f"""
        {ago('start_time', 180, 'DAY')} AND regexp_matches(upper(query_text), '(CREATE|ALTER|DROP|SET) TAG')
        AND query_type IN ('CREATE', 'ALTER', 'DROP', 'ALTER_TABLE', 'ALTER_TABLE_MODIFY_COLUMN')"""),
    "a9_policy_change_history": change(1000, """
        CASE WHEN query_text ILIKE '%MASKING POLICY%' THEN 'MASKING_POLICY'
             WHEN query_text ILIKE '%ROW ACCESS POLICY%' THEN 'ROW_ACCESS_POLICY' ELSE 'OTHER_POLICY' END AS policy_type,
        CASE WHEN query_text ILIKE '%DROP%POLICY%' THEN 'CRITICAL' WHEN query_text ILIKE '%ALTER%POLICY%' THEN 'HIGH'
             WHEN query_text ILIKE '%CREATE%POLICY%' THEN 'MEDIUM' ELSE 'LOW' END AS change_severity""", f"""
        {ago('start_time', 180, 'DAY')}
        AND (query_text ILIKE '%MASKING POLICY%' OR query_text ILIKE '%ROW ACCESS POLICY%')
        AND query_type IN ('CREATE_MASKING_POLICY', 'CREATE_ROW_ACCESS_POLICY', 'ALTER_MASKING_POLICY',
          'ALTER_ROW_ACCESS_POLICY', 'DROP_MASKING_POLICY', 'DROP_ROW_ACCESS_POLICY', 'CREATE', 'ALTER', 'DROP')"""),
    "a10_user_inventory": f"""
        SELECT name AS user_name, login_name, display_name, email, default_role, default_warehouse, {stamp('created_on')},
               {stamp('last_success_login', 'last_login')}, disabled AS is_disabled, has_mfa,
               {IDLE} AS days_since_last_login,
               CASE WHEN disabled = 'true' THEN 'DISABLED' WHEN last_success_login IS NULL THEN 'NEVER_LOGGED_IN'
                    WHEN {IDLE} > 90 THEN 'DORMANT_90D' WHEN {IDLE} > 30 THEN 'DORMANT_30D' ELSE 'ACTIVE' END
                 AS account_status,
               CASE WHEN has_mfa = 'false' AND disabled = 'false' THEN 'HIGH' WHEN {IDLE} > 90 THEN 'MEDIUM'
                    ELSE 'LOW' END AS risk_level FROM platform_users""",
    "a11_session_audit": f"""
        SELECT session_id, user_name, {stamp('created_on', 'login_time')}, is_open AS is_session_open, closed_reason,
               client_application_id AS client_application, client_application_version AS client_version,
               'PROD' AS client_environment, authentication_method AS auth_method,
               CASE WHEN is_open AND epoch(date_trunc('hour', {LOG_DAY})) - epoch(date_trunc('hour', created_on))
                      > 8 * 3600 THEN 'EXTENDED_SESSION'
                    WHEN authentication_method NOT LIKE '%MFA%' AND authentication_method NOT LIKE '%MULTI%' THEN 'NO_MFA'
                    ELSE 'NORMAL' END AS session_flag
        FROM platform_sessions WHERE {ago('created_on', 90, 'DAY')}""",
    "a12_admin_activity": f"""
        SELECT query_id, {stamp('start_time', 'activity_timestamp')}, user_name, role_name AS admin_role,
               query_type AS operation_type, database_name AS target_database, schema_name AS target_schema,
               warehouse_name, left(query_text, 500) AS query_text_preview, execution_status AS status,
               total_elapsed_time / 1000.0::DOUBLE AS execution_seconds, rows_produced AS rows_affected,
               CASE role_name WHEN 'ACCOUNTADMIN' THEN 'CRITICAL' WHEN 'SECURITYADMIN' THEN 'HIGH'
                    WHEN 'SYSADMIN' THEN 'MEDIUM' ELSE 'OTHER' END AS privilege_level,
               CASE WHEN query_type IN ('GRANT', 'REVOKE') THEN 'PRIVILEGE_CHANGE'
                    WHEN query_type IN ('CREATE_USER', 'ALTER_USER', 'DROP_USER') THEN 'USER_MANAGEMENT'
                    WHEN query_type IN ('CREATE_ROLE', 'DROP_ROLE') THEN 'ROLE_MANAGEMENT'
                    WHEN query_type LIKE 'CREATE%' OR query_type LIKE 'DROP%' THEN 'DDL_OPERATION'
                    ELSE 'OTHER_OPERATION' END AS activity_category
        FROM query_history WHERE {ago('start_time', 90, 'DAY')}
          AND role_name IN ('ACCOUNTADMIN', 'SECURITYADMIN', 'SYSADMIN') AND execution_status = 'SUCCESS'""",
    "a13_ddl_change_log": change(500, """
        CASE WHEN query_type LIKE 'DROP%' THEN 'HIGH' WHEN query_type IN ('GRANT', 'REVOKE') THEN 'HIGH'
             WHEN query_type LIKE 'ALTER%' THEN 'MEDIUM' ELSE 'LOW' END AS change_severity""", f"""
        {ago('start_time', 90, 'DAY')} AND query_type IN ('CREATE_TABLE', 'ALTER_TABLE', 'DROP_TABLE', 'CREATE_VIEW',
          'ALTER_VIEW', 'DROP_VIEW', 'CREATE_SCHEMA', 'DROP_SCHEMA', 'CREATE_DATABASE', 'DROP_DATABASE', 'GRANT',
          'REVOKE')"""),
    "a14_retention_compliance": f"""
        SELECT object_database AS database_name, object_schema AS schema_name, object_name AS table_name,
               tag_value AS retention_policy, {stamp('created', 'table_created')}, row_count,
               bytes / {GB} AS size_gb,
               strftime(CASE tag_value WHEN '7_YEARS' THEN created + INTERVAL 7 YEARS
                 WHEN '10_YEARS' THEN created + INTERVAL 10 YEARS WHEN '1_YEAR' THEN created + INTERVAL 1 YEAR END,
                 '%Y-%m-%d %H:%M:%S.%f') AS earliest_deletion_date,
               CASE WHEN tag_value = 'PERMANENT' THEN 'NEVER_DELETE' WHEN tag_value IS NULL
                    THEN 'UNTAGGED_REVIEW_REQUIRED' ELSE 'RETENTION_ACTIVE' END AS retention_status,
               'HIPAA/CMS' AS regulatory_reference
        FROM tag_references JOIN extract_tables ON object_database = table_catalog AND object_schema = table_schema
          AND object_name = table_name
        WHERE tag_name = 'RETENTION_POLICY' AND deleted IS NULL""",
    "a15_user_risk_score": f"""
        WITH au AS (SELECT user_name, count(*) AS n FROM query_history WHERE role_name = 'ACCOUNTADMIN'
                    AND {ago('start_time', 90, 'DAY')} AND execution_status = 'SUCCESS' GROUP BY 1),
        pe AS (SELECT granted_by AS user_name, count(*) AS n FROM grants_to_roles
               WHERE (privilege = 'OWNERSHIP' OR name IN ('ACCOUNTADMIN', 'SECURITYADMIN'))
                 AND {ago('created_on', 90, 'DAY')} AND deleted_on IS NULL GROUP BY 1),
        pa AS (SELECT user_name, count(*) AS n FROM query_history JOIN tag_references ON object_database = database_name
               WHERE {ago('start_time', 90, 'DAY')} AND tag_name = 'PHI_CLASSIFICATION' AND tag_value = 'DIRECT_PHI'
               GROUP BY 1),
        ca AS (SELECT user_name, count(*) AS n FROM query_history JOIN tag_references ON object_database = database_name
               WHERE {ago('start_time', 90, 'DAY')} AND tag_name = 'DATA_SENSITIVITY'
                 AND tag_value = 'HIGHLY_CONFIDENTIAL' AND role_name NOT IN {INSIDE} GROUP BY 1),
        fl AS (SELECT user_name, count(*) AS n FROM login_history WHERE is_success = 'NO'
               AND {ago('event_timestamp', 90, 'DAY')} GROUP BY 1 HAVING count(*) >= 3),
        everyone AS (SELECT DISTINCT user_name FROM query_history WHERE {ago('start_time', 90, 'DAY')})
        SELECT u.user_name, coalesce(au.n, 0) AS accountadmin_queries, coalesce(pe.n, 0) AS privilege_escalations,
               coalesce(pa.n, 0) AS phi_access_count, coalesce(ca.n, 0) AS confidential_access_count,
               coalesce(fl.n, 0) AS failed_logins, {SCORE} AS risk_score,
               CASE WHEN {SCORE} >= 101 THEN 'CRITICAL' WHEN {SCORE} >= 51 THEN 'HIGH' WHEN {SCORE} >= 26 THEN 'MEDIUM'
                    ELSE 'LOW' END AS risk_level
        FROM everyone u LEFT JOIN au ON u.user_name = au.user_name LEFT JOIN pe ON u.user_name = pe.user_name
        LEFT JOIN pa ON u.user_name = pa.user_name LEFT JOIN ca ON u.user_name = ca.user_name
        LEFT JOIN fl ON u.user_name = fl.user_name""",
}
