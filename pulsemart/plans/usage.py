"""Usage and cost views over the log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemart.functions import dates
from pulsemart.functions.numbers import gigabytes, ratio, terabytes
from pulsemart.plans.logs import recent, since_midnight

USD_PER_CREDIT = 3
USD_PER_TB_MONTH = 23
OURS = {"warehouse_name": "HEALTH_%"}
LONG_MS = 300_000


def _usd(credits: Column, places: int = 2) -> Column:
    return F.round(credits * USD_PER_CREDIT, places)


def _seconds(ms: str) -> Column:
    return F.round(F.col(ms) / 1000, 2)


def daily_warehouse_credits(metering: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(metering, "start_time", as_of, 30, "DAY", OURS).groupBy(
        dates.day_of(F.col("start_time")).alias("usage_date"), "warehouse_name"
    ).agg(
        F.sum("credits_used").alias("total_credits"),
        F.sum("credits_used_compute").alias("compute_credits"),
        F.sum("credits_used_cloud_services").alias("cloud_services_credits"),
        F.count("*").alias("query_count"),
        _usd(F.sum("credits_used")).alias("estimated_cost_usd"),
    )


def monthly_credit_summary(metering: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(metering, "start_time", as_of, 12, "MONTH", OURS).groupBy(
        dates.month_of(F.col("start_time")).alias("usage_month"), "warehouse_name"
    ).agg(F.sum("credits_used").alias("total_credits"), _usd(F.sum("credits_used")).alias("estimated_cost_usd"))


def credits_by_user(queries: DataFrame, as_of: Column) -> DataFrame:
    credits = F.sum("credits_used_cloud_services")
    return since_midnight(queries, "start_time", as_of, 30, "DAY", OURS).groupBy("user_name").agg(
        F.countDistinct("query_id").alias("total_queries"),
        credits.alias("total_credits"),
        F.round(F.avg("total_elapsed_time") / 1000, 2).alias("avg_query_seconds"),
        _usd(credits).alias("estimated_cost_usd"),
    )


def credits_by_role(queries: DataFrame, as_of: Column) -> DataFrame:
    credits = F.sum("credits_used_cloud_services")
    return since_midnight(queries, "start_time", as_of, 30, "DAY", {"role_name": "HEALTH_%"}).groupBy("role_name").agg(
        F.countDistinct("user_name").alias("unique_users"),
        F.countDistinct("query_id").alias("total_queries"),
        credits.alias("total_credits"),
        _usd(credits).alias("estimated_cost_usd"),
    )


def top_expensive_queries(queries: DataFrame, as_of: Column, limit: int = 100) -> DataFrame:
    credits = F.col("credits_used_cloud_services")
    return (
        since_midnight(queries, "start_time", as_of, 30, "DAY", OURS)
        .filter(credits > 0)
        .orderBy(credits.desc(), "query_id")
        .limit(limit)
        .select(
            "query_id", F.substring("query_text", 1, 200).alias("query_preview"), "user_name", "role_name",
            "warehouse_name", "database_name", "execution_status", "start_time",
            (F.col("total_elapsed_time") / 1000).alias("elapsed_seconds"),
            gigabytes(F.col("bytes_scanned")).alias("gb_scanned"),
            credits.alias("credits_used"), _usd(credits, 4).alias("estimated_cost_usd"),
        )
    )


def storage_consumption(storage: DataFrame, as_of: Column) -> DataFrame:
    total = F.col("storage_bytes") + F.col("stage_bytes") + F.col("failsafe_bytes")
    return since_midnight(storage, "usage_date", as_of, 6, "MONTH").select(
        "usage_date",
        F.round(terabytes(F.col("storage_bytes")), 4).alias("database_storage_tb"),
        F.round(terabytes(F.col("stage_bytes")), 4).alias("stage_storage_tb"),
        F.round(terabytes(F.col("failsafe_bytes")), 4).alias("failsafe_storage_tb"),
        F.round(terabytes(total), 4).alias("total_storage_tb"),
        F.round(terabytes(total) * USD_PER_TB_MONTH, 2).alias("estimated_monthly_cost_usd"),
    )


def quota_usage(monitors: DataFrame) -> DataFrame:
    return monitors.filter(F.col("name").like("HEALTH_%")).select(
        F.col("name").alias("monitor_name"), "credit_quota", "used_credits", "remaining_credits",
        F.round(ratio(F.col("used_credits"), F.col("credit_quota")) * 100, 2).alias("usage_percent"),
        F.col("notify").alias("notify_at_percent"), F.col("suspend").alias("suspend_at_percent"),
        F.col("suspend_immediate").alias("suspend_immediate_at_percent"), "warehouses", "created",
    )


def query_performance(queries: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(queries, "start_time", as_of, 30, "DAY", OURS).select(
        "query_id", F.substring("query_text", 1, 500).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "warehouse_size", "database_name", "schema_name", "query_type", "execution_status",
        "start_time", "end_time",
        _seconds("total_elapsed_time").alias("execution_seconds"),
        _seconds("compilation_time").alias("compile_seconds"),
        _seconds("queued_overload_time").alias("queue_seconds"),
        "bytes_scanned", F.round(gigabytes(F.col("bytes_scanned")), 4).alias("gb_scanned"),
        "rows_produced", "partitions_scanned", "partitions_total",
        F.round(ratio(F.col("partitions_scanned"), F.col("partitions_total")) * 100, 2).alias("partition_scan_pct"),
        F.col("credits_used_cloud_services").alias("credits_used"),
    )


def long_running_queries(queries: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(queries, "start_time", as_of, 30, "DAY", OURS).filter(F.col("total_elapsed_time") > LONG_MS).select(
        "query_id", F.substring("query_text", 1, 300).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "warehouse_size", "database_name", "query_type", "execution_status", "start_time",
        "end_time", _seconds("total_elapsed_time").alias("execution_seconds"),
        F.round(F.col("total_elapsed_time") / 60000, 2).alias("execution_minutes"), "bytes_scanned",
        F.round(gigabytes(F.col("bytes_scanned")), 2).alias("gb_scanned"), "rows_produced", "partitions_scanned",
    )


def failed_queries(queries: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(queries, "start_time", as_of, 30, "DAY", OURS).filter(F.col("execution_status") == "FAIL").select(
        "query_id", F.substring("query_text", 1, 300).alias("query_preview"), "user_name", "role_name",
        "warehouse_name", "database_name", "schema_name", "query_type", "execution_status", "error_code",
        "error_message", "start_time", _seconds("total_elapsed_time").alias("execution_seconds"),
    )


def warehouse_utilization(load: DataFrame, as_of: Column) -> DataFrame:
    status = (
        F.when(F.col("avg_queued_load") > 5, "HIGH_QUEUE").when(F.col("avg_running") > 10, "HIGH_LOAD")
        .when(F.col("avg_blocked") > 0, "BLOCKED").otherwise("NORMAL")
    )
    return since_midnight(load, "start_time", as_of, 30, "DAY", OURS).select(
        "warehouse_name", "start_time", "end_time",
        F.round("avg_running", 2).alias("avg_queries_running"),
        F.round("avg_queued_load", 2).alias("avg_queries_queued"),
        F.round("avg_queued_provisioning", 2).alias("avg_queries_provisioning"),
        F.round("avg_blocked", 2).alias("avg_queries_blocked"),
        F.round(F.col("avg_running") + F.col("avg_queued_load"), 2).alias("total_load"),
        status.alias("load_status"),
        dates.hour_of(F.col("start_time")).alias("hour_bucket"),
    )


def active_warehouse_load(load: DataFrame, as_of: Column) -> DataFrame:
    return recent(load, "start_time", as_of, 24, "HOUR", OURS).groupBy("warehouse_name").agg(
        F.count("*").alias("sample_count"),
        F.round(F.avg("avg_running"), 2).alias("avg_queries_running"),
        F.round(F.avg("avg_queued_load"), 2).alias("avg_queries_queued"),
        F.round(F.avg("avg_blocked"), 2).alias("avg_queries_blocked"),
        F.round(F.max("avg_running"), 2).alias("peak_queries_running"),
        F.round(F.max("avg_queued_load"), 2).alias("peak_queries_queued"),
        F.min("start_time").alias("period_start"),
        F.max("end_time").alias("period_end"),
    )


def cost_by_month(metering: DataFrame, as_of: Column) -> DataFrame:
    """As defined, the total adds the cloud part to credits that already contain it."""
    total = F.sum("credits_used") + F.sum("credits_used_cloud_services")
    days = F.countDistinct(dates.day_of(F.col("start_time")))
    return since_midnight(metering, "start_time", as_of, 12, "MONTH", OURS).groupBy(
        "warehouse_name", dates.month_of(F.col("start_time")).alias("usage_month")
    ).agg(
        F.round(F.sum("credits_used"), 4).alias("compute_credits"),
        F.round(F.sum("credits_used_cloud_services"), 4).alias("cloud_services_credits"),
        F.round(total, 4).alias("total_credits"),
        days.alias("active_days"),
        F.round(ratio(total, days), 4).alias("avg_credits_per_day"),
        _usd(total).alias("estimated_cost_usd"),
    )


def logins(login_history: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(login_history, "event_timestamp", as_of, 30, "DAY").select(
        "user_name", F.col("reported_client_type").alias("client_type"),
        F.col("first_authentication_factor").alias("auth_factor_1"),
        F.col("second_authentication_factor").alias("auth_factor_2"), "is_success", "error_code", "error_message",
        F.col("event_timestamp").alias("login_time"), "client_ip", F.col("connection").alias("connection_name"),
    )


def data_transfer(transfers: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(transfers, "start_time", as_of, 30, "DAY").groupBy(
        dates.day_of(F.col("start_time")).alias("transfer_date"), "source_cloud", "source_region", "target_cloud",
        "target_region", "transfer_type",
    ).agg(
        F.round(gigabytes(F.sum("bytes_transferred")), 4).alias("gb_transferred"),
        F.round(terabytes(F.sum("bytes_transferred")), 6).alias("tb_transferred"),
    )


def query_type_summary(queries: DataFrame, as_of: Column) -> DataFrame:
    """Shares come from a window over the few aggregated rows, not over the log."""
    counted = since_midnight(queries, "start_time", as_of, 30, "DAY", OURS).groupBy("query_type", "warehouse_name").agg(
        F.count("*").alias("query_count"),
        F.sum("credits_used_cloud_services").alias("total_credits"),
        F.round(F.avg("total_elapsed_time") / 1000, 2).alias("avg_execution_seconds"),
        F.round(terabytes(F.sum("bytes_scanned")), 4).alias("tb_scanned"),
    )
    whole = F.sum("query_count").over(Window.partitionBy("warehouse_name"))
    return counted.withColumn("pct_of_warehouse", F.round(F.col("query_count") * 100.0 / whole, 2))


def database_storage(usage: DataFrame) -> DataFrame:
    latest = usage.agg(F.max("usage_date")).scalar()
    data, safe = F.sum("average_database_bytes"), F.sum("average_failsafe_bytes")
    return (
        usage.filter((F.col("usage_date") == latest) & F.col("database_name").like("HEALTH_%"))
        .groupBy("database_name")
        .agg(
            F.round(gigabytes(data), 4).alias("database_size_gb"),
            F.round(gigabytes(safe), 4).alias("failsafe_size_gb"),
            F.round(gigabytes(data + safe), 4).alias("total_size_gb"),
            F.round(gigabytes(data + safe) * USD_PER_TB_MONTH / 30, 2).alias("estimated_daily_cost_usd"),
        )
    )


def weekly_usage(queries: DataFrame, as_of: Column) -> DataFrame:
    return since_midnight(queries, "start_time", as_of, 7, "DAY", OURS).groupBy("warehouse_name").agg(
        F.count("*").alias("query_count"),
        F.sum("credits_used_cloud_services").alias("total_credits"),
        F.round(F.avg("total_elapsed_time") / 1000, 2).alias("avg_query_seconds"),
        F.max("start_time").alias("last_query_time"),
    )


def role_edges(grants: DataFrame) -> DataFrame:
    """Live child-to-parent edges with the check that admin roles report to the system admin."""
    admin = F.col("name").isin("HEALTH_DATA_ADMIN", "HEALTH_ML_ADMIN", "HEALTH_APP_ADMIN")
    check = F.when(~admin, "Functional role").when(
        F.col("grantee_name") == "SYSADMIN", "Correctly grants to SYSADMIN"
    ).otherwise("Check hierarchy")
    return grants.filter(
        F.col("name").like("HEALTH_%") & (F.col("granted_on") == "ROLE") & F.col("deleted_on").isNull()
    ).select(
        F.col("name").alias("child_role"), F.col("grantee_name").alias("parent_role"), "granted_by", "created_on",
        check.alias("validation_status"),
    )


def role_owners(roles: DataFrame) -> DataFrame:
    valid = F.col("owner").isin("ACCOUNTADMIN", "USERADMIN", "SECURITYADMIN")
    return roles.filter(F.col("name").like("HEALTH_%") & F.col("deleted_on").isNull()).select(
        F.col("name").alias("role_name"), F.col("owner").alias("role_owner"), "created_on",
        F.when(valid, "Valid Owner").otherwise("Check Owner").alias("ownership_status"),
    )
