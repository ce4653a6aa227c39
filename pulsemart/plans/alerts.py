"""Alert conditions: each is one row (alert, fired, value). Sending a message is not part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsemart.functions import dates
from pulsemart.functions.numbers import count_where
from pulsemart.plans import usage
from pulsemart.plans.logs import recent, since_midnight


def _alert(df: DataFrame, name: str, value: Column, condition) -> DataFrame:
    """``value`` is an aggregate over ``df``; an empty ``df`` gives zero."""
    return df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value")).select(
        F.lit(name).alias("alert"), condition(F.col("value")).alias("fired"), "value"
    )


def quota_critical(monitors: DataFrame) -> DataFrame:
    high = count_where(F.col("usage_percent") >= 90)
    return _alert(usage.quota_usage(monitors), "RESOURCE_MONITOR_CRITICAL", high, lambda v: v > 0)


def long_running(queries: DataFrame, as_of: Column) -> DataFrame:
    late = recent(usage.long_running_queries(queries, as_of), "start_time", as_of, 15, "MINUTE")
    return _alert(late, "LONG_RUNNING_QUERY", F.count("*"), lambda v: v > 0)


def failed_spike(queries: DataFrame, as_of: Column) -> DataFrame:
    late = recent(usage.failed_queries(queries, as_of), "start_time", as_of, 15, "MINUTE")
    return _alert(late, "FAILED_QUERY_SPIKE", F.count("*"), lambda v: v > 10)


def high_queue(load: DataFrame, as_of: Column) -> DataFrame:
    worst = F.max("avg_queries_queued")
    return _alert(usage.active_warehouse_load(load, as_of), "HIGH_WAREHOUSE_QUEUE", worst, lambda v: v > 5)


def monthly_cost_spike(metering: DataFrame, as_of: Column) -> DataFrame:
    this_month = dates.month_of(as_of)
    month, credits = F.col("usage_month"), F.col("total_credits")
    sums = usage.cost_by_month(metering, as_of).agg(
        F.coalesce(F.sum(F.when(month == this_month, credits)), F.lit(0.0)).alias("current"),
        F.coalesce(F.sum(F.when(month == F.add_months(this_month, -1), credits)), F.lit(0.0)).alias("previous"),
    )
    fired = (F.col("current") > F.col("previous") * 1.2) & (F.col("previous") > 0)
    return sums.select(F.lit("MONTHLY_COST_SPIKE").alias("alert"), fired.alias("fired"), F.col("current").alias("value"))


def login_failures(logins: DataFrame, as_of: Column) -> DataFrame:
    failed = recent(logins, "event_timestamp", as_of, 1, "HOUR").filter(F.col("is_success") == "NO")
    return _alert(failed, "LOGIN_FAILURES", F.count("*"), lambda v: v > 10)


def privilege_escalation(grants_to_users: DataFrame, as_of: Column) -> DataFrame:
    granted = recent(grants_to_users, "created_on", as_of, 1, "HOUR").filter(F.col("role") == "ACCOUNTADMIN")
    return _alert(granted, "PRIVILEGE_ESCALATION", F.count("*"), lambda v: v > 0)


def data_export(transfers: DataFrame, as_of: Column) -> DataFrame:
    per_type = recent(transfers, "start_time", as_of, 1, "DAY").groupBy("transfer_type").agg(
        (F.sum("bytes_transferred") / F.lit(1024.0**3)).alias("gb")
    )
    return _alert(per_type, "PHI_DATA_EXPORT", F.max("gb"), lambda v: v > 10)


def ai_spend(metering: DataFrame, as_of: Column) -> DataFrame:
    spent = recent(metering, "start_time", as_of, 1, "DAY").filter(F.col("warehouse_name") == "HEALTH_AI_WH")
    return _alert(spent, "AI_WH_HIGH_SPEND", F.sum("credits_used"), lambda v: v > 30)


def storage_growth(storage: DataFrame, as_of: Column) -> DataFrame:
    """Largest day-on-day growth; the window runs over the last few daily rows only."""
    before = F.lag("storage_bytes").over(Window.orderBy("usage_date"))
    growth = since_midnight(storage, "usage_date", as_of, 2, "DAY").select(
        F.col("storage_bytes").alias("today"), before.alias("yesterday")
    ).filter(F.col("yesterday") > 0)
    return _alert(
        growth, "STORAGE_GROWTH", F.max((F.col("today") - F.col("yesterday")) / F.col("yesterday")), lambda v: v > 0.10
    )
