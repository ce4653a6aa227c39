"""Usage, alert and audit queries over the log tables."""

from __future__ import annotations

from pulsemart.plans import alerts as r, audit as a, usage as o

QUERIES = {
    "o1_daily_warehouse_credits": lambda g: o.daily_warehouse_credits(g.warehouse_metering_history, g.as_of),
    "o2_monthly_credit_summary": lambda g: o.monthly_credit_summary(g.warehouse_metering_history, g.as_of),
    "o3_credits_by_user": lambda g: o.credits_by_user(g.query_history, g.as_of),
    "o4_credits_by_role": lambda g: o.credits_by_role(g.query_history, g.as_of),
    "o5_top_expensive_queries": lambda g: o.top_expensive_queries(g.query_history, g.as_of),
    "o6_storage_consumption": lambda g: o.storage_consumption(g.storage_usage, g.as_of),
    "o7_quota_usage": lambda g: o.quota_usage(g.resource_monitors),
    "o8_query_performance": lambda g: o.query_performance(g.query_history, g.as_of),
    "o9_long_running_queries": lambda g: o.long_running_queries(g.query_history, g.as_of),
    "o10_failed_queries": lambda g: o.failed_queries(g.query_history, g.as_of),
    "o11_warehouse_utilization": lambda g: o.warehouse_utilization(g.warehouse_load_history, g.as_of),
    "o12_active_warehouse_load": lambda g: o.active_warehouse_load(g.warehouse_load_history, g.as_of),
    "o13_cost_by_month": lambda g: o.cost_by_month(g.warehouse_metering_history, g.as_of),
    "o14_logins": lambda g: o.logins(g.login_history, g.as_of),
    "o15_data_transfer": lambda g: o.data_transfer(g.data_transfer_history, g.as_of),
    "o16_query_type_summary": lambda g: o.query_type_summary(g.query_history, g.as_of),
    "o17_database_storage": lambda g: o.database_storage(g.database_storage_usage_history),
    "o18_weekly_usage": lambda g: o.weekly_usage(g.query_history, g.as_of),
    "o19_role_edges": lambda g: o.role_edges(g.grants_to_roles),
    "o19_role_owners": lambda g: o.role_owners(g.roles),
    "r1_quota_critical": lambda g: r.quota_critical(g.resource_monitors),
    "r2_long_running": lambda g: r.long_running(g.query_history, g.as_of),
    "r3_failed_spike": lambda g: r.failed_spike(g.query_history, g.as_of),
    "r4_high_queue": lambda g: r.high_queue(g.warehouse_load_history, g.as_of),
    "r5_monthly_cost_spike": lambda g: r.monthly_cost_spike(g.warehouse_metering_history, g.as_of),
    "r6_login_failures": lambda g: r.login_failures(g.login_history, g.as_of),
    "r7_privilege_escalation": lambda g: r.privilege_escalation(g.grants_to_users, g.as_of),
    "r8_data_export": lambda g: r.data_export(g.data_transfer_history, g.as_of),
    "r9_ai_spend": lambda g: r.ai_spend(g.warehouse_metering_history, g.as_of),
    "r10_storage_growth": lambda g: r.storage_growth(g.storage_usage, g.as_of),
    "a1_login_audit": lambda g: a.login_audit(g.login_history, g.as_of),
    "a2_role_grant_history": lambda g: a.role_grant_history(g.grants_to_users, g.grants_to_roles, g.as_of),
    "a3_privilege_escalation_events": lambda g: a.privilege_escalation_events(g.grants_to_roles, g.as_of),
    "a4_phi_data_access": lambda g: a.phi_data_access(g.query_history, g.tag_references, g.as_of),
    "a5_phi_access_log": lambda g: a.phi_access_log(g.query_history, g.access_history, g.as_of),
    "a6_masking_policy_usage": lambda g: a.masking_policy_usage(g.policy_references, g.masking_policies),
    "a7_row_policy_usage": lambda g: a.row_policy_usage(g.policy_references, g.row_access_policies),
    "a8_tag_change_history": lambda g: a.tag_change_history(g.query_history, g.as_of),
    "a9_policy_change_history": lambda g: a.policy_change_history(g.query_history, g.as_of),
    "a10_user_inventory": lambda g: a.user_inventory(g.users, g.as_of),
    "a11_session_audit": lambda g: a.session_audit(g.sessions, g.as_of),
    "a12_admin_activity": lambda g: a.admin_activity(g.query_history, g.as_of),
    "a13_ddl_change_log": lambda g: a.ddl_change_log(g.query_history, g.as_of),
    "a14_retention_compliance": lambda g: a.retention_compliance(g.tag_references, g.tables),
    "a15_user_risk_score": lambda g: a.user_risk_score(
        g.query_history, g.grants_to_roles, g.tag_references, g.login_history, g.as_of
    ),
}
