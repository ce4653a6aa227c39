"""Column masks and row predicates that depend on the reader's role.

The role is an explicit argument: nothing here looks at the session user, so a job can
be checked for every role. A mask is a plain Column expression that runs inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Who may see what.
FULL_PHI_ROLES = {"HEALTH_DATA_ADMIN", "HEALTH_ML_ADMIN", "HEALTH_ANALYST", "ACCOUNTADMIN"}
PARTIAL_PHI_ROLES = {"HEALTH_DATA_ENGINEER", "HEALTH_ML_ENGINEER"}
FULL_SSN_ROLES = {"HEALTH_DATA_ADMIN", "ACCOUNTADMIN"}
FULL_DOB_ROLES = {"HEALTH_DATA_ADMIN", "HEALTH_ML_ADMIN", "ACCOUNTADMIN"}
FULL_CONTACT_ROLES = {"HEALTH_DATA_ADMIN", "HEALTH_ANALYST", "ACCOUNTADMIN"}
UNCERTIFIED_ROLES = {"HEALTH_DATA_ADMIN", "HEALTH_DATA_ENGINEER", "ACCOUNTADMIN"}
ALL_PATIENT_ROLES = {
    "HEALTH_DATA_ADMIN", "HEALTH_ANALYST", "ACCOUNTADMIN",
    "HEALTH_DATA_ENGINEER", "HEALTH_ML_ENGINEER", "HEALTH_ML_ADMIN",
}


def mask_patient_phi(value: Column, role: str) -> Column:
    if role in FULL_PHI_ROLES:
        return value
    if role in PARTIAL_PHI_ROLES:
        hidden = F.length(value) - 4
        return F.when(
            hidden > 0, F.concat(F.repeat(F.lit("*"), hidden), F.right(value, F.lit(4)))
        ).otherwise(F.repeat(F.lit("*"), F.length(value)))
    return F.lit("**REDACTED**")


def mask_ssn(value: Column, role: str) -> Column:
    if role in FULL_SSN_ROLES:
        return value
    if role == "HEALTH_ANALYST":
        return F.concat(F.lit("XXX-XX-"), F.right(value, F.lit(4)))
    return F.lit("***-**-****")


def mask_dob(value: Column, role: str) -> Column:
    if role in FULL_DOB_ROLES:
        return value
    if role == "HEALTH_ANALYST":
        return F.make_date(F.year(value), F.lit(1), F.lit(1))
    return F.lit(None).cast("date")


def mask_phone_email(value: Column, role: str) -> Column:
    if role in FULL_CONTACT_ROLES:
        return value
    return (
        F.when(F.contains(value, F.lit("@")), F.concat(F.left(value, F.lit(2)), F.lit("***@***.com")))
        .when(F.length(value) >= 10, F.concat(F.lit("***-***-"), F.right(value, F.lit(4))))
        .otherwise(F.lit("***"))
    )


def may_read_quality(status: Column, role: str) -> Column:
    """Certified and unrated rows for everyone, the rest for the roles that repair data."""
    restricted = status.isin("UNDER_REVIEW", "QUARANTINED", "DEPRECATED")
    return F.coalesce(~restricted, F.lit(True)) | F.lit(role in UNCERTIFIED_ROLES)
