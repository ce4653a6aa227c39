"""Role-dependent reading of tables, the tag catalogue and role inheritance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.functions import masks
from pulsemart.sources.lookups import lookup

# Tag kinds and the values each allows.
TAG_VALUES = {
    "PHI_CLASSIFICATION": ["DIRECT_PHI", "QUASI_PHI", "CLINICAL", "NON_PHI"],
    "DATA_SENSITIVITY": ["HIGHLY_CONFIDENTIAL", "CONFIDENTIAL", "INTERNAL", "PUBLIC"],
    "DATA_DOMAIN": ["PATIENT", "CLINICAL", "CARDIAC_REHAB", "LAB_VITALS", "FINANCIAL", "RESEARCH"],
    "MEDALLION_LAYER": ["BRONZE", "SILVER", "GOLD", "PLATINUM"],
    "DATA_QUALITY_STATUS": ["CERTIFIED", "UNDER_REVIEW", "QUARANTINED", "DEPRECATED"],
    "SOURCE_SYSTEM": ["EPIC", "CERNER", "CLAIMS_SYSTEM", "LIS", "CARDIAC_DEVICE", "MANUAL"],
    "REFRESH_FREQUENCY": ["REAL_TIME", "HOURLY", "DAILY", "WEEKLY", "MONTHLY", "ON_DEMAND"],
    "RETENTION_POLICY": ["7_YEARS", "10_YEARS", "PERMANENT", "1_YEAR"],
}

# Fixed values: (child, parent) role edges; a parent may do what its children may.
ROLE_EDGES = [
    ("HEALTH_READONLY", "HEALTH_ANALYST"), ("HEALTH_READONLY", "HEALTH_DATA_ENGINEER"),
    ("HEALTH_READONLY", "HEALTH_ML_ENGINEER"), ("HEALTH_ANALYST", "HEALTH_APP_ADMIN"),
    ("HEALTH_DATA_ENGINEER", "HEALTH_DATA_ADMIN"), ("HEALTH_ML_ENGINEER", "HEALTH_ML_ADMIN"),
    ("HEALTH_DATA_ADMIN", "SYSADMIN"), ("HEALTH_ML_ADMIN", "SYSADMIN"), ("HEALTH_APP_ADMIN", "SYSADMIN"),
]

Mask = Callable[[Column, str], Column]
RowFilter = Callable[[DataFrame, str, str], DataFrame]

# The policies bound to the patient table.
PATIENT_MASKS: dict[str, Mask] = {
    "first_name": masks.mask_patient_phi, "last_name": masks.mask_patient_phi, "ssn": masks.mask_ssn,
    "date_of_birth": masks.mask_dob, "email": masks.mask_phone_email, "phone": masks.mask_phone_email,
}


def filter_by_quality(df: DataFrame, role: str, status: str = "dq_status") -> DataFrame:
    return df.filter(masks.may_read_quality(F.col(status), role))


def filter_by_care_team(df: DataFrame, assignments: DataFrame, role: str, user: str) -> DataFrame:
    """Named roles read every patient, read-only users those of their care teams, all others none."""
    if role in masks.ALL_PATIENT_ROLES:
        return df
    if role != "HEALTH_READONLY":
        return df.filter(F.lit(False))
    return df.join(team_patients(assignments, user), "patient_id", "left_semi")


def team_patients(assignments: DataFrame, user: str) -> DataFrame:
    """Assignments of the care teams that the user belongs to."""
    teams = assignments.filter(F.col("clinician_user") == user).select("care_team_id")
    return assignments.join(teams, "care_team_id", "left_semi")


def bind(df: DataFrame, column_masks: dict[str, Mask], row_filters: list[RowFilter], role: str, user: str) -> DataFrame:
    """The table as ``role`` may read it: rows are filtered on true values, then columns masked."""
    for keep in row_filters:
        df = keep(df, role, user)
    return df.withColumns({c: mask(F.col(c), role) for c, mask in column_masks.items() if c in df.columns})


def patients_for(patients: DataFrame, assignments: DataFrame, role: str, user: str) -> DataFrame:
    filters = [
        lambda df, r, _: filter_by_quality(df, r),
        lambda df, r, u: filter_by_care_team(df, assignments, r, u),
    ]
    return bind(patients, PATIENT_MASKS, filters, role, user)


def visible_by_role(patients: DataFrame, roles: list[str]) -> DataFrame:
    """Rows each role may read under the quality filter, in one pass."""
    counts = F.array(*[
        F.struct(
            F.lit(role).alias("role"),
            F.count(F.when(masks.may_read_quality(F.col("dq_status"), role), 1)).alias("visible_rows"),
        )
        for role in roles
    ])
    return patients.agg(counts.alias("c")).select(F.inline("c"))


def tag_usage(spark: SparkSession, references: DataFrame) -> DataFrame:
    """Assignments per tag and value, with a check that the value is one the tag allows."""
    allowed = lookup(
        spark, [(tag, value) for tag, vs in TAG_VALUES.items() for value in vs], ["tag_name", "tag_value"]
    ).withColumn("listed", F.lit(True))
    used = references.groupBy("tag_name", "tag_value").agg(
        F.count("*").alias("assignments"), F.countDistinct("object_name").alias("objects")
    )
    return used.join(F.broadcast(allowed), ["tag_name", "tag_value"], "left").withColumn(
        "is_allowed", F.coalesce("listed", F.lit(False))
    ).drop("listed")


def columns_tagged(references: DataFrame, tag: str, values: list[str]) -> DataFrame:
    return references.filter((F.col("tag_name") == tag) & F.col("tag_value").isin(values)).select(
        "object_database", "object_schema", "object_name", "column_name", "tag_value"
    )


def inherited(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, role it includes) pairs, each role including itself; the edge list is a constant."""
    names = sorted({name for edge in edges for name in edge})
    reach = {name: {name} for name in names}
    for _ in names:
        for child, parent in edges:
            reach[parent] |= reach[child]
    return [(name, included) for name in names for included in sorted(reach[name])]


def effective_roles(spark: SparkSession, grants: DataFrame) -> DataFrame:
    """Roles each user holds directly or through inheritance."""
    included = lookup(spark, inherited(ROLE_EDGES), ["role", "effective_role"])
    live = grants.filter(F.col("deleted_on").isNull()).select(F.col("grantee_name").alias("user_name"), "role").distinct()
    return live.join(F.broadcast(included), "role").groupBy("user_name", "effective_role").agg(
        F.count("*").alias("granted_through")
    )
