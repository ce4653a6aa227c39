"""Fixed values the results must match, kept apart from the library so that a wrong list there is seen."""

from __future__ import annotations

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

# Minimum rows per table.
TARGETS = {
    "DIM_PATIENT": 500, "FACT_ENCOUNTER": 2000, "FACT_DIAGNOSIS": 3000, "FACT_MEDICATION": 2500,
    "FACT_REHAB_REFERRAL": 200, "FACT_REHAB_SESSION": 4000, "FACT_REHAB_OUTCOME": 400, "RAW_CLAIMS": 1000,
}
