"""Clinical classification rules as ordered CASE expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Code prefixes per cardiac category, first match wins.
ICD_CATEGORIES = [
    ("ACUTE_MI", ["I21%", "410%"]),
    ("CHRONIC_IHD", ["I25%", "414%"]),
    ("HEART_FAILURE", ["I50%", "428%"]),
    ("ANGINA", ["I20%", "413%"]),
    ("CARDIAC_DEVICE", ["Z95%"]),
    ("ATRIAL_FIBRILLATION", ["I48%"]),
    ("CARDIOMYOPATHY", ["I42%"]),
]

# Drug-name fragments per class, first match wins.
DRUG_CLASSES = [
    ("BETA_BLOCKER", ["%metoprolol%", "%atenolol%", "%carvedilol%"]),
    ("ACE_INHIBITOR", ["%lisinopril%", "%enalapril%", "%ramipril%"]),
    ("ANTICOAGULANT", ["%warfarin%", "%heparin%", "%apixaban%"]),
    ("ANTIARRHYTHMIC", ["%amiodarone%", "%sotalol%"]),
    ("STATIN", ["%atorvastatin%", "%rosuvastatin%"]),
    ("ANTIPLATELET", ["%aspirin%", "%clopidogrel%"]),
]

# Lower bound of the PHQ-9 score per severity.
PHQ9_BANDS = [("SEVERE", 20), ("MODERATELY_SEVERE", 15), ("MODERATE", 10), ("MILD", 5)]

# Exclusive upper bound of the age per group.
AGE_GROUPS = [("<45", 45), ("45-54", 55), ("55-64", 65), ("65-74", 75)]


def first_match(branches: Iterable[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    case = None
    for condition, value in branches:
        case = F.when(condition, wrap(value)) if case is None else case.when(condition, wrap(value))
    return case.otherwise(wrap(otherwise))


def any_ilike(value: Column, patterns: list[str]) -> Column:
    condition = value.ilike(patterns[0])
    for pattern in patterns[1:]:
        condition = condition | value.ilike(pattern)
    return condition


def icd_category(code: Column) -> Column:
    """Category of the code exactly as delivered: a leading blank defeats the prefix test."""
    return first_match([(any_ilike(code, p), name) for name, p in ICD_CATEGORIES], "OTHER")


def drug_class(name: Column) -> Column:
    return first_match([(any_ilike(name, p), label) for label, p in DRUG_CLASSES], "OTHER")


def lab_flag(result: Column, low: Column, high: Column, reported: Column) -> Column:
    """Range check when all three numbers exist, otherwise the reported flag."""
    complete = result.isNotNull() & low.isNotNull() & high.isNotNull()
    checked = first_match([(result < low, "LOW"), (result > high, "HIGH")], "NORMAL")
    return F.when(complete, checked).otherwise(reported)


def referral_risk(lvef: Column, mets: Column, reported: Column) -> Column:
    """Exercise risk; values outside every branch keep the reported category."""
    return first_match(
        [
            ((lvef >= 50) & (mets >= 7), "LOW"),
            (lvef.between(40, 49), "MODERATE"),
            (lvef < 40, "HIGH"),
        ],
        F.upper(F.trim(reported)),
    )


def reserve_percent(peak: Column, rest: Column, target_high: Column) -> Column:
    """Share of the heart-rate reserve that was reached."""
    share = (peak - rest).cast("double") / F.nullif(target_high - rest, F.lit(0)) * 100
    return F.when((target_high > 0) & (rest > 0), F.round(share, 1))


def recovery_delta(peak: Column, recovery: Column) -> Column:
    return F.when((peak > 0) & (recovery > 0), peak - recovery)


def safety_flag(peak_sys: Column, peak_dia: Column, rest_sys: Column, spo2: Column, stopped: Column) -> Column:
    """True if any of four limits was hit; unknown inputs do not raise the flag."""
    return first_match(
        [
            ((peak_sys > 250) | (peak_dia > 115), F.lit(True)),
            (peak_sys < rest_sys - 10, F.lit(True)),
            (spo2 < 88, F.lit(True)),
            (stopped, F.lit(True)),
        ],
        F.lit(False),
    )


def phq9_band(score: Column) -> Column:
    return first_match([(score >= low, name) for name, low in PHQ9_BANDS], "MINIMAL")


def age_group(age: Column) -> Column:
    """Age band; an unknown age ends in the last band."""
    return first_match([(age < limit, name) for name, limit in AGE_GROUPS], "75+")


def walk_significance(delta: Column) -> Column:
    return F.when(delta >= 25, "CLINICALLY_SIGNIFICANT").otherwise("NOT_SIGNIFICANT")
