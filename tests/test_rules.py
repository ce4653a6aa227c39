"""Rule edges: hand-written inputs and the value each must give."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pulsemart.functions import dates, masks, rules
from pulsemart.plans import notes


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def lit(value, kind="double"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("lvef, mets, source, expected", [
    (55, 8, None, "LOW"), (55, 6, " moderate ", "MODERATE"), (49.5, 8, "high", "HIGH"), (40, 1, None, "MODERATE"),
    (39.9, 9, None, "HIGH"), (None, None, None, None),
])
def test_referral_risk(spark, lvef, mets, source, expected):
    assert one(spark, rules.referral_risk(lit(lvef), lit(mets), lit(source, "string"))) == expected


@pytest.mark.parametrize("code, expected", [
    ("I21.4", "ACUTE_MI"), ("i50.22", "HEART_FAILURE"), ("410.1", "ACUTE_MI"), ("Z95.5", "CARDIAC_DEVICE"),
    ("I35.0", "OTHER"), (" I21.4", "OTHER"), (None, "OTHER"),
])
def test_icd_category(spark, code, expected):
    assert one(spark, rules.icd_category(lit(code, "string"))) == expected


@pytest.mark.parametrize("name, expected", [
    ("Rivaroxaban 20mg", "OTHER"), ("Simvastatin", "OTHER"), ("Sotalol", "ANTIARRHYTHMIC"), ("ASPIRIN", "ANTIPLATELET"),
])
def test_drug_class(spark, name, expected):
    assert one(spark, rules.drug_class(F.lit(name))) == expected


@pytest.mark.parametrize("value, low, high, expected", [
    (5, 4, 6, "NORMAL"), (3, 4, 6, "LOW"), (7, 4, 6, "HIGH"), (7, None, None, "A"),
])
def test_lab_flag(spark, value, low, high, expected):
    assert one(spark, rules.lab_flag(lit(value), lit(low), lit(high), F.lit("A"))) == expected


@pytest.mark.parametrize("peak, rest, target, expected", [
    (120, 60, 140, 75.0), (120, 60, 60, None), (120, 60, None, None), (120, 60, 0, None),
])
def test_reserve_percent(spark, peak, rest, target, expected):
    assert one(spark, rules.reserve_percent(lit(peak, "int"), lit(rest, "int"), lit(target, "int"))) == expected


@pytest.mark.parametrize("peak_sys, peak_dia, rest_sys, spo2, stopped, expected", [
    (None, 116, None, None, None, True), (100, None, 111, None, None, True), (None, None, None, 87.9, None, True),
    (None, None, None, None, True, True), (None, None, None, None, None, False), (101, 115, 111, 88.0, False, False),
])
def test_safety_flag(spark, peak_sys, peak_dia, rest_sys, spo2, stopped, expected):
    flag = rules.safety_flag(lit(peak_sys, "int"), lit(peak_dia, "int"), lit(rest_sys, "int"), lit(spo2),
                             lit(stopped, "boolean"))
    assert one(spark, flag) is expected


@pytest.mark.parametrize("score, expected", [
    (20, "SEVERE"), (19, "MODERATELY_SEVERE"), (14, "MODERATE"), (9, "MILD"), (4, "MINIMAL"), (None, "MINIMAL"),
])
def test_phq9_band(spark, score, expected):
    assert one(spark, rules.phq9_band(lit(score, "int"))) == expected


@pytest.mark.parametrize("delta, expected", [
    (25.0, "CLINICALLY_SIGNIFICANT"), (24.9, "NOT_SIGNIFICANT"), (None, "NOT_SIGNIFICANT"),
])
def test_walk_significance(spark, delta, expected):
    assert one(spark, rules.walk_significance(lit(delta))) == expected


def test_boundary_dates(spark):
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    assert one(spark, dates.years_between(at("2000-12-31"), at("2001-01-01"))) == 1
    assert one(spark, dates.days_between(at("2001-01-01 23:00:00"), at("2001-01-02 01:00:00"))) == 1
    assert one(spark, dates.weeks_between(at("2024-01-06"), at("2024-01-08"))) == 1  # Saturday to Monday
    assert one(spark, dates.weeks_between(at("2024-01-08"), at("2024-01-14"))) == 0  # Monday to Sunday
    assert one(spark, dates.hours_between(at("2024-01-01 09:59:00"), at("2024-01-01 10:01:00"))) == 1


@pytest.mark.parametrize("mask, value, role, expected", [
    (masks.mask_patient_phi, "Smith", "HEALTH_DATA_ENGINEER", "*mith"),
    (masks.mask_patient_phi, "Lee", "HEALTH_ML_ENGINEER", "***"),
    (masks.mask_patient_phi, None, "HEALTH_DATA_ENGINEER", None),
    (masks.mask_patient_phi, None, "HEALTH_READONLY", "**REDACTED**"),
    (masks.mask_patient_phi, "Smith", "HEALTH_ML_ADMIN", "Smith"),
    (masks.mask_ssn, "123-45-6789", "HEALTH_ANALYST", "XXX-XX-6789"),
    (masks.mask_ssn, "123-45-6789", "HEALTH_ML_ADMIN", "***-**-****"),
    (masks.mask_phone_email, "jo.s@x.org", "HEALTH_DATA_ENGINEER", "jo***@***.com"),
    (masks.mask_phone_email, "(555) 123-4567", "HEALTH_DATA_ENGINEER", "***-***-4567"),
    (masks.mask_phone_email, "12345", "HEALTH_DATA_ENGINEER", "***"),
])
def test_masks(spark, mask, value, role, expected):
    assert one(spark, mask(lit(value, "string"), role)) == expected


def test_mask_dob(spark):
    born = F.lit(dt.date(1955, 3, 15))
    assert one(spark, masks.mask_dob(born, "HEALTH_ANALYST")) == dt.date(1955, 1, 1)
    assert one(spark, masks.mask_dob(born, "HEALTH_DATA_ENGINEER")) is None


@pytest.mark.parametrize("status, analyst, engineer", [
    ("CERTIFIED", True, True), ("UNDER_REVIEW", False, True), ("QUARANTINED", False, True), ("DEPRECATED", False, True),
    (None, True, True),
])
def test_quality_rows(spark, status, analyst, engineer):
    assert one(spark, masks.may_read_quality(lit(status, "string"), "HEALTH_ANALYST")) is analyst
    assert one(spark, masks.may_read_quality(lit(status, "string"), "HEALTH_DATA_ENGINEER")) is engineer


def test_entity_spans_against_brute_force(spark):
    index = {"heart failure": ("D", "HF"), "chronic heart failure": ("D", "CHF"), "heart": ("D", "H"), "aspirin": ("M", "A"), "ldl": ("L", "1")}
    texts = [
        "No chronic heart failure. Heart\nfailure; ASPIRIN, aspirins and ldl!", "Denies aspirin. Heart", "heart failure heart failure", "", None,
        "é heart-failure naïve: never had any chronic\theart  failure", "x " * 3000 + "without known LDL" + " y" * 50,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id int, note_text string")
    got = sorted((r.note_id, r.start, r.code, r.mention, r.negated) for r in notes.entity_spans(df, index).collect())
    want = []
    for i, text in enumerate(texts):
        flat, at = re.sub("[^a-z0-9]", " ", re.sub("[^A-Za-z0-9]", " ", text or "").lower()), 0
        while at < len(flat):
            fits = [p for p in index if flat.startswith(p, at) and not flat[at - 1:at].strip() and not flat[at + len(p):at + len(p) + 1].strip()]
            if fits:
                p = max(fits, key=len)
                want.append((i, at, index[p][1], text[at:at + len(p)], bool(re.search(notes.NEGATION, text[max(0, at - notes.LOOK_BACK):at]))))
                at += len(p)
            else:
                at += 1
    assert got == sorted(want) and sum(w[4] for w in want) >= 3
