"""The health tables of one data directory, each built lazily and at most once per plan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pulsemart.functions.dates import moment
from pulsemart.plans import silver
from pulsemart.sources import bridge

CLINICAL_DAY = "2002-01-01 00:00:00"
LINE_TABLES = {"raw_diagnoses", "raw_medications", "raw_rehab_sessions", "raw_claims"}


class Health:
    """Raw and silver tables as lazy DataFrames; nothing runs until an action."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = CLINICAL_DAY):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, moment(as_of)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("raw_") or name == "care_team_assignments":
            source = self.lines if name in LINE_TABLES else self.sf_dir
            table = getattr(bridge, name)(self.spark, source)
            self.__dict__[name] = table
            return table
        raise AttributeError(name)

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their patient, shared by the line-level tables."""
        return bridge.lines_with_patient(self.spark, self.sf_dir)

    @cached_property
    def dim_patient(self) -> DataFrame:
        return silver.dim_patient(self.raw_patients, self.as_of)

    @cached_property
    def fact_encounter(self) -> DataFrame:
        return silver.fact_encounter(self.raw_encounters, self.as_of)

    @cached_property
    def fact_diagnosis(self) -> DataFrame:
        return silver.fact_diagnosis(self.raw_diagnoses)

    @cached_property
    def fact_medication(self) -> DataFrame:
        return silver.fact_medication(self.raw_medications)

    @cached_property
    def fact_lab_result(self) -> DataFrame:
        return silver.fact_lab_result(self.raw_lab_results)

    @cached_property
    def fact_rehab_referral(self) -> DataFrame:
        return silver.fact_rehab_referral(self.raw_rehab_referrals)

    @cached_property
    def fact_rehab_session(self) -> DataFrame:
        return silver.fact_rehab_session(self.raw_rehab_sessions)

    @cached_property
    def fact_rehab_outcome(self) -> DataFrame:
        return silver.fact_rehab_outcome(self.raw_rehab_outcomes)

    def stored(self, name: str) -> DataFrame:
        """A silver table with its surrogate key and transformation time, as it is written."""
        return silver.stored_form(name, getattr(self, name), self.as_of)

    def silver_tables(self) -> dict[str, DataFrame]:
        names = [
            "dim_patient", "fact_encounter", "fact_diagnosis", "fact_medication", "fact_lab_result",
            "fact_rehab_referral", "fact_rehab_session", "fact_rehab_outcome",
        ]
        return {name: getattr(self, name) for name in names}
