"""The log tables of one data directory, lazily built, and the shared history scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.functions.dates import back, moment
from pulsemart.sources import logs

LOG_DAY = "2024-01-31 00:00:00"


class Logs:
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = LOG_DAY):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, moment(as_of)

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("masking_policies", "row_access_policies"):
            table = logs.policies(self.spark, "MASK" if name == "masking_policies" else "ROW")
        elif hasattr(logs, name):
            table = getattr(logs, name)(self.spark, self.sf_dir)
        else:
            raise AttributeError(name)
        self.__dict__[name] = table
        return table


def since_midnight(df: DataFrame, time: str, as_of: Column, amount: int, unit: str, like: dict[str, str] | None = None):
    """Like ``recent``, counted from the midnight that starts the day of ``as_of``."""
    return recent(df, time, F.to_date(as_of).cast("timestamp_ntz"), amount, unit, like)


def recent(df: DataFrame, time: str, as_of: Column, amount: int, unit: str, like: dict[str, str] | None = None):
    """Rows of the last ``amount`` units, counted from the instant, whose listed columns match a prefix pattern."""
    scanned = df.filter(F.col(time) >= back(as_of, amount, unit))
    for column, pattern in (like or {}).items():
        scanned = scanned.filter(F.col(column).like(pattern))
    return scanned
