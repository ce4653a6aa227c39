"""Newest-row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest_first(load_time: str, *tie_breaks: str) -> list[Column]:
    """Descending order in which an unknown load time counts as newest."""
    return [F.col(load_time).desc_nulls_first(), *[F.col(c).desc_nulls_first() for c in tie_breaks]]


def latest_by(df: DataFrame, key: str, order: list[Column], keep: int = 1, spread: bool = False) -> DataFrame:
    """The first ``keep`` rows per key.

    Row-number plus filter lets Spark keep only ``keep`` rows per key on the map side
    (WindowGroupLimit), so a key that holds a large part of the table never travels whole.

    Business ids share a long prefix, which makes sorting by them slow. ``spread`` puts a hash
    of the key in front of it. Leave it off where the result is joined on the key next: the
    exchange of a plain key is reused by that join.
    """
    cluster = [F.xxhash64(key), F.col(key)] if spread else [F.col(key)]
    window = Window.partitionBy(*cluster).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= keep).drop("_rank")
