"""Repeatable sampling and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MULTIPLIER, MODULUS, KEY_RANGE = 2654435761, 4294967296, 2147483648


def scatter(key: Column) -> Column:
    """Integer spread of a key that orders rows as if at random, the same way every time."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(KEY_RANGE)) * MULTIPLIER, F.lit(MODULUS))  # the product stays below 2^63


def sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` rows in scattered order: a top-k per partition, then one merge; no full sort."""
    return df.withColumn("_order", scatter(key)).orderBy("_order", key).limit(n).drop("_order")
