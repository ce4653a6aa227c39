"""Ratios, shares, reproducible pseudo-random values and cyclic picks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null, not an error, when the denominator is zero."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent(numerator: Column, denominator: Column, places: int) -> Column:
    return F.round(ratio(numerator.cast("double"), denominator.cast("double")) * 100, places)


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds; zero, not null, when there are none."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def mix(key: Column, salt: int, modulus: int) -> Column:
    """Repeatable spread of an integer key over 0..modulus-1 (no random numbers)."""
    return F.pmod(key.cast("long") * 48271 + salt * 7919, F.lit(modulus))


def uniform(key: Column, salt: int, low: int, high: int) -> Column:
    """Repeatable integer in low..high, both ends included."""
    return mix(key, salt, high - low + 1) + low


def constants(values: list[str]) -> Column:
    """Array literal of short texts."""
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"array({quoted})")


def pick(values: list[str], index: Column) -> Column:
    """Cyclic choice from a short list of constants."""
    return F.element_at(constants(values), (F.pmod(index.cast("long"), F.lit(len(values))) + 1).cast("int"))


def padded(prefix: str, key: Column, width: int = 12) -> Column:
    """Zero-padded business id; a key wider than ``width`` is kept whole, so ids never collide."""
    digits = key.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def gigabytes(value: Column) -> Column:
    return value / F.lit(1024.0**3)


def terabytes(value: Column) -> Column:
    return value / F.lit(1024.0**4)
