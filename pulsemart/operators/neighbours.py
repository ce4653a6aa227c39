"""Ordered look-back windows that survive a key holding a large part of the table.

A plain window sends every row of a key to one task. Keys above a row limit are cut into
slices along the sort order instead; each slice also receives the last rows of the slices
before it, so the window sees exactly the neighbours it would see in the whole key.

Everything is part of the plan: rows per key are counted when the plan runs, not when it is built,
and the cuts follow from the smallest and largest place of a key, so that every retry cuts alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from pulsemart.operators.latest import latest_by

HOT_ROWS = 5_000_000  # rows of one key that one task may sort


def windowed(
    df: DataFrame,
    key: str,
    order: list[str],
    lookback: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    hot_rows: int = HOT_ROWS,
    sized_by: DataFrame | None = None,
    place: str | None = None,
    unknown_last: bool = False,
) -> DataFrame:
    """Adds ``columns(window)``, where the window runs over ``key`` (never null) in ascending ``order``.

    ``order`` must be a total order within a key, and the columns may look at most
    ``lookback`` rows back. ``place`` is a number or time that never falls along the order (by default its
    first column; rows without one come first, or with ``unknown_last`` last): a key of more than
    ``hot_rows`` rows is cut into equal spans of it, so only rows alike in it are never parted.
    ``sized_by`` is a cheaper frame to count in, with at least the rows and places of each key of ``df``,
    such as the stored table that ``df`` is derived from.
    """
    place = place or order[0]
    hot = _hot_keys(df if sized_by is None else sized_by, key, place, hot_rows)  # rows / hot_rows at most
    hot = hot.select(F.struct(key).alias("_hot"), "_low", "_high", "_slices")
    if dict(df.dtypes)[place] in ("timestamp", "timestamp_ntz", "date"):
        at = _micros(place)
    else:
        at = F.col(place).cast("double")
    span = F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.col("_slices"))
    unknown = F.col("_slices") - 1 if unknown_last else F.lit(0)
    inside = F.least(F.greatest(F.coalesce(span, unknown), F.lit(0)), F.col("_slices") - 1)
    # A struct is never null, so the join adds no filter to ``df`` where it meets hot keys alone, and both readers of
    # ``df`` share its exchanges.
    joined = df.join(F.broadcast(hot), F.struct(key) == F.col("_hot"), "left")
    sliced = joined.withColumn("_slice", F.coalesce(inside, F.lit(0)).cast("int")).drop("_hot", "_low", "_high")
    cut = sliced.where("_slices is not null").drop("_slices")
    rows = sliced.drop("_slices").withColumn("_carried", F.lit(False)).unionByName(_carried_rows(cut, key, order, lookback))
    found = rows.withColumns(columns(Window.partitionBy(key, "_slice").orderBy(*order)))
    return found.filter(~F.col("_carried")).drop("_slice", "_carried")


def _micros(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double")


def _hot_keys(df: DataFrame, key: str, place: str, hot_rows: int) -> DataFrame:
    """Keys above the limit, the span of their places and the slices they are cut into."""
    timed = dict(df.dtypes)[place] in ("timestamp", "timestamp_ntz", "date")
    at = _micros(place) if timed else F.col(place).cast("double")
    sizes = df.groupBy(key).agg(F.count("*").alias("_rows"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    slices = F.ceil(F.col("_rows") / hot_rows).alias("_slices")
    return sizes.where((F.col("_rows") > hot_rows) & F.col(key).isNotNull()).select(key, "_low", "_high", slices)


def _carried_rows(sliced: DataFrame, key: str, order: list[str], lookback: int) -> DataFrame:
    """The last rows of each slice, once for every later slice whose first rows look back to them.

    The rows of a key are put in one list, some ``lookback`` for each slice, so ``sliced`` is read once.
    """
    tails = latest_by(
        sliced.withColumn("_piece", F.struct(key, "_slice")), "_piece", [F.desc(c) for c in order], lookback
    )
    row = F.struct(*[F.col(c) for c in sliced.columns])
    by_key = tails.groupBy(key).agg(F.collect_list(row).alias("_tails"))
    # The slices that exist, numbered without gaps, so "the slice before" always has a row.
    numbers = F.array_sort(F.array_distinct(F.transform("_tails", lambda t: t["_slice"])))
    reached = F.posexplode("_slices").alias("_n", "_to")
    # Each slice holds at least one row, so the last `lookback` slices hold enough of them.
    before = F.slice("_slices", F.greatest(F.col("_n") - lookback, F.lit(0)) + 1, F.least(F.col("_n"), F.lit(lookback)))
    return (
        by_key.select("_tails", numbers.alias("_slices"))
        .select("_tails", "_slices", reached)
        .select("_to", F.filter("_tails", lambda t: F.array_contains(before, t["_slice"])).alias("_tails"))
        .select("_to", F.explode("_tails").alias("_tail"))
        .select(*[F.col("_to" if c == "_slice" else f"_tail.{c}").alias(c) for c in sliced.columns])
        .withColumn("_carried", F.lit(True))
    )
