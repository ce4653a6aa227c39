"""Type-2 history: one row per period in which the tracked attributes did not change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from pulsemart.functions.dates import end_of_time
from pulsemart.operators.neighbours import HOT_ROWS, windowed
from pulsemart.sources.store import save, shared_folder
from pulsemart.sources.versions import VersionedTable, Written


def versions(
    df: DataFrame, key: str, tracked: list[str], load_time: str = "load_timestamp", record: str = "record_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Periods of validity per key.

    A version that repeats the attributes of the one before it is dropped. A version ends
    where the next one starts, the current one on 9999-12-31. An unknown load time counts as newest,
    as in the newest-row rule.
    """
    marked = _marked(df, key, tracked, load_time, record, hot_rows)
    closed = _closed(marked.filter("_new"), key, load_time, hot_rows, _ordered(df, load_time, record))
    return closed.withColumn("effective_from", F.col(load_time)).select(
        key, *tracked, "effective_from",
        F.when(F.col("is_current"), end_of_time()).otherwise(F.col("effective_to")).alias("effective_to"), "is_current",
    )


def _ordered(df: DataFrame, load_time: str, record: str) -> DataFrame:
    return df.withColumns({
        "_unknown": F.col(load_time).isNull().cast("int"),
        "_newest_first": -F.unix_micros(F.col(load_time).cast("timestamp")),
        "_record_desc": -F.col(record),
    })


def _marked(df: DataFrame, key: str, tracked: list[str], load_time: str, record: str, hot_rows: int) -> DataFrame:
    """Adds ``_new``: the row differs from the one before it, or is the first of its key."""
    state = F.struct(*tracked)
    return windowed(
        _ordered(df, load_time, record), key, ["_unknown", load_time, record], 1,
        lambda w: {"_new": F.lag(F.lit(1)).over(w).isNull() | ~F.lag(state).over(w).eqNullSafe(state)},
        hot_rows, place=load_time, unknown_last=True,
    )


def _closed(changed: DataFrame, key: str, load_time: str, hot_rows: int, sized_by: DataFrame) -> DataFrame:
    """Adds the end of each version: the start of the next one of its key."""
    return windowed(
        changed.withColumn("_known", 1 - F.col("_unknown")), key, ["_known", "_newest_first", "_record_desc"], 1,
        lambda w: {"effective_to": F.lag(load_time).over(w), "is_current": F.lag(F.lit(1)).over(w).isNull()},
        hot_rows, sized_by, "_newest_first",
    )


def merge_versions(
    table: VersionedTable, rows: DataFrame, tracked: list[str], load_time: str = "load_timestamp", record: str = "record_id",
    hot_rows: int = HOT_ROWS,
) -> Written:
    """Merges a load of ``rows`` into the stored type-2 dimension ``table``; only files with keys of the load are rewritten.

    The table keeps every observation, those that repeat the state before them too (``is_version`` false),
    so loads may come late, in any order and more than once: after them ``stored_versions`` equals
    ``versions`` over all rows.
    """
    key, seen = table.key, [table.key, *tracked, load_time, record]
    fixed = ["effective_to", "is_current", "is_version"]
    folder = f"{shared_folder(table.spark)}/merges/{uuid.uuid4().hex}"

    def combine(known: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new.select(*seen) if known is None else known.select(*seen).unionByName(new.select(*seen))
        both = _written(both.dropDuplicates(), folder)
        marked = _written(_marked(both, key, tracked, load_time, record, hot_rows), folder)
        closed = _closed(marked.filter("_new"), key, load_time, hot_rows, marked).withColumn("is_version", F.lit(True))
        closed = closed.withColumn("effective_to", F.when(F.col("is_current"), end_of_time()).otherwise(F.col("effective_to")))
        repeats = marked.filter("not _new").select(
            *seen, F.lit(None).cast(closed.schema["effective_to"].dataType).alias("effective_to"),
            F.lit(False).alias("is_current"), F.lit(False).alias("is_version"),
        )
        return closed.select(*seen, *fixed).unionByName(repeats)

    return table.merge(_written(rows.select(*seen), folder), combine, load_time, record)


def _written(df: DataFrame, folder: str) -> DataFrame:
    """The rows in a file of their own, for a frame that several branches read."""
    return save(df, f"{folder}/{uuid.uuid4().hex}")


def stored_versions(table: VersionedTable, tracked: list[str], load_time: str = "load_timestamp", version: int | None = None) -> DataFrame:
    """The periods of a dimension kept by ``merge_versions``, in the form of ``versions``."""
    return table.read(version).filter("is_version").select(
        table.key, *tracked, F.col(load_time).alias("effective_from"), "effective_to", "is_current",
    )
