"""Makes query results comparable across engines: dates, times and exact numbers as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def plain(df: DataFrame) -> DataFrame:
    """Dates as ISO text, timestamps as text to the microsecond, decimals as text with all their places; the rest as is."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def steady(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Rounds means of non-dyadic doubles, whose last bit depends on the order of addition."""
    for name in columns:
        df = df.withColumn(name, F.round(name, places))
    return df
