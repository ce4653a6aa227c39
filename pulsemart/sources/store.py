"""Loading and writing tables: overwrite, append with defaults, refresh, snapshots, views."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsemart.functions.numbers import count_where


_LOCAL_FOLDERS: dict[str, str] = {}  # one temporary folder per local application


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="pulsemart-"))


def load(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with a declared schema; nothing is inferred when one is given."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes the table, replacing an older one, and reads it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Writes the table hashed and sorted by ``key``; tables written alike join on it without an exchange.

    Rows are brought together per bucket first, so each bucket is one file per write and not
    one per task.
    """
    (
        df.repartition(buckets, key)
        .write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
        .option("path", path).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def align(df: DataFrame, target: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns of the target in order; a column not delivered takes its default or null."""
    defaults = defaults or {}
    present = set(df.columns)
    columns = []
    for field in target.fields:
        value = F.col(field.name) if field.name in present else defaults.get(field.name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def append(df: DataFrame, path: str, target: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    align(df, target, defaults).write.mode("append").parquet(path)
    return df.sparkSession.read.schema(target).parquet(path)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """Full reload: repeating it leaves one copy of the data."""
    return save(df, path)


def view(df: DataFrame, name: str) -> DataFrame:
    """A named, late-bound view of a pipeline."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def snapshot(df: DataFrame, version: str, as_of: Column) -> DataFrame:
    """Tags a training set with its version and build time; write it partitioned by the version."""
    return df.withColumn("dataset_version", F.lit(version)).withColumn("created_at", as_of)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one counting pass each."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def column_inventory(tables: dict[str, DataFrame], key_columns: list[str]) -> DataFrame:
    """Name, type, filled rows and kind of the key columns each table has."""
    result = None
    for name, df in tables.items():
        present = [(c, t) for c, t in df.dtypes if c in key_columns]
        if not present:
            continue
        filled = df.agg(*[count_where(F.col(c).isNotNull()).alias(c) for c, _ in present])
        entries = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col(c).alias("filled_rows"))
            for c, t in present
        ])
        part = filled.select(F.lit(name).alias("table_name"), F.inline(entries))
        result = part if result is None else result.unionByName(part)
    return result.withColumn("column_type", F.lit("Key Clinical Column"))
