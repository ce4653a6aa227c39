"""Reading feeds as streams and keeping their results in tables.

A query runs with ``availableNow``: it takes what has arrived and stops. Results go to one
folder per micro-batch, so a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.sources.store import shared_folder
from pulsemart.sources.versions import VersionedTable

MERGED_FILES = 200  # files of streamed state above which it is put together


def read_feed(spark: SparkSession, folder: str, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_table(
    stream: DataFrame, mode: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch, folder: str | None = None
) -> DataFrame:
    """Runs the stream over what has arrived and returns all batches with their number.

    With a ``folder`` a later call goes on where this one stopped; without one it starts anew.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/feeds/{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    try:
        return spark.read.parquet(f"{folder}/out")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return shape(spark.createDataFrame([], stream.schema)).withColumn("batch", F.lit(0))  # nothing has arrived yet


def run_to_versions(
    stream: DataFrame, table: VersionedTable, shape: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame], DataFrame],
    files: int = MERGED_FILES,
) -> DataFrame | None:
    """Runs the stream into a versioned table of mergeable state; its rows, or None if nothing has arrived yet.

    A batch appends ``shape(batch)``, and the manifest takes the number of the batch in the same commit, so a batch
    that runs again after a failure is not counted twice. Above ``files`` files the state is put together by
    ``merged``, so it holds what the keys need and not what the batches brought.
    """
    def store(batch: DataFrame, number: int) -> None:
        manifest = table.manifest()
        if number <= manifest["counters"].get("batch", -1):
            return
        table.append(shape(batch), {"batch": number})
        if len(table.manifest()["files"]) > files:
            table.overwrite(merged(table.read()))
            table.remove_old()

    query = (
        stream.writeStream.option("checkpointLocation", f"{table.folder}/progress")
        .trigger(availableNow=True).foreachBatch(store).start()
    )
    query.awaitTermination()
    return table.read() if table.versions() else None
