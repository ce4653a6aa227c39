"""Helpers of the corpus operators: reading, stored intermediate tables, connected components."""

from __future__ import annotations

import itertools
import os
import pathlib
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.sources.store import shared_folder

ASCII_SPACE = "[^\\x20\\x09-\\x0D]+"  # a word: a run of anything else


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes the table into the folder every executor can reach and reads it back.

    This cuts the lineage, and a lost executor costs only the tasks that were running on it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches(fn: Callable[[dict[str, list]], Iterator[dict[str, list]]], schema: pa.Schema):
    """A function for ``mapInArrow`` from one over columns as Python lists; integers with nulls stay integers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in fn(part.to_pydict() for part in parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
            )

    return run


def per_batch(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema):
    return batches(lambda parts: (fn(part) for part in parts), schema)


def ddl(schema: pa.Schema) -> str:
    """The Spark form of an Arrow schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def map_arrow(df: DataFrame, fn, schema: pa.Schema) -> DataFrame:
    importable(df.sparkSession)
    return df.mapInArrow(fn, ddl(schema))


def importable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it; a cluster ships it with the job."""
    root, environment = str(pathlib.Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def crc_fold(column: Column, folds: int) -> Column:
    """The fold of a row: crc32 of the id as text, modulo the number of folds (a null id: crc32 of '')."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the digest of the text of every row of ``docs``: the key of ``rows_of``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def rows_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with the (doc_id, digest) of ``keys``, each key once.

    ``keys``: distinct, with ``n``, the rows of ``docs`` that have the key. Texts cross the network
    once for the join; only rows whose key occurs several times are compared with one another.
    """
    keys = stored(keys.select(F.col("doc_id").alias("_id_"), F.col("digest").alias("_digest_"), F.col("n").alias("_n_")), "keys")
    rows = docs.withColumn("_text_digest_", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    same = rows["doc_id"].cast("long").eqNullSafe(keys["_id_"]) & (rows["_text_digest_"] == keys["_digest_"])
    single = rows.join(keys.where("_n_ = 1"), same, "left_semi")
    if not keys.where("_n_ > 1").limit(1).collect():
        return single.select(*docs.columns)
    several = rows.join(keys.where("_n_ > 1"), same, "left_semi").dropDuplicates(["doc_id", "_text_digest_"])
    return single.unionByName(several).select(*docs.columns)


def chunked(values: list, size: int) -> Iterator[list]:
    it = iter(values)
    while part := list(itertools.islice(it, size)):
        yield part


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that links reach.

    Alternating large-star and small-star steps; each is two aggregates with map-side partial
    results and joins, so a node with a third of all links is never gathered in one place
    (skewed joins are split by adaptive execution). The links after each round are stored.
    """
    links = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links"
    )
    seen = _mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("m").alias("v"), F.col("v").alias("m")))
        lowest = both.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("low"))
        large = (
            both.where("m > v").join(lowest, F.col("v") == F.col("u"))
            .select(F.col("m").alias("v"), F.least("u", "low").alias("m")).distinct()
        )
        lowest = large.groupBy(F.col("v").alias("u")).agg(F.min("m").alias("low"))
        small = large.join(lowest, F.col("v") == F.col("u")).where("m <> low").select(
            F.col("m").alias("v"), F.col("low").alias("m")
        )
        links = stored(small.unionByName(lowest.select(F.col("u").alias("v"), F.col("low").alias("m"))).distinct(), "links")
        now = _mark(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("m").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple[int, Any]:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    return row[0], row[1]
