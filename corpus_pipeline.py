"""The corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Each stage reads what its predecessor kept. The first four return the columns of documents; the last
returns one row per packed piece. Every stage judges its own input: quality learns from the labels
of all rows given, groups of copies and near copies are found among the rows that are left, and the
mixing rates are fitted to what is left then. Near copies are texts whose fingerprints of three-word
shingles differ in two bits or fewer, as in op8_simhash. Mixing brings clean text to 98 per cent of
the words, low and toxic text to one each; no document is repeated, so a domain below its weight stays
whole, and one whose leading domain is clean is never thinned.

Defined results: rows with a null text are empty texts; of a group of near copies the smallest id
stays, a row without an id only if the group has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsemart.llm import common, exact_dedup, mixing, packing, quality, simhash
from pulsemart.sources.store import shared_folder

SHINGLE_WORDS, MAX_BITS = 3, 2
TARGETS = {"clean": 0.98, "low": 0.01, "toxic": 0.01}
WHOLE = ["clean"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, SHINGLE_WORDS, MAX_BITS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"), TARGETS, repeat=False, whole=WHOLE)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the result of each is written as Parquet and read again."""
    docs, folder = common.table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
