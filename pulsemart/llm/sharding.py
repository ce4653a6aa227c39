"""Shards as runs along a Hilbert curve over document metadata.

Each dimension is quantised to the same number of bits; a row's place on the curve is its Hilbert
index, then the hash of its text, then its id. Rows are ordered by a range partitioning, so rows of
a hot cell or a large group of copies are spread over tasks too; running bytes are taken inside the
partitions and one offset per partition is added. The curve is cut where the bytes of a shard are
full, so sizes are near equal (law ``bytes``): a row belongs to the shard that its middle byte falls
in. Copies of a text lie side by side, and a group of copies smaller than ``SNAP`` of a shard is not
cut: its middle byte decides for all of it.

Defined results: a null text has no bytes, so size 8 and crc 0; null dimensions have cell 0; rows
with a null id come first among equal texts; repeated rows each get a slot; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import LongType, StructType

from pulsemart.llm import common

SHARDS, BITS, HEADER, SNAP = 24, 8, 8, 0.02

_PLACED = pa.schema([
    ("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("text_hash", pa.int64()), ("curve", pa.int64()),
])
_RUNNING = pa.schema([*_PLACED, ("part", pa.int32()), ("bytes_before", pa.int64()), ("rows_before", pa.int64())])


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of points (n, dimensions) with coordinates below 2**bits (Skilling's transform)."""
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            up = (x[:, i] & q) != 0
            x[:, 0] ^= np.where(up, q - 1, 0)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, i]) & q - 1)
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    turn, q = np.zeros(len(x), np.int64), 1 << bits - 1
    while q > 1:
        turn ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    index = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[:, i] >> bit & 1)
    return index


def text_dimensions(bits: int = BITS) -> dict[str, Column]:
    """Language, size and number of lines: copies of a text share them, and readers filter on them."""
    text = F.coalesce("text", F.lit(""))
    top = (1 << bits) - 1

    def scaled(column: Column, steps: int) -> Column:
        return F.least(F.floor(F.log2(column + 1) * steps), F.lit(top))

    return {
        "lang": F.pmod(F.crc32(F.coalesce("lang", F.lit(""))), F.lit(1 << bits)),
        "size": scaled(F.octet_length(text), 8),
        "lines": scaled(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), 8),
    }


def _place(names: list[str], bits: int):
    def run(part: dict[str, list]) -> dict[str, list]:
        axes = np.array([[c or 0 for c in part[f"axis_{name}"]] for name in names], np.int64).reshape(len(names), -1).T
        return {**part, "curve": hilbert_index(axes, bits)}

    return run


def _run_totals(parts):
    from pyspark import TaskContext

    number, held, rows = TaskContext.get().partitionId(), 0, 0
    for part in parts:
        sizes = np.array(part["size"], np.int64)
        after = held + np.cumsum(sizes)
        n = len(sizes)
        yield {**part, "part": [number] * n, "bytes_before": after - sizes, "rows_before": np.arange(rows, rows + n)}
        held, rows = (int(after[-1]) if n else held), rows + n


def hilbert_shards(docs: DataFrame, dimensions: Mapping[str, Column] | None = None, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve for every row of ``docs``.

    ``dimensions``: integer columns below 2**bits, as many as fit in 62 bits together.
    """
    dimensions = dict(dimensions or text_dimensions(bits))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        *(column.cast("long").alias(f"axis_{name}") for name, column in dimensions.items()),
    )
    placed = common.map_arrow(rows, common.per_batch(_place(list(dimensions), bits), _PLACED), _PLACED)
    ordered = placed.repartitionByRange("curve", "text_hash", "doc_id").sortWithinPartitions("curve", "text_hash", "doc_id")
    running = common.stored(common.map_arrow(ordered, common.batches(_run_totals, _RUNNING), _RUNNING), "curve")
    totals = running.groupBy("part").agg(F.sum("size"), F.count("*")).orderBy("part").collect()  # a row per partition
    offsets, total, seen = [], 0, 0
    for part, size, n in totals:
        offsets.append((part, total, seen))
        total, seen = total + size, seen + n
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, bytes_offset long, rows_offset long"))
    located = running.join(starts, "part").select(
        "doc_id", "size", "text_crc32", "text_hash", "curve",
        (F.col("bytes_before") + F.col("bytes_offset")).alias("at"), (F.col("rows_before") + F.col("rows_offset")).alias("nth"),
    )
    groups = located.groupBy("curve", "text_hash").agg(F.min("at").alias("group_at"), F.sum("size").alias("group_size"))
    groups = common.stored(groups, "groups")  # the join then has plain exchanges, which adaptive execution can split
    whole = F.col("group_size") <= int(SNAP * total / shards)
    middle = F.when(whole, 2 * F.col("group_at") + F.col("group_size")).otherwise(2 * F.col("at") + F.col("size"))
    cut = located.join(groups, ["curve", "text_hash"]).withColumn("shard", F.floor(middle * F.lit(shards) / F.lit(2.0 * max(total, 1))).cast("int"))
    cut = common.stored(cut.withColumn("shard", F.least("shard", F.lit(shards - 1))), "shards")
    firsts = cut.groupBy("shard").agg(F.min("nth").alias("first"))  # a row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def _with_curve(docs: DataFrame, dimensions: Mapping[str, Column], bits: int) -> DataFrame:
    """``docs`` with the curve index of every row in ``_curve_``."""
    rows, names = docs.select("*", *(column.cast("long").alias(f"_axis_{name}_") for name, column in dimensions.items())), list(dimensions)

    def run(parts):
        for part in parts:
            axes = np.array([[c or 0 for c in part.column(f"_axis_{name}_").to_pylist()] for name in names], np.int64)
            yield part.append_column("_curve_", pa.array(hilbert_index(axes.reshape(len(names), -1).T, bits), pa.int64()))

    common.importable(docs.sparkSession)
    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("_curve_", LongType())).select(*docs.columns, "_curve_")


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, dimensions: Mapping[str, Column] | None = None, bits: int = BITS) -> None:
    """Writes ``docs`` into one folder per shard, in the order of the curve; min/max statistics then prune files.

    ``dimensions`` and ``bits`` as ``assigned`` was made with. Every row is written once: rows with no id or
    the same id meet their places by size, checksum and curve, and rows alike in all of these are numbered.
    """
    text, same = F.coalesce("text", F.lit("")), ["_id_", "_null_", "_size_", "_crc_", "_curve_"]
    number = F.row_number().over(W.partitionBy(*same).orderBy(*same)).alias("_nth_")

    def named(df: DataFrame, size: Column, crc: Column) -> DataFrame:
        given = df.withColumns({"_id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_null_": F.col("doc_id").cast("long").isNull()})
        return given.withColumns({"_size_": size.cast("long"), "_crc_": crc}).select("*", number)

    rows = named(_with_curve(docs, dict(dimensions or text_dimensions(bits)), bits), F.octet_length(text) + HEADER, F.crc32(text))
    places = named(assigned.withColumnRenamed("curve", "_curve_"), F.col("size"), F.col("text_crc32"))
    (
        rows.join(places.select(*same, "_nth_", "shard", "slot"), [*same, "_nth_"]).select(*docs.columns, "shard", "slot")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op2_sharding": op2_sharding}
