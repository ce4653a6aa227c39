"""Dense surrogate keys from a persistent registry: unchanged on reload, gapless for new ids, never the same twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsemart.sources.versions import VersionedTable

INSIDE = (1 << 33) - 1  # the row within its partition, in a monotonically increasing id


def registered(registry: VersionedTable, rows: DataFrame, key: str, name: str = "surrogate_key") -> DataFrame:
    """(key, name) of every id known after ``rows``: ids seen before keep their number, new ones follow on.

    New ids are sorted by range, written with their row within the partition, and numbered by adding the
    rows of the partitions before: one count per partition is all that visits the driver. A null id gets
    no number. Of two writers at once one is refused.
    """
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct()
    manifest = registry.manifest()
    taken = manifest["counters"].get("numbers", 0)
    fresh = ids if manifest["schema"] is None else ids.join(registry.read().select(key), key, "left_anti")
    placed = VersionedTable(registry.spark, f"{registry.folder}/placed", key)
    placed.overwrite_sorted(fresh.repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", F.monotonically_increasing_id()))
    stored = placed.read()
    part = F.shiftright("_place", 33)
    counts = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not counts and manifest["schema"] is not None:
        return registry.read().select(key, name)
    offsets, total = [], taken
    for number in sorted(counts):
        offsets.append((number, total))
        total += counts[number]
    starts = F.broadcast(registry.spark.createDataFrame(offsets, "_part long, _start long"))  # one row per partition
    numbered = stored.withColumn("_part", part).join(starts, "_part").select(
        key, (F.col("_start") + F.col("_place").bitwiseAND(INSIDE) + 1).alias(name)
    )
    registry.append(numbered, {"numbers": total})
    return registry.read().select(key, name)
