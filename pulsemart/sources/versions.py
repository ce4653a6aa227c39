"""Tables that change in place without ever being half written: versions of a list of files.

A write puts new files into a folder of its own and then commits a manifest that lists the files of
the new version; until then, and if the write fails, readers see the version before. Older versions
stay readable until ``remove_old`` deletes the files that only they list.

The manifest keeps the smallest and largest key of every file. ``merge`` places the changed keys
among these ranges, reads only the files that can hold them, and rewrites only those. A key that fills
several files is in all their ranges, so hot keys are split over files like any other rows.

The manifest is one small JSON file per version, written next to its place and renamed, through the
file system of the folder; two writers of one version are told apart by which of them renames first.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROWS_PER_FILE = 4_000_000


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Written:
    """What a commit did: its version, files written, files kept from the version before."""

    version: int
    new_files: int
    kept_files: int


class VersionedTable:
    """A table at ``folder`` with rows in files by ranges of ``key`` (text or whole numbers, never null)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.folder, self.key, self.rows_per_file = spark, folder.rstrip("/"), key, rows_per_file

    # ---- versions ---------------------------------------------------------------------------

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """All versions that can still be read, oldest first."""
        files, place = self._files(), self._path("versions")
        if not files.exists(place):
            return []
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """Files, schema and counters of a version, the newest by default."""
        known = self.versions()
        if not known:
            return {"version": -1, "files": [], "schema": None, "counters": {}}
        version = known[-1] if version is None else version
        stream = self._files().open(self._path(f"versions/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, files: list[dict], schema: T.StructType, counters: dict) -> None:
        body = json.dumps({"version": version, "files": files, "schema": schema.jsonValue(), "counters": counters})
        system, draft = self._files(), self._path(f"versions/.{uuid.uuid4().hex}.json")
        stream = system.create(draft)
        stream.write(bytearray(body.encode()))
        stream.close()
        place = self._path(f"versions/{version:012d}.json")
        if system.exists(place) or not system.rename(draft, place):
            system.delete(draft, False)
            raise Conflict(f"version {version} of {self.folder} is taken")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. The files are fixed now: later commits do not change what is read."""
        return self._rows(self.manifest(version))

    def _rows(self, manifest: dict, chosen: list[int] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError(f"nothing is stored in {self.folder} yet")
        schema = T.StructType.fromJson(manifest["schema"])
        files = manifest["files"] if chosen is None else [manifest["files"][i] for i in chosen]
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f['path']}" for f in files])

    # ---- writing ----------------------------------------------------------------------------

    def _store(self, df: DataFrame, partition_by: str | None = None) -> list[dict]:
        """Writes the rows into a new folder; path, rows and key range of each file."""
        name = f"data/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(f"{self.folder}/{name}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")
        found = stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows")
        ).collect()  # one row per file
        return [{"path": r.path[r.path.index(name):], "low": r.low, "high": r.high, "rows": r.rows} for r in found]

    def _next(self, manifest: dict, new: list[dict], kept: list[dict], schema: T.StructType, counters: dict | None) -> Written:
        files = sorted([*kept, *new], key=lambda f: (f["low"] is not None, f["low"], f["high"]))
        self._commit(manifest["version"] + 1, files, schema, {**manifest["counters"], **(counters or {})})
        return Written(manifest["version"] + 1, len(new), len(kept))

    def overwrite(self, df: DataFrame, *order: str, files: int | None = None) -> Written:
        """Replaces the rows, sorted by the key and ``order``; the old ones stay readable, also for the plan of ``df``."""
        by = [self.key, *order]
        dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
        return self.overwrite_sorted(dealt.sortWithinPartitions(*by))

    def overwrite_sorted(self, df: DataFrame) -> Written:
        """Replaces the rows by rows that already lie in the order they shall have."""
        return self._next(self.manifest(), self._store(df), [], df.schema, None)

    def append(self, df: DataFrame, counters: dict | None = None) -> Written:
        manifest = self.manifest()
        return self._next(manifest, self._store(df), manifest["files"], df.schema, counters)

    def merge(self, changes: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], *order: str) -> Written:
        """Puts ``combine(stored rows of the changed keys, changes)`` in place of the stored rows of these keys.

        ``changes`` has the key and whatever columns ``combine`` reads; in an empty table ``combine`` gets None. Files are sorted by the key and ``order``.
        """
        manifest = self.manifest()
        files = manifest["files"]
        if not files:
            return self.overwrite(combine(None, changes), *order)
        keys = changes.select(self.key).distinct()
        first, last = self._placed(files, F.col(self.key))
        spans = keys.select(F.explode(F.sequence(first, last)).alias("file")).distinct().collect()  # files at most
        touched = sorted(r.file for r in spans)
        if not touched:
            return Written(manifest["version"], 0, len(files))
        source = {files[i]["path"]: i for i in touched}
        named = self.spark.createDataFrame([(f"{p}", i) for p, i in source.items()], "_path string, _owner int")
        inside = F.regexp_extract("_metadata.file_path", "data/.*$", 0)
        rows = self._rows(manifest, touched).withColumn("_path", inside).join(named, "_path").drop("_path")
        stay = rows.join(keys, self.key, "left_anti")
        mine = rows.drop("_owner").join(keys, self.key, "left_semi")
        made = combine(mine, changes)
        made = made.withColumn("_owner", first.cast("int"))
        schema = T.StructType.fromJson(manifest["schema"])
        out = stay.select(*schema.names, "_owner").unionByName(made.select(*schema.names, "_owner"))
        held = sum(files[i]["rows"] for i in touched)
        parts = max(len(touched), math.ceil(held / self.rows_per_file))
        dealt = out.repartitionByRange(parts, "_owner", self.key, *order).sortWithinPartitions("_owner", self.key, *order)
        new = self._store(dealt, "_owner")
        kept = [f for i, f in enumerate(files) if i not in set(touched)]
        return self._next(manifest, new, kept, schema, None)

    def _placed(self, files: list[dict], key: Column) -> tuple[Column, Column]:
        """First and last file whose range can hold the key; one file where it lies between two ranges."""
        first = self._below([f["high"] for f in files], key, False)
        last = self._below([f["low"] for f in files], key, True) - 1
        first = F.least(first, F.lit(len(files) - 1))
        between = F.greatest(last, F.lit(0))
        return F.when(last < first, between).otherwise(first), F.when(last < first, between).otherwise(last)

    def _below(self, values: list, key: Column, equal: bool) -> Column:
        """How many of the ascending ``values`` lie below the key (or equal it): by blocks, then inside one."""
        step = math.isqrt(len(values)) + 1
        blocks = [values[at:at + step] for at in range(0, len(values), step)]
        kind = "bigint" if isinstance(values[0], int) else "string"
        below = (lambda v: v <= key) if equal else (lambda v: v < key)
        heads = F.from_json(F.lit(json.dumps([b[0] for b in blocks])), f"array<{kind}>")
        whole = F.greatest(F.size(F.filter(heads, below)) - 1, F.lit(0))
        block = F.get(F.from_json(F.lit(json.dumps(blocks)), f"array<array<{kind}>>"), whole)
        return whole * step + F.size(F.filter(block, below))

    def remove_old(self, keep: int = 1) -> int:
        """Deletes all but the newest ``keep`` versions and the files only they list; the number of folders removed."""
        known, system = self.versions(), self._files()
        gone, stay = known[:-keep], known[-keep:]
        used = {f["path"].split("/")[1] for v in stay for f in self.manifest(v)["files"]}
        dropped = {f["path"].split("/")[1] for v in gone for f in self.manifest(v)["files"]} - used
        for v in gone:
            system.delete(self._path(f"versions/{v:012d}.json"), False)
        for name in dropped:
            system.delete(self._path(f"data/{name}"), True)
        return len(dropped)
