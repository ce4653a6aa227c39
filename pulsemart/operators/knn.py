"""Exact nearest neighbours for many probes: cells, bounds from the triangle inequality, blocked matrix products.

Vectors are scaled to length one and dealt to the nearest of ``PIVOTS`` pivots, a bounded sample by
hash. A cell knows its radius. A probe looks into its own cell first; the distance of its k-th best
there bounds what any other cell has to offer, and cells that lie wholly beyond it are not visited.
Cells are cut into blocks of bounded size: a task holds one block at a time and multiplies it with
the probes that visit it as they stream by, so neither a hot cell nor the number of probes is held in
memory. Each block hands on its best ``k`` per probe; the cut to ``k`` over all blocks starts on the
map side. Nothing but pivots and cell sizes visits the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.operators.latest import latest_by
from pulsemart.sources.store import shared_folder

PIVOTS, BLOCK_ROWS, SLAB = 256, 4096, 2048
PLACES = 6  # of a similarity; ties after rounding go to the smaller key
SLACK = 4e-6  # on distances: rounding of similarities and of products

_DEALT = pa.schema([("key", pa.int64()), ("probe", pa.bool_()), ("unit", pa.binary()), ("cell", pa.int32()), ("away", pa.float64())])
_VISITS = pa.schema([("cell", pa.int32()), ("key", pa.int64()), ("unit", pa.binary())])
_FOUND = pa.schema([("probe_id", pa.int64()), ("neighbour_id", pa.int64()), ("rank_value", pa.int64())])


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/knn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _map(df: DataFrame, fn, schema: pa.Schema) -> DataFrame:
    from pyspark.sql.pandas.types import from_arrow_schema

    return df.mapInArrow(fn, from_arrow_schema(schema))


def _units(part: pa.RecordBatch, name: str) -> np.ndarray:
    rows = part.column(part.schema.get_field_index(name))
    return np.frombuffer(b"".join(rows.to_pylist()), np.float64).reshape(len(rows), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def _dealing(pivots: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, SLAB):
                some = part.slice(at, SLAB)
                x = some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                far = _distances(x, pivots)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(1), pa.array([row.tobytes() for row in x], pa.binary()),
                    pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]),
                ], schema=_DEALT)

    return run


def _top(similar: np.ndarray, keys: np.ndarray, probes: np.ndarray, k: int):
    """Per row of ``similar`` its ``k`` best keys by rounded similarity, then key; the probe itself left out."""
    value = np.floor(similar * 10**PLACES + 0.5).astype(np.int64)
    for i, probe in enumerate(probes.tolist()):
        row = value[i]
        others = keys != probe
        if k < others.sum():
            least = np.partition(row[others], -k)[-k]
            chosen = np.flatnonzero(others & (row >= least))
        else:
            chosen = np.flatnonzero(others)
        chosen = chosen[np.lexsort((keys[chosen], -row[chosen]))[:k]]
        yield probe, keys[chosen], row[chosen]


def _searching(k: int):
    """Rows sorted by (cell, block) with the vectors of a block before the probes that visit it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, units, joined = None, [], [], None
        for part in parts:
            places = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], axis=1)
            visiting = part.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1) | (visiting[1:] != visiting[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), part.num_rows]):
                if high == low:
                    continue
                some, place = part.slice(low, high - low), tuple(places[low])
                ids, x = some.column(3).to_numpy(), _units(some, "unit")
                if place != at:
                    at, keys, units, joined = place, [], [], None
                if not visiting[low]:
                    keys.append(ids), units.append(x)
                    joined = None
                    continue
                if not keys:
                    continue
                if joined is None:
                    joined = np.concatenate(keys), np.concatenate(units)
                for start in range(0, len(ids), 256):
                    probes = ids[start:start + 256]
                    out = list(_top(x[start:start + 256] @ joined[1].T, joined[0], probes, k))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(probes, [len(n) for _, n, _ in out])),
                        pa.array(np.concatenate([n for _, n, _ in out])), pa.array(np.concatenate([v for _, _, v in out])),
                    ], schema=_FOUND)

    return run


def _visiting(pivots: np.ndarray, cells: np.ndarray, radii: np.ndarray):
    """The cells beside its own that may hold a better neighbour of a probe than those found so far."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for low in range(0, part.num_rows, 256):
                some = part.slice(low, 256)
                far = _distances(_units(some, "unit"), pivots[cells])
                reach = np.sqrt(np.maximum(0.0, 2 - 2 * some.column(3).to_numpy(zero_copy_only=False).astype(float)))
                own = some.column(2).to_numpy()
                row, at = np.nonzero((far - radii <= reach[:, None] + SLACK) & (cells != own[:, None]))
                units = some.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(cells[at].astype(np.int32)), some.column(0).take(pa.array(row)), pa.array([units[i] for i in row], pa.binary()),
                ], schema=_VISITS)

    return run


def _search(dealt: DataFrame, visits: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """The best ``k`` of every block for the probes that visit its cell."""
    spark = dealt.sparkSession
    sizes = F.broadcast(spark.createDataFrame(list(blocks.items()), "cell int, blocks int"))  # PIVOTS rows at most
    rows = dealt.join(sizes, "cell").select(
        "cell", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("visits"), "key", "unit"
    )
    asked = visits.join(sizes, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visits"), "key", "unit"
    )
    together = rows.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "visits")
    return _map(together, _searching(k), _FOUND)


def nearest_of(
    corpus: DataFrame, probes: Column, key: str, vector: str, k: int, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, dict[str, int]]:
    """(probe_id, neighbour_id, similarity; counts of pairs) of the ``k`` most similar rows for every row that meets ``probes``.

    Similarity is the cosine to six places; ties go to the smaller key; a row is not its own neighbour. Rows
    without a vector, with an unset component, another number of components than most pivots have, or length
    zero take no part. The counts are ``all`` pairs of probes and rows and ``skipped``, those never multiplied.
    """
    usable = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0)
    rows = corpus.where(usable & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.coalesce(probes, F.lit(False)).alias("probe"), F.col(vector).cast("array<double>").alias("v")
    )
    chosen = rows.select("v").orderBy(F.xxhash64("key"), "key").limit(pivots).collect()  # a fixed number
    if not chosen:
        return corpus.sparkSession.createDataFrame([], "probe_id long, neighbour_id long, similarity double"), {"all": 0, "skipped": 0}
    width = max(len(r.v) for r in chosen)
    centres = np.array([r.v for r in chosen if len(r.v) == width], float)
    centres = np.unique(centres / np.sqrt((centres * centres).sum(axis=1, keepdims=True)), axis=0)
    dealt = _stored(_map(rows.where(F.size("v") == width), _dealing(centres), _DEALT), "cells")
    found = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.count_if("probe").alias("probes")).collect()
    size, asked = {r.cell: r.n for r in found}, {r.cell: r.probes for r in found}
    blocks = {c: -(-n // block_rows) for c, n in size.items()}
    cells = np.array(sorted(size))
    radii = np.array([next(r.radius for r in found if r.cell == c) for c in cells.tolist()])

    questions = dealt.where("probe")
    own = _stored(_search(dealt, questions.select("cell", "key", "unit"), blocks, k), "own")
    enough = latest_by(own, "probe_id", [F.desc("rank_value"), F.asc("neighbour_id")], k).groupBy("probe_id").agg(
        F.count("*").alias("n"), F.min("rank_value").alias("worst")
    )
    bound = F.when(F.col("n") >= k, F.col("worst") / 10**PLACES).otherwise(F.lit(-1.0))
    bounded = questions.join(enough, questions.key == enough.probe_id, "left").select(
        "key", "unit", "cell", F.coalesce(bound, F.lit(-1.0)).alias("bound")
    )
    visits = _stored(_map(bounded, _visiting(centres, cells, radii), _VISITS), "visits")
    visited = {r.cell: r.n for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    everything = own.unionByName(_search(dealt, visits, blocks, k))
    best = latest_by(everything, "probe_id", [F.desc("rank_value"), F.asc("neighbour_id")], k)
    pairs = sum(asked.values()) * sum(size.values())
    used = sum(asked[c] * size[c] for c in size) + sum(n * size[c] for c, n in visited.items())
    return best.select("probe_id", "neighbour_id", (F.col("rank_value") / 10**PLACES).alias("similarity")), {"all": pairs, "skipped": pairs - used}
