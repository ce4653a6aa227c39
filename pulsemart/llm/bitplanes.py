"""Centroid clustering on bit planes: exact integer k-means by AND and popcount.

A component x becomes the integer floor(scale * x). Bit b of the 64 components of a vector is
packed into one unsigned 64-bit word, its plane b; the planes are the two's complement of the
components, so the highest plane counts negatively. The dot product of a vector and a centroid is
the sum over pairs of planes of their weights times the popcount of the AND, and squared distances
follow from it without any rounding. A vector is stored as its planes only (seven words where the
components stay within one) and component sums of a cluster are weighted bit counts.

A round is one pass over the planes: every task adds up its clusters and hands back one row per
cluster, so a cluster with any share of the rows costs no exchange. Only the centroids (``k`` rows
of 64 integers) visit the driver.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite components are left out, and so are components of 16,384 and more in size, whose squared
distances would leave a long when added up; repeated rows are vectors of their own; a null vec_id
sorts last among the first centroids; fewer vectors than ``k`` give as many clusters as vectors; an
inertia beyond a long is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsemart.llm import common

WIDTH = 64  # components of a vector, bits of a word
LARGEST = 16_384.0  # size a component stays below
SLAB = 8192  # vectors compared at a time

_STORED = pa.schema([("vec_id", pa.int64()), ("planes", pa.list_(pa.int64())), ("norm", pa.int64())])
_SUMS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def pack(values: np.ndarray) -> np.ndarray:
    """The planes (rows x bits) of integers (rows x 64): as many as the largest of them needs, sign included."""
    largest = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    bits = largest.bit_length() + 1
    planes = np.empty((len(values), bits), np.uint64)
    for b in range(bits):
        planes[:, b] = np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(bits: int) -> np.ndarray:
    """The value of each plane; the highest holds the sign."""
    out = np.left_shift(1, np.arange(bits), dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows of ``x`` with all rows of ``y``, both as planes."""
    out = np.zeros((len(x), len(y)), np.int64)
    for a, wa in enumerate(weights(x.shape[1])):
        for b, wb in enumerate(weights(y.shape[1])):
            out += wa * wb * np.bitwise_count(x[:, a, None] & y[None, :, b]).astype(np.int64)
    return out


def sums(x: np.ndarray) -> np.ndarray:
    """The componentwise sum of vectors given as planes: weighted counts of set bits."""
    ones = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, 8), axis=2, bitorder="little").sum(axis=0, dtype=np.int64)
    return weights(x.shape[1]) @ ones


def nearest(x: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid (integers); the smaller number wins ties."""
    away = norm[:, None] + (centroids * centroids).sum(axis=1) - 2 * dots(x, pack(centroids))
    best = away.argmin(axis=1)
    return best.astype(np.int32), away[np.arange(len(x)), best]


def _planes(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, planes) by number of planes."""
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    starts, out = np.cumsum(lengths) - lengths, []
    for bits in np.unique(lengths):
        rows = np.flatnonzero(lengths == bits)
        out.append((rows, flat[starts[rows][:, None] + np.arange(bits)].view(np.uint64)))
    return out


def _slabs(parts):
    for part in parts:
        for at in range(0, part.num_rows, SLAB):
            yield part.slice(at, SLAB)


def _packing(scale: int):
    def run(parts):
        for part in _slabs(parts):
            x = part.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            q = np.floor(scale * x).astype(np.int64)
            planes = pack(q)
            rows = pa.ListArray.from_arrays(np.arange(len(q) + 1, dtype=np.int32) * planes.shape[1], pa.array(planes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), rows, pa.array((q * q).sum(axis=1))], schema=_STORED)

    return run


def _adding(centroids: np.ndarray):
    def run(parts):
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), WIDTH), np.int64)
        for part in _slabs(parts):
            norm = part.column(2).to_numpy()
            for rows, x in _planes(part.column(1)):
                own, _ = nearest(x, norm[rows], centroids)
                for c in np.unique(own):
                    some = own == c
                    n[c] += some.sum()
                    total[c] += sums(x[some])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": used, "n": n[used], "sums": total[used].tolist()}, schema=_SUMS)

    return run


def _assigning(centroids: np.ndarray):
    def run(parts):
        for part in _slabs(parts):
            norm, own, away = part.column(2).to_numpy(), np.empty(part.num_rows, np.int32), np.empty(part.num_rows, np.int64)
            for rows, x in _planes(part.column(1)):
                own[rows], away[rows] = nearest(x, norm[rows], centroids)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), pa.array(away)], schema=_ASSIGNED)

    return run


def _usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) == WIDTH) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST))), F.lit(False))


def packed(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, planes, norm (squared length of the integers) of the usable rows of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return common.map_arrow(rows.where(_usable(F.col("embedding"))), _packing(scale), _STORED)


def _unpacked(planes: list[int]) -> np.ndarray:
    return sums(np.array([planes], np.int64).view(np.uint64))


def first_centroids(planes: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of the seed and their id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = planes.select("planes", order.alias("at")).orderBy(F.asc_nulls_last("at"), "planes").limit(k).collect()
    return np.array([_unpacked(r["planes"]) for r in first], np.int64).reshape(-1, WIDTH)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of every usable vector; the final centroids).

    Lloyd rounds over integers: a non-empty centroid becomes the floor of the mean of its vectors.
    """
    planes = common.stored(packed(vectors, scale), "planes")
    centroids = first_centroids(planes, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        part = common.map_arrow(planes, _adding(centroids), _SUMS)
        placed = part.select("cluster", "n", F.posexplode("sums").alias("at", "value"))
        found = placed.groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("n").alias("n")).collect()
        for r in found:
            centroids[r["cluster"], r["at"]] = int(r["value"]) // r["n"]
    return common.map_arrow(planes, _assigning(centroids), _ASSIGNED), centroids


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector."""
    assigned, centroids = cluster(vectors, k, rounds, scale, seed)
    total = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    of = {r["cluster"]: int(r["d"]) for r in total}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def fitting(value: int) -> Column:
        return F.lit(value if value < 1 << 63 else None).cast("long")

    inertia = F.array(*[fitting(of.get(i, 0)) for i in range(len(centroids))]) if of else F.array(F.lit(0).cast("long"))
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"),
        fitting(sum(of.values())).alias("inertia"), F.get(F.array(*map(F.lit, names or [""])), F.col("cluster")).alias("centroid_sha256"),
    )


def op11_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds written out: each one assigns every vector, then takes floors of means."""
    parts = [
        """kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q AS m
            FROM (SELECT q, sha256('1:' || vec_id::VARCHAR) AS h FROM kept ORDER BY h LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (SELECT vec_id, q, c, d FROM (
            SELECT vec_id, q, c, list_sum(list_transform(list_zip(q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d,
                   row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM kept CROSS JOIN c{i}) WHERE rn = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
                SELECT c, list(v ORDER BY j) AS m FROM (
                    SELECT c, j, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
                    FROM (SELECT c, unnest(q) AS v, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c) n ON n.c = c{i}.c)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
               (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} ON c{rounds}.c = a.c"""


SQL = {"op11_bitplane_clusters": _sql()}
QUERIES = {"op11_bitplane_clusters": op11_bitplane_clusters}
