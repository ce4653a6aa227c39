import hashlib

import duckdb
import numpy as np

from pulsemart.llm import bitplanes as b
from pyspark.sql import types as T

ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("planes", T.StringType()), T.StructField("cluster", T.IntegerType())])


def brute(vectors, k=16, rounds=3):
    q = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in vectors.items()}
    first = sorted(q, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    cents = [q[i] for i in first]

    def assign():
        return {i: min((sum((a - c) ** 2 for a, c in zip(v, m)), n) for n, m in enumerate(cents)) for i, v in q.items()}

    for _ in range(rounds):
        own = assign()
        for n in range(len(cents)):
            mine = [q[i] for i in q if own[i][1] == n]
            if mine:
                cents[n] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    total = sum(d for d, _ in own.values())
    return {
        i: (n, d, sum(e for e, m in own.values() if m == n), total, hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())
        for i, (d, n) in own.items()
    }


def found(df):
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()}


def test_dots_sums_and_planes_are_exact():
    rng = np.random.default_rng(1)
    for high in (1, 40, 3000, 1 << 20):
        x, y = rng.integers(-high, high, (50, 64)), rng.integers(-high, high, (7, 64))
        assert (b.dots(b.pack(x), b.pack(y)) == x @ y.T).all()
        assert (b.sums(b.pack(x)) == x.sum(axis=0)).all()
    for edge in ([[-64] * 64], [[0] * 64], [[63] * 64], [[-1] * 64]):
        assert (b.sums(b.pack(np.array(edge))) == edge[0]).all()


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 64))
    good = {i: (centres[i % 9] + rng.normal(scale=0.3, size=64)).tolist() for i in range(300)}
    good[300] = good[299]
    good[301] = [100.0 * x for x in good[5]]
    good[302] = [0.0] * 64
    bad = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.1] * 63, [float("nan")] * 64, [float("inf")] + [0.1] * 63, [3e4] * 64]
    rows = [(i, v, "x", -1) for i, v in good.items()] + [(1000 + i, v, "x", -1) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(b.clusters(df)) == brute(good)


def test_ties_few_vectors_and_repeats(spark):
    few = spark.createDataFrame([(1, [0.5] * 64, "", 0), (2, [0.5] * 64, "", 0), (None, [1.5] * 64, "", 0)], ROWS)
    out = b.clusters(few).collect()
    assert len(out) == 3 and {r.distance for r in out} == {0}
    assert {r.cluster for r in out if r.vec_id} == {0}  # equal centroids: the smaller number
    again = b.clusters(few.unionByName(few)).collect()
    assert len(again) == 6


def test_empty(spark):
    out = b.clusters(spark.createDataFrame([], ROWS))
    assert out.count() == 0 and out.columns[:3] == ["vec_id", "cluster", "distance"]
    assert b.clusters(spark.createDataFrame([(1, None, "", 0)], ROWS)).count() == 0


def test_equals_sql_on_the_whole_table(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    sql = {r[0]: r[1:] for r in con.execute(b.SQL["op11_bitplane_clusters"]).fetchall()}
    assert found(b.op11_bitplane_clusters(spark, sf_dir)) == sql
