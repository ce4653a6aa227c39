"""Exact nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemart.operators.knn import nearest_of


def brute(vectors, probes, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for probe in probes:
        value = np.floor(x @ x[np.searchsorted(ids, probe)] * 1e6 + 0.5)
        order = [i for i in np.lexsort((ids, -value)).tolist() if ids[i] != probe][:k]
        out[probe] = [(int(ids[i]), value[i] / 1e6) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("probe_id", F.desc("similarity"), "neighbour_id").collect():
        out.setdefault(r.probe_id, []).append((r.neighbour_id, r.similarity))
    return out


@pytest.mark.parametrize("pivots, block_rows, spread", [(12, 40, 0.2), (1, 10_000, 1.0), (30, 7, 0.02)])
def test_equals_brute_force(spark, pivots, block_rows, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 16))
    good = {i: (centres[i % 10] + rng.normal(scale=spread, size=16)).astype(np.float32).tolist() for i in range(600)}
    good |= {600 + i: good[i % 3] for i in range(120)}  # many equal vectors: ties go to the smaller id
    bad = {2000: None, 2050: [0.0] * 16, 2100: [1.0] * 15, 2150: [None] + [1.0] * 15, 2200: [float("nan")] * 16}
    df = spark.createDataFrame(list((good | bad).items()), "id long, v array<float>").repartition(4)
    got, pairs = nearest_of(df, F.col("id") % 50 == 0, "id", "v", 5, pivots, block_rows)
    want = brute(good, [i for i in good if i % 50 == 0], 5)
    assert {p: [n for n, _ in rows] for p, rows in found(got).items()} == {p: [n for n, _ in rows] for p, rows in want.items()}
    assert all(abs(a - b) < 2e-6 for p in want for (_, a), (_, b) in zip(found(got)[p], want[p]))
    assert pairs["all"] == len(good) * len(want) and pairs["skipped"] >= (0.7 * pairs["all"] if spread < 0.1 else 0)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "id long, v array<float>")
    got, _ = nearest_of(df, F.col("id") % 50 == 0, "id", "v", 5)
    assert {p: [n for n, _ in rows] for p, rows in found(got).items()} == {0: [7, 50], 50: [7, 0]}
    empty, pairs = nearest_of(df.limit(0), F.lit(True), "id", "v", 5)
    assert empty.count() == 0 and pairs["all"] == 0
