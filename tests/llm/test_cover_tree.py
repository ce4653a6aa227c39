import math

import numpy as np
import pytest

from pulsemart.llm import cover_tree as c

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, rep string"


def clustered(seed, n, dim=8, spread=0.12, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def brute(rows, limit=c.COSINE):
    def usable(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [r for r in rows if usable(r)]
    x = [np.array(r[1], np.float64) for r in good]
    x = [v / np.linalg.norm(v) for v in x]
    links, parent = [0] * len(good), list(range(len(good)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(good)):
        for j in range(i):
            if good[i][2] == good[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= limit:
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j), key=lambda k: good[k][0])] = min(top(i), top(j), key=lambda k: good[k][0])
    out = {id(r): (r[0], links[i], good[top(i)][0]) for i, r in enumerate(good)}
    return sorted((out.get(id(r), (r[0], 0, r[0])) for r in rows), key=str)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=str)


def odd_rows():
    x = clustered(1, 160)
    rows = [(i, v.tolist(), i % 3, "a", "b") for i, v in enumerate(x)]
    rows += [(200 + i, x[i].tolist(), i % 3, "a", "b") for i in range(20)]  # copies
    rows += [(230 + i, (x[0] * (i + 2)).tolist(), 0, "a", "b") for i in range(3)]  # other lengths of one direction
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [nan] * 8, [inf] + [1.0] * 7, [1.0, None] * 4, [1.0, 2.0], x[1].tolist()]
    rows += [(300 + i, v, 1, "a", "b") for i, v in enumerate(odd)]
    rows += [(400, x[2].tolist(), None, "a", "b"), (None, x[3].tolist(), 0, "a", "b"), (5, x[5].tolist(), 2, "a", "b")]
    return rows


def test_equals_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    result = c.cosine_links(df)
    assert got(result) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in result.collect())


def test_cells_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 12)
    rows = odd_rows()
    assert got(c.cosine_links(spark.createDataFrame(rows, SCHEMA).coalesce(2))) == brute(rows)


def test_empty(spark):
    assert c.cosine_links(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed,spread,limit", [(1, 0.05, 0.93), (2, 0.3, 0.93), (3, 1.5, 0.8), (4, 0.0, 0.99)])
def test_trees_give_all_pairs(seed, spread, limit):
    x = clustered(seed, 300, spread=spread).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= limit
    tree, other = c.CoverTree(x[:170]), c.CoverTree(x[170:])
    i, j = c.threshold_pairs(tree, tree, limit)
    assert len(i) == np.triu(near[:170, :170], 1).sum() and near[i, j].all() and len({tuple(sorted(p)) for p in zip(i, j)}) == len(i)
    i, j = c.threshold_pairs(tree, other, limit)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(near[:170, 170:])))


def test_children_lie_inside_half_the_radius():
    x = clustered(9, 400, spread=0.6).astype(np.float64)
    tree = c.CoverTree(x / np.linalg.norm(x, axis=1)[:, None])
    leaves = [i for n, m in enumerate(tree.members) if not tree.children[n] for i in m]
    assert sorted(leaves) == list(range(400))


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1, "", ""), (1, [0.0, 1.0, 0.0], 1, "", ""), (2, [1.0, 0.01, 0.0], 1, "", ""), (0, [0.0, 1.0, 0.0], 2, "", "")]
    result = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in c.cosine_links(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(result) == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
