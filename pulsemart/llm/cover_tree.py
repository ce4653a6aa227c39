"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

Equal vectors of a label form one class. On unit vectors a cosine of t is a chord of
sqrt(2 - 2 t), a metric. The top of the tree is a Spark job: the largest labels get pivots, every
class goes to its nearest pivot, and a class is sent to another pivot's cell only if the covering
radius of that cell plus the threshold reaches it. A cell of more than ``BLOCK`` classes is split
into blocks by hash and every pair of blocks is a task of its own, so no task ever holds more than
two blocks. Inside a task each block becomes a cover tree, nested levels whose radii halve, and both
trees are walked together; a pair of nodes is dropped when the distance of their centres exceeds the
threshold plus both covering radii. What is left is compared exactly. A task returns, per class, the
number of links and the smallest class it is connected with there, never the pairs themselves.

Defined results: labels must be equal and not null; vectors that are null, empty, zero or hold null
or non-finite components, vectors of another length, and rows with a null id link with nothing;
repeated rows are vectors of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pulsemart.llm import common

COSINE = 0.93
BLOCK = 2048  # classes of a block, about
PIVOT_LABELS, PIVOTS = 64, 64  # labels that get pivots, pivots each, at most: a bound on what the driver holds
LEAF = 24  # points of a node that is not divided further
SLACK = 1e-9

_KEY = ["label", "dim"]
_CELLED = pa.schema([
    ("label", pa.string()), ("dim", pa.int32()), ("rep", pa.int64()), ("mult", pa.int64()), ("unit", pa.binary()),
    ("cell", pa.int32()), ("reach", pa.float64()),
])
_DEALT = pa.schema([
    ("label", pa.string()), ("dim", pa.int32()), ("cell_a", pa.int32()), ("block_a", pa.int32()), ("cell_b", pa.int32()),
    ("block_b", pa.int32()), ("side", pa.int32()), ("rep", pa.int64()), ("mult", pa.int64()), ("unit", pa.binary()),
])
_LINKED = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("hub", pa.int64())])


class CoverTree:
    """Nested levels over unit vectors: the children of a node cover it with balls of half its radius."""

    def __init__(self, points: np.ndarray):
        self.points, self.centre, self.radius, self.children, self.members = points, [], [], [], []
        if len(points):
            order = np.arange(len(points))
            self._node(order, self._chords(0, order), 2.0)
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)

    def _chords(self, centre: int, order: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.points[order] @ self.points[centre])))

    def _node(self, order: np.ndarray, chords: np.ndarray, level: float) -> int:
        """A node centred on order[0]."""
        work, top = [(order, chords, level, -1)], len(self.centre)
        while work:
            order, chords, level, parent = work.pop()
            number = len(self.centre)
            self.centre.append(int(order[0])), self.radius.append(float(chords.max()))
            self.children.append([]), self.members.append(order)
            if parent >= 0:
                self.children[parent].append(number)
            if len(order) <= LEAF or self.radius[-1] < 1e-7:
                continue
            while level / 2 >= self.radius[-1]:
                level /= 2  # empty levels
            half, left, near = level / 2, order, chords
            while len(left):
                inside = near <= half
                inside[0] = True
                work.append((left[inside], near[inside], half, number))
                left = left[~inside]
                if len(left):
                    near = self._chords(left[0], left)
            self.members[number] = None
        return top


def threshold_pairs(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (into a, into b) of all pairs at or above the cosine; with a is b each pair once, and no self pairs."""
    chord, own = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK, a is b
    stack, left, right = [(0, 0)] if len(a.centre) and len(b.centre) else [], [], []

    def compare(rows: np.ndarray, columns: np.ndarray, same: bool) -> None:
        hit = a.points[rows] @ b.points[columns].T >= cosine - SLACK
        i, j = np.nonzero(np.triu(hit, 1) if same else hit)
        check(rows[i], columns[j])

    def check(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 1 << 16):
            some, others = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            good = np.einsum("nd,nd->n", a.points[some], b.points[others]) >= cosine
            left.append(some[good]), right.append(others[good])

    while stack:
        u, v = stack.pop()
        if not a.children[u] and not b.children[v]:
            compare(a.members[u], b.members[v], own and u == v)
            continue
        us, vs = np.array(a.children[u] or [u]), np.array(b.children[v] or [v])
        centres = a.points[a.centre[us]] @ b.points[b.centre[vs]].T
        reach = chord + a.radius[us][:, None] + b.radius[vs][None, :]
        keep = np.sqrt(np.maximum(0, 2 - 2 * centres)) <= reach
        if own and u == v:
            keep = np.triu(keep)
        i, j = np.nonzero(keep)
        single = np.array([not a.children[k] and len(a.members[k]) == 1 for k in us])[i]
        single &= np.array([not b.children[k] and len(b.members[k]) == 1 for k in vs])[j]
        p, q = a.centre[us[i[single]]], b.centre[vs[j[single]]]
        if own:
            p, q = p[p != q], q[p != q]
        check(p, q)
        stack.extend(zip(us[i[~single]].tolist(), vs[j[~single]].tolist()))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _units(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _join_blocks(cosine: float):
    def run(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        order = np.argsort(side, kind="stable")
        units, rep = _units(group["unit"])[order], group["rep"].to_numpy()[order]
        mult = group["mult"].to_numpy()[order]
        first = int((side == 0).sum())
        self_pair = group["cell_a"][0] == group["cell_b"][0] and group["block_a"][0] == group["block_b"][0]
        if self_pair:
            tree = CoverTree(units)
            i, j = threshold_pairs(tree, tree, cosine)
        else:
            i, j = threshold_pairs(CoverTree(units[:first]), CoverTree(units[first:]), cosine)
            j = j + first
        links = np.bincount(i, mult[j], len(rep)) + np.bincount(j, mult[i], len(rep))
        hub = rep.copy()
        while True:  # the smallest class reached inside this task
            low = np.minimum(hub[i], hub[j])
            new = hub.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            if (new == hub).all():
                break
            hub = new
        linked = links > 0
        return pa.table({"rep": rep[linked], "links": links[linked].astype(np.int64), "hub": hub[linked]}, schema=_LINKED)

    return run


def _valid(vector) -> F.Column:
    return (
        F.col(vector).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0)
    )


def _unit(vector: list[float]) -> np.ndarray:
    x = np.array(vector, np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _cells(pivots: dict[tuple, np.ndarray]):
    def run(part: dict[str, list]) -> dict[str, list]:
        cell, reach, unit = [], [], []
        for label, dim, vector in zip(part["label"], part["dim"], part["vector"]):
            x = _unit(vector)
            unit.append(x.tobytes())
            centres = pivots.get((label, dim))
            if centres is None:
                cell.append(0), reach.append(2.0)
            else:
                near = centres @ x
                best = int(near.argmax())
                cell.append(best), reach.append(float(np.sqrt(max(0.0, 2 - 2 * near[best]))))
        return {**{k: part[k] for k in ("label", "dim", "rep", "mult")}, "unit": unit, "cell": cell, "reach": reach}

    return run


def _deal(pivots: dict, cells: dict, cosine: float):
    """Copies of each class for every pair of blocks that may hold a partner."""
    chord = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    fields = [f.name for f in _DEALT]

    def run(parts):
        for part in parts:
            rows = []
            for label, dim, rep, mult, unit, cell, n in zip(*(part[k] for k in ("label", "dim", "rep", "mult", "unit", "cell", "n"))):
                blocks = -(-n // BLOCK)
                block = hash_of(rep, blocks)
                for other in range(blocks):
                    pair = (block, other) if block <= other else (other, block)
                    rows.append((label, dim, cell, pair[0], cell, pair[1], int(block > other), rep, mult, unit))
                known = cells.get((label, dim))
                if known is not None:
                    chords = np.sqrt(np.maximum(0, 2 - 2 * (pivots[label, dim] @ np.frombuffer(unit))))
                    for far, (size, radius) in known.items():
                        if far == cell or chords[far] > chord + radius + SLACK:
                            continue
                        for other in range(-(-size // BLOCK)):
                            if cell < far:
                                rows.append((label, dim, cell, block, far, other, 0, rep, mult, unit))
                            else:
                                rows.append((label, dim, far, other, cell, block, 1, rep, mult, unit))
                if len(rows) > 5000:
                    yield dict(zip(fields, map(list, zip(*rows))))
                    rows = []
            if rows:
                yield dict(zip(fields, map(list, zip(*rows))))

    return run


def hash_of(rep: int, blocks: int) -> int:
    return (rep * 0x9E3779B97F4A7C15 >> 20 & 0xFFFFFFFF) % blocks


def cosine_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    ).withColumn("usable", F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _valid("vector"))
    # A class of equal vectors has a number of its own: rows of different vectors may carry one vec_id.
    classes = rows.where("usable").groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("mult"))
    classes = common.stored(classes.withColumn("dim", F.size("vector")).withColumn("rep", F.monotonically_increasing_id()), "classes")

    large = classes.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).orderBy(F.desc("n"), *_KEY).limit(PIVOT_LABELS).collect()
    sizes = spark.createDataFrame([(r["label"], r["dim"], min(PIVOTS, 2 * -(-r["n"] // BLOCK))) for r in large], "label string, dim int, pivots int")
    nth = F.row_number().over(W.partitionBy(*_KEY).orderBy(F.xxhash64("rep"), "rep"))
    chosen = classes.join(F.broadcast(sizes), _KEY).withColumn("nth", nth).where((F.col("nth") <= PIVOTS) & (F.col("nth") <= F.col("pivots")))
    found = defaultdict(list)
    for row in chosen.orderBy(*_KEY, "nth").select(*_KEY, "vector").collect():
        found[row["label"], row["dim"]].append(_unit(row["vector"]))
    pivots = {key: np.array(value) for key, value in found.items()}

    celled = common.stored(
        common.map_arrow(classes.select("label", "dim", "rep", "mult", "vector"), common.per_batch(_cells(pivots), _CELLED), _CELLED), "cells"
    )
    counted = celled.groupBy(*_KEY, "cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
    cells: dict = defaultdict(dict)
    for row in counted.join(F.broadcast(sizes), _KEY, "left_semi").collect():  # at most PIVOT_LABELS x PIVOTS rows
        cells[row["label"], row["dim"]][row["cell"]] = (row["n"], row["radius"])
    sized = celled.join(counted.select(*_KEY, "cell", "n"), [*_KEY, "cell"])
    dealt = common.map_arrow(sized, common.batches(_deal(pivots, dict(cells), cosine), _DEALT), _DEALT)
    blocks = dealt.groupBy("label", "dim", "cell_a", "block_a", "cell_b", "block_b")
    linked = common.stored(blocks.applyInArrow(_join_blocks(cosine), common.ddl(_LINKED)), "linked")

    groups = common.components(linked.select(F.col("rep").alias("a"), F.col("hub").alias("b")))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    members = common.stored(
        classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vector", "low", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "members",
    )
    named = members.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = members.join(named, "component").select("label", "vector", "n_links", "component_id")
    joined = rows.where("usable").join(by_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_cosine_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(common.table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
QUERIES = {"op1_cosine_links": op1_cosine_links}
