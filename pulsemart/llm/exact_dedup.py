"""Exact dedup with owners kept in Patricia tries.

Every text is reduced to one row per input task by a trie first, so a group of copies that holds
a third of all rows crosses the network once per task. The rows are then dealt by length and
content hash, compressed on the way; each partition inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the owner and the number of rows. A trie above its memory budget writes whole
subtrees to disk and finishes them afterwards.

Defined results: a null text counts as empty and equals ''; texts are compared byte by byte with
no change; a null id never owns a group unless all ids of the group are null; repeated rows count
as rows, and each of them carries the owner; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

TRIE_BYTES = 128 << 20  # memory a trie may take before subtrees go to disk
NODE_BYTES = 480  # of a node beside its edge: the object, its dictionary, a value
OUT_ROWS, OUT_BYTES = 4096, 8 << 20  # of one Arrow batch handed back to Spark


class Node:
    __slots__ = ("edge", "children", "value", "file")

    def __init__(self, edge: bytes, children: dict[int, Node], value: tuple | None = None):
        self.edge, self.children, self.value, self.file = edge, children, value, None


class Trie:
    """A compressed radix trie over byte strings; ``merge`` joins the values of equal strings."""

    def __init__(self, merge, budget: int = TRIE_BYTES):
        self.root, self.merge, self.budget, self.size = Node(b"", {}), merge, budget, 0

    def insert(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while node.file is None and at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], {}, value)
                self.size += len(key) - at + NODE_BYTES
                if self.size > self.budget:
                    self._spill()
                return
            if not key.startswith(child.edge, at):
                common_bytes = _shared(child.edge, key, at)
                upper = Node(child.edge[:common_bytes], {child.edge[common_bytes]: child})
                child.edge = child.edge[common_bytes:]
                node.children[key[at]] = child = upper
                self.size += NODE_BYTES
            node, at = child, at + len(child.edge)
        if node.file is not None:
            pickle.dump((key[at:], value), node.file)
        else:
            node.value = value if node.value is None else self.merge(node.value, value)

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Every distinct string with its value; subtrees on disk are built and emptied one by one."""
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            prefix += node.edge
            if node.file is not None:
                yield from ((prefix + key, value) for key, value in self._reload(node))
                continue
            if node.value is not None:
                yield prefix, node.value
            stack.extend((child, prefix) for child in node.children.values())

    def _reload(self, node: Node) -> Iterator[tuple[bytes, tuple]]:
        part = Trie(self.merge, self.budget)
        with node.file as file:
            file.seek(0)
            while True:
                try:
                    part.insert(*pickle.load(file))
                except EOFError:
                    break
        yield from part.items()

    def _spill(self) -> None:
        """Moves the largest subtree below the first branching to a file; later strings follow it there."""
        node = self.root
        while len(node.children) == 1 and node.value is None:
            node = next(iter(node.children.values()))
        live = [child for child in node.children.values() if child.file is None]
        if len(node.children) < 2 or not live:
            self.budget *= 2  # one string alone is longer than the budget
            return
        sizes = [(_bytes(child), i) for i, child in enumerate(live)]
        largest, i = max(sizes)
        child = live[i]
        part, file = Trie(self.merge), tempfile.TemporaryFile()
        part.root = Node(b"", child.children, child.value)
        for item in part.items():
            pickle.dump(item, file)
        child.children, child.value, child.file = {}, None, file
        self.size -= largest - NODE_BYTES - len(child.edge)


def _shared(edge: bytes, key: bytes, at: int) -> int:
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if edge[low:middle] == key[at + low:at + middle] else (low, middle - 1)
    return low


def _bytes(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        top = stack.pop()
        total += len(top.edge) + NODE_BYTES
        stack.extend(top.children.values())
    return total


def _best(largest: bool):
    def merge(a: tuple, b: tuple) -> tuple:
        ids = [x for x in (a[0], b[0]) if x is not None]
        return (max(ids) if largest else min(ids)) if ids else None, a[1] + b[1], a[2]

    return merge


_LOCAL = pa.schema([("body", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])
_OWNERS = pa.schema([("sha", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _tried(parts: Iterator[dict[str, list]], merge, budget: int) -> Trie:
    trie = Trie(merge, budget)
    for part in parts:
        for body, owner, n, sha in zip(part["body"], part["owner"], part["n"], part["sha"]):
            trie.insert(body, (owner, n, sha))
    return trie


def _combine(merge, budget: int):
    def run(parts):
        out, held = {name: [] for name in _LOCAL.names}, 0
        for key, (best, count, tag) in _tried(parts, merge, budget).items():
            out["body"].append(zlib.compress(key, 1)), out["n_bytes"].append(len(key))
            out["owner"].append(best), out["n"].append(count), out["sha"].append(tag)
            held += len(out["body"][-1])
            if len(out["body"]) >= OUT_ROWS or held >= OUT_BYTES:
                yield out
                out, held = {name: [] for name in _LOCAL.names}, 0
        yield out

    return run


def _own(merge, budget: int):
    def run(parts):
        whole = ({**part, "body": map(zlib.decompress, part["body"])} for part in parts)
        items = ((len(key), value) for key, value in _tried(whole, merge, budget).items())
        for some in iter(lambda: [x for _, x in zip(range(OUT_ROWS), items)], []):
            yield {
                "sha": [v[2] for _, v in some], "n_bytes": [k for k, _ in some],
                "keep_id": [v[0] for _, v in some], "group_size": [v[1] for _, v in some],
            }

    return run


def exact_groups(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text).

    ``keep``: the id that owns a group, ``largest`` or ``smallest``.
    """
    merge = _best(keep == "largest")
    texts = common.keyed(docs)
    rows = texts.select(
        F.encode("text", "UTF-8").alias("body"), F.col("digest").alias("sha"),
        F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("n"),
    )
    local = common.map_arrow(rows, common.batches(_combine(merge, trie_bytes), _LOCAL), _LOCAL)
    dealt = local.repartition("n_bytes", "sha")
    owners = common.map_arrow(dealt, common.batches(_own(merge, trie_bytes), _OWNERS), _OWNERS)
    ids = texts.select("doc_id", F.col("digest").alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return ids.join(owners, ["sha", "n_bytes"]).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs``, all columns, that own their group; a repeated owner row is kept once."""
    owners = exact_groups(docs, keep).where("kept").groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.count("*").alias("n"))
    return common.rows_of(docs, owners)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
