"""Near duplicates by SimHash, found with anchor points of a covering code.

The 64 bits of a fingerprint hold two blocks of 23 bits and 18 free bits. Each block is covered by
the perfect binary Golay code, so any block lies within 3 bits of exactly one codeword; a pair of
codewords is an anchor. Every fingerprint has one home anchor. It is replicated to each anchor
whose blocks lie within the covering radius plus a share of the threshold, the shares adding up to
the threshold at most. If two fingerprints differ in no more bits than that, one is a replica at
the home of the other, so comparing homes with replicas per anchor finds every link and nothing
has to be capped. Equal fingerprints are one class and are never paired.

Defined results: words are runs of anything but ASCII blanks after lower-casing A-Z; a text with
fewer words than a shingle is one shingle; a text without words, or null, has fingerprint zero and
is linked like any other; rows with a null id take part, but name no component; repeated rows each
get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

BLOCK, RADIUS = 23, 3  # length and covering radius of the Golay code
GENERATOR = 0b101011100011  # its generator polynomial x^11+x^9+x^7+x^6+x^5+x+1
SEED = 42
SLAB = 4096  # fingerprints replicated at a time

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_KEYED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("fp", pa.int64())])
_ANCHORS = pa.schema([("fp", pa.int64()), ("anchor", pa.int64())])


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    return np.fromiter(
        (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())),
        np.uint64, len(starts),
    )


def _majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    return _majority(shingle_hashes(text, shingle))


def _prints(shingle: int):
    def run(part: dict[str, list]) -> dict[str, list]:
        prints = np.array([fingerprint(t, shingle) for t in part["text"]], np.uint64)
        return {"doc_id": part["doc_id"], "fp": prints.view(np.int64)}

    return run


def _keyed_prints(shingle: int):
    make = _prints(shingle)
    return lambda part: {**make(part), "digest": part["digest"]}


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_arrow(rows, common.per_batch(_prints(shingle), _PRINTS), _PRINTS)


def _remainders() -> np.ndarray:
    """The remainder of each single bit of a block divided by the generator."""
    out = []
    for i in range(BLOCK):
        word = 1 << i
        for j in range(BLOCK - 1, 10, -1):
            if word >> j & 1:
                word ^= GENERATOR << (j - 11)
        out.append(word)
    return np.array(out, np.int64)


@functools.cache
def _cosets(extra: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Remainder of every bit, and per weight beyond the radius: patterns sorted by remainder, with offsets."""
    units, levels = _remainders(), []
    for weights in [range(RADIUS + 1), *([RADIUS + k] for k in range(1, extra + 1))]:
        patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BLOCK), w)], np.int64)
        rest = _remainder(patterns, units)
        order = np.argsort(rest, kind="stable")
        levels.append((patterns[order], np.searchsorted(rest[order], np.arange(2049))))
    return units, levels


def _remainder(words: np.ndarray, units: np.ndarray) -> np.ndarray:
    rest = np.zeros_like(words)
    for i in range(BLOCK):
        rest ^= np.where(words >> i & 1, units[i], 0)
    return rest


def _spread(offsets: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the indexes offsets[rest] up to offsets[rest + 1]; which row each belongs to."""
    first, count = offsets[rest], offsets[rest + 1] - offsets[rest]
    row = np.repeat(np.arange(len(rest)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def anchors(prints: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor) for each anchor within the radius plus ``extra``; 0: the home."""
    bits = prints.view(np.uint64)
    left = (bits & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    right = (bits >> np.uint64(BLOCK) & np.uint64((1 << BLOCK) - 1)).astype(np.int64)
    return block_anchors(left, right, extra)


def block_anchors(left: np.ndarray, right: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the two blocks themselves."""
    units, levels = _cosets(extra)
    rest_left, rest_right = _remainder(left, units), _remainder(right, units)
    rows, found = [], []
    for i in range(extra + 1):
        row, at = _spread(levels[i][1], rest_left)
        code_left = left[row] ^ levels[i][0][at]
        for j in range(extra + 1 - i):
            again, at_right = _spread(levels[j][1], rest_right[row])
            rows.append(row[again])
            found.append(code_left[again] << BLOCK | (right[row[again]] ^ levels[j][0][at_right]))
    return np.concatenate(rows), np.concatenate(found)


def _anchored(extra: int):
    def run(parts):
        for part in parts:
            prints = np.array(part["fp"], np.int64)
            for at in range(0, len(prints), SLAB):
                some = prints[at:at + SLAB]
                rows, found = anchors(some, extra)
                yield {"fp": some[rows], "anchor": found}

    return run


def linked_prints(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs (a, b) of different values of ``fp`` that differ in at most ``max_bits`` bits, each once."""
    # A fingerprint grows to some sixty rows, so the few bytes of the values are spread over all tasks.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = prints.select("fp").distinct().repartition(tasks, "fp")
    homes = common.map_arrow(values, common.batches(_anchored(0), _ANCHORS), _ANCHORS)
    copies = common.map_arrow(values, common.batches(_anchored(max_bits), _ANCHORS), _ANCHORS)
    # Spark sizes the replicas by the rows they are made from, so it must not choose to broadcast them.
    h, c = homes.alias("h"), copies.alias("c").hint("merge")
    return h.join(
        c,
        (F.col("h.anchor") == F.col("c.anchor")) & (F.col("h.fp") < F.col("c.fp"))
        & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("c.fp"))) <= max_bits),
    ).select(F.col("h.fp").alias("a"), F.col("c.fp").alias("b"))


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint, component_id for every row; a component is named by its smallest doc_id."""
    prints = common.stored(fingerprints(docs, shingle), "prints")
    classes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    pairs = linked_prints(classes, max_bits)
    groups = common.components(pairs)
    members = classes.join(groups, classes.fp == groups.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    named = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_print = members.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def grouped_prints(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, component of every fingerprint of ``prints``; a component is named by its smallest fingerprint."""
    values = common.stored(prints.select("fp").distinct(), "fps")
    groups = common.components(linked_prints(values, max_bits))
    return values.join(groups, values.fp == groups.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stands for each group of linked fingerprints.

    The smallest doc_id of a group stays (a null id only where the group has no other); of several
    texts with that id the one whose digest is smallest, once.
    """
    keyed = common.keyed(docs)
    both = common.map_arrow(keyed, common.per_batch(_keyed_prints(shingle), _KEYED), _KEYED)
    prints = common.stored(both.groupBy("doc_id", "digest").agg(F.first("fp").alias("fp"), F.count("*").alias("n")), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "digest", "n")
    kept = prints.join(grouped_prints(prints, max_bits), "fp").groupBy("component").agg(F.min(order).alias("one"))
    return common.rows_of(docs, kept.select("one.doc_id", "one.digest", "one.n"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op8_simhash": op8_simhash}
