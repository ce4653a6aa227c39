"""Hashed text vectors and nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions.text import term_hash, words
from pulsemart.operators.latest import latest_by

DIMENSIONS = 768
MAX_PROBES = 1000  # of a block; more are searched in several


def text_vectors(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, embedding): words and word pairs hashed into buckets, scaled to unit length.

    The texts are dealt by key once; counting terms and gathering cells then needs no further
    exchange, so texts travel and not their many terms.
    """
    hashes = df.select(key, text).repartition(key).select(key, F.transform(words(F.col(text)), term_hash).alias("w"))
    shorter = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), shorter), F.slice("w", F.lit(2), shorter), lambda a, b: a * 31 + b)
    counted = (
        hashes.select(key, F.explode(F.concat("w", pairs)).alias("term"))
        .groupBy(key, (F.col("term") % dimensions).cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    cells = counted.groupBy(key).agg(
        F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("length"),
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("cells"),
    )
    return cells.select(key, _dense(F.col("cells"), F.col("length"), dimensions).alias("embedding"))


def _dense(cells: Column, length: Column, dimensions: int) -> Column:
    """Fixed-length float array from sorted (bucket, n) cells; the gaps become zeros."""
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
    filled = F.transform(
        cells,
        lambda c, i: F.concat(
            zeros(c["bucket"] - F.coalesce(F.get(cells, i - 1)["bucket"], F.lit(-1)) - 1),
            F.array((c["n"] / length).cast("float")),
        ),
    )
    rest = F.lit(dimensions - 1) - F.element_at(cells, -1)["bucket"]
    return F.concat(F.flatten(filled), zeros(rest))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit(vector: Column) -> Column:
    """The vector scaled to length one; null for the zero vector."""
    length = F.nullif(F.sqrt(dot(vector, vector)), F.lit(0.0))
    return F.transform(vector, lambda x: x.cast("double") / length)


def nearest(corpus: DataFrame, probe_ids: list[int], key: str, vector: str, k: int) -> DataFrame:
    """The ``k`` most similar corpus rows for each listed row, the row itself left out.

    The probes go in blocks of ``MAX_PROBES``, which bounds what travels: the vectors of a block
    reach the corpus as one scalar array, the corpus is read once per block and not exchanged,
    and the cut to ``k`` rows per probe starts on the map side.
    """
    corpus = corpus.select(key, unit(F.col(vector)).alias(vector))
    ids = list(dict.fromkeys(probe_ids))
    blocks = [ids[at:at + MAX_PROBES] for at in range(0, max(1, len(ids)), MAX_PROBES)]
    return reduce(DataFrame.unionByName, [_nearest_block(corpus, block, key, vector, k) for block in blocks])


def _nearest_block(corpus: DataFrame, probe_ids: list[int], key: str, vector: str, k: int) -> DataFrame:
    asked = corpus.filter(F.col(key).isin(probe_ids)).agg(
        F.collect_list(F.struct(F.col(key).alias("probe_id"), F.col(vector).alias("probe")))
    )
    scored = (
        corpus.select(key, vector, F.inline(asked.scalar()))
        .filter(F.col(key) != F.col("probe_id"))
        .select("probe_id", F.col(key).alias("neighbour_id"),
                F.round(dot(F.col(vector), F.col("probe")), 6).alias("similarity"))
    )
    return latest_by(scored, "probe_id", [F.desc("similarity"), F.asc("neighbour_id")], k)
