"""Language identification in two levels: the family first, then the language within it.

A text is the counts of its hashed byte trigrams (letters only, lower case, blanks squeezed), scaled
to unit length. One linear support vector machine per family separates it from the other families;
within a family of several languages one machine for each pair of them votes, and the language with most
votes is taken (ties: the larger sum of its shares). The machines are fitted on at most ``SAMPLE_ROWS``
labelled texts, about as many of each language, taken whole and chosen by id hash; every text of the table
is then judged whole.

Defined results: ``und`` with score 0 for a null text or one without a letter, or when nothing was
labelled; a language with no known family is a family of its own; with one language learned, that
language with score 1; a null id is in the fold of the empty string; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

SAMPLE_ROWS = 4000  # labelled texts the machines are fitted on, at most
CELLS = 4096  # hashed trigrams
STEPS, RIDGE, SHARPNESS = 300, 1e-4, 4.0

# Language codes of each family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sk", "sr", "hr", "sl"],
    "uralic": ["fi", "hu", "et"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "cy", "br"],
    "semitic": ["ar", "he"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo_aryan": ["hi", "bn", "ur", "mr", "ne"],
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}

_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_SAMPLED = pa.schema([("lang", pa.string()), ("cells", pa.binary())])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cells(text: str) -> np.ndarray:
    """Unit vector of the hashed trigram counts."""
    line = b" %b " % b" ".join(text.lower().encode().translate(_BLANKED).split())
    codes = np.frombuffer(line, np.uint8).astype(np.uint32)
    hashed = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761) >> np.uint32(20)
    counts = np.bincount(hashed, minlength=CELLS).astype(np.float32)
    return counts / max(float(np.linalg.norm(counts)), 1.0)


def one_versus_rest(x: np.ndarray, y: np.ndarray, classes: list[str]) -> np.ndarray:
    """Weights (cells + 1, classes) of squared-hinge machines, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sign = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0).astype(np.float32)
    weight = np.where(sign > 0, 0.5 / np.maximum((sign > 0).sum(0), 1), 0.5 / np.maximum((sign < 0).sum(0), 1)).astype(np.float32)
    w = np.zeros((x.shape[1], len(classes)), np.float32)
    ahead, rate = w, 0.25
    for step in range(STEPS):
        slack = np.maximum(0, 1 - sign * (x @ ahead))
        new = ahead - rate * (RIDGE * ahead - 2 * x.T @ (weight * sign * slack))
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


def one_versus_one(x: np.ndarray, y: np.ndarray, classes: list[str]) -> np.ndarray:
    """Weights (cells + 1, pairs) of one machine for each pair of classes, in the order of ``combinations``."""
    out = []
    for first, second in combinations(classes, 2):
        rows = (y == first) | (y == second)
        out.append(one_versus_rest(x[rows], y[rows], [first])[:, 0])
    return np.stack(out, axis=1)


class Model:
    """Machines for the families and, per family of several languages, for its languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        y = np.array(languages, dtype=object)
        self.learned = sorted(set(languages))
        family = np.array([FAMILY.get(code, code) for code in languages], dtype=object)
        self.families = sorted(set(family))
        self.top = one_versus_rest(x, family, self.families) if len(self.families) > 1 else None
        self.members = {f: sorted({c for c in self.learned if FAMILY.get(c, c) == f}) for f in self.families}
        self.inner = {f: one_versus_one(x[family == f], y[family == f], codes) for f, codes in self.members.items() if len(codes) > 1}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.learned or not has_letter(text):
            return "und", 0.0
        x = np.append(cells(text), np.float32(1))
        family, sure = _choice(self.families, self.top, x)
        code, surer = _vote(self.members[family], self.inner.get(family), x)
        return code, sure * surer


def _choice(names: list[str], weights: np.ndarray | None, x: np.ndarray) -> tuple[str, float]:
    """The machine with the largest margin, and its share after a softmax of the margins."""
    if weights is None:
        return names[0], 1.0
    margins = (x @ weights).astype(float) * SHARPNESS
    shares = np.exp(margins - margins.max())
    best = int(margins.argmax())
    return names[best], float(shares[best] / shares.sum())


def _vote(names: list[str], weights: np.ndarray | None, x: np.ndarray) -> tuple[str, float]:
    """The class that wins most of its pairs, and the mean of its shares in them."""
    if weights is None:
        return names[0], 1.0
    votes, shares = np.zeros(len(names)), np.zeros(len(names))
    margins = (x @ weights).astype(float) * SHARPNESS
    for (i, j), margin in zip(combinations(range(len(names)), 2), margins.tolist()):
        share = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        votes[i if margin >= 0 else j] += 1
        shares[i] += share
        shares[j] += 1 - share
    best = int(np.lexsort((-shares, -votes))[0])
    return names[best], float(shares[best] / (len(names) - 1))


def _sampled(part: dict[str, list]) -> dict[str, list]:
    keep = [i for i, t in enumerate(part["text"]) if has_letter(t)]
    return {"lang": [part["lang"][i] for i in keep], "cells": [cells(part["text"][i]).tobytes() for i in keep]}


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a bounded sample of the rows of ``docs`` (doc_id, text, lang), about as many of each language.

    The share taken of a language follows from its count; only rows, not ids, are bounded where one id has many.
    """
    marked = docs.where("lang is not null").select("doc_id", "lang")
    counted = common.stored(marked.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    wanted = max(1, sample_rows // max(1, counted.count()))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marked.join(counted, "lang").where(hashed < F.lit(wanted) / F.col("n")).select("doc_id", "lang").distinct()
    chosen = common.stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample_rows), "sample")
    texts = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    found = common.map_arrow(texts.select("lang", "text"), common.per_batch(_sampled, _SAMPLED), _SAMPLED).limit(sample_rows).toArrow().to_pydict()
    order = sorted(range(len(found["lang"])), key=lambda i: (found["lang"][i], found["cells"][i]))
    if not order:
        return Model(np.zeros((0, CELLS), np.float32), [])
    x = np.frombuffer(b"".join(found["cells"][i] for i in order), np.float32).reshape(-1, CELLS)
    return Model(x, [found["lang"][i] for i in order])


def predict(docs: DataFrame, model: Model, held_out) -> DataFrame:
    def run(part: dict[str, list]) -> dict[str, list]:
        found = [model.predict(text) for text in part["text"]]
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return common.map_arrow(rows, common.per_batch(run, _PREDICTED), _PREDICTED)


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; fold 0 of ``folds`` is never learned from."""
    held_out = common.crc_fold(F.col("doc_id"), folds) == 0
    return predict(docs, fit(docs.where(~held_out)), held_out)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_language": op9_language}
