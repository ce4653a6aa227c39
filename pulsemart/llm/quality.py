"""Quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; the unlabelled text is a sample of all learnable rows, whose
labels are not looked at. With the class prior p, the risk of a scorer g under the loss l is
p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]); where the second part turns negative, the step goes
against it. The prior is estimated from the positives and the unlabelled rows alone (``class_prior``), so
labels 0 are never read and it does not matter how rows were picked for labelling. The scorer is logistic over measures of the whole text: shares of character kinds, how
words and lines repeat, word lengths. It is fitted on at most ``SAMPLE_ROWS`` positives and as many
unlabelled rows, chosen by id hash; every text is then scored whole.

Defined results: a null text is an empty one and is scored like it; labels that are null count as
absent; with no positive the score is 0.5; a null id is in the fold of the empty string; repeated
rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common

SAMPLE_ROWS = 20_000  # positives, and unlabelled rows, the scorer is fitted on, at most
STEPS, RATE, RIDGE, SLACK = 800, 0.05, 1e-4, 0.0
PRIOR_BOUNDS, DOUBT = (0.02, 0.98), 0.1  # of the estimated prior; the chance that its bound fails

_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])
_SAMPLED = pa.schema([("kind", pa.int32()), ("measures", pa.binary())])

_KINDS = np.zeros((256, 9), np.float64)
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c] = [
        65 <= _c <= 90, 97 <= _c <= 122, 48 <= _c <= 57, _c == 32, _c == 10,
        _ch in ".,;:'\"()-?", _ch in "!", _ch in "|<>{}[]_=~^\\/+", _ch in "#$%&*@",
    ]


def measures(text: str | None) -> np.ndarray:
    """What the scorer sees of a whole text."""
    raw = (text or "").encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    kinds = counts @ _KINDS / n
    words, lines = raw.split(), [line for line in raw.split(b"\n") if line.strip()]
    n_words, n_lines = max(len(words), 1), max(len(lines), 1)
    same = sum(map(bytes.__eq__, words, words[1:])) / n_words
    letters = max(kinds[0] + kinds[1], 1e-9)
    return np.array([
        *np.log(kinds + 1e-3),
        np.log(kinds[0] / letters + 1e-2),
        np.log(same + 1e-3),
        np.log(len(set(words)) / n_words + 1e-3),
        np.log(1 - len(set(lines)) / n_lines + 1e-2),
        np.log(len(raw) / n_words + 1),
        np.log1p(len(words)),
        np.log1p(n_words / n_lines),
        float(not words),
    ])


class Scorer:
    """Logistic over standardised measures."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, parting: bool = False):
        """``parting``: plain logistic risk of positives against unlabelled rows, for the estimate of the prior."""
        self.w = None
        if not len(positive) or not len(unlabelled):
            return
        both = np.vstack([positive, unlabelled])
        self.mean, self.scale = both.mean(0), both.std(0) + 1e-6
        p, u = self._ready(positive), self._ready(unlabelled)
        w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
        for step in range(1, STEPS + 1):
            gp, gu = p @ w, u @ w
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            of_negative = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
            if parting:
                slope = -0.5 * (p.T @ _sigmoid(-gp)) / len(p) + 0.5 * (u.T @ _sigmoid(gu)) / len(u)
            elif negative >= -SLACK:
                slope = -prior * (p.T @ _sigmoid(-gp)) / len(p) + of_negative
            else:
                slope = -of_negative
            slope = slope + RIDGE * w
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def _ready(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))])

    def rate(self, rows: np.ndarray) -> np.ndarray:
        """Scores of rows of measures."""
        return _sigmoid(self._ready(rows) @ self.w)

    def score(self, texts: list[str | None]) -> list[float]:
        if self.w is None or not texts:
            return [0.5] * len(texts)
        return self.rate(np.array([measures(t) for t in texts])).tolist()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, from the two samples alone.

    A logistic score parts positives from unlabelled rows on one half; on the other half the share of
    unlabelled rows above a threshold, divided by that of the positives, bounds the prior from above, and
    is nearest to it where no negative scores as high. The threshold is the one with the least upper
    confidence bound of this ratio. Both halves take turns. No negative label is read.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    found = []
    for turn in (0, 1):
        scorer = Scorer(positive[turn::2], unlabelled[turn::2], 0.5, parting=True)
        p, u = np.sort(scorer.rate(positive[1 - turn::2])), np.sort(scorer.rate(unlabelled[1 - turn::2]))
        above_p = 1 - np.arange(len(p)) / len(p)
        above_u = 1 - np.searchsorted(u, p) / len(u)
        doubt = np.sqrt(np.log(4 / DOUBT) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        best = int(np.argmin((above_u + doubt) / above_p))
        found.append(above_u[best] / above_p[best])
    return float(np.clip(np.mean(found), *PRIOR_BOUNDS))


def _sampled(part: dict[str, list]) -> dict[str, list]:
    return {"kind": part["kind"], "measures": [measures(t).tobytes() for t in part["text"]]}


def fit(docs: DataFrame, labels: DataFrame, learnable, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """``learnable``: a condition on doc_id; rows outside it are not learned from."""
    known = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(learnable)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(learnable)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    trusted = known.join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct()
    ids = [
        trusted.orderBy(*by_hash).limit(sample_rows).withColumn("kind", F.lit(1)),
        rows.select("doc_id").distinct().orderBy(*by_hash).limit(sample_rows).withColumn("kind", F.lit(0)),
    ]
    chosen = common.stored(ids[0].unionByName(ids[1]), "sample")
    texts = rows.join(F.broadcast(chosen), "doc_id").select("kind", "text")
    measured = common.map_arrow(texts, common.per_batch(_sampled, _SAMPLED), _SAMPLED)
    found = measured.limit(4 * sample_rows).toArrow().to_pydict()  # one id may have many rows
    width = len(measures(""))
    of = {k: sorted(m for kind, m in zip(found["kind"], found["measures"]) if kind == k) for k in (0, 1)}
    as_rows = {k: np.frombuffer(b"".join(v), np.float64).reshape(-1, width) for k, v in of.items()}
    return Scorer(as_rows[1], as_rows[0], class_prior(as_rows[1], as_rows[0]))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; the held-out fold is never learned from."""
    held_out = common.crc_fold(F.col("doc_id"), folds) == held_out_fold
    scorer = fit(docs, labels, ~held_out)

    def run(part: dict[str, list]) -> dict[str, list]:
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": scorer.score(part["text"])}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    scored = common.map_arrow(rows, common.per_batch(run, _SCORED), _SCORED)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the scorer accepts; here every labelled row is learned from."""
    scorer = fit(docs, labels, F.lit(True))

    def run(parts):
        for part in parts:
            good = [score >= 0.5 for score in scorer.score(part.column("text").to_pylist())]
            yield part.filter(pa.array(good, pa.bool_()))

    common.importable(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op3_quality": op3_quality}
