"""Soft-membership mixing: document rates that bring expected domain totals to target weights.

The domains come from the table of labels: ``low`` (quality 0), ``toxic`` (toxic 1) and ``clean``.
A softmax classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, chosen by id hash and taken
whole: over the ``WORDS`` words whose share of documents there differs most between the domains, and
measures of the text. It gives every document a posterior for each domain. Rates
r >= 0 minimise the squared residuals of the domains,

    1/2 sum_k ((sum_d r_d t_d p_dk - w_k T) / (t s_k))^2

with t_d the words of a document, t those of all, p_dk the posteriors, w_k T the targets and s_k the
share that domain k shall have. The rates start at 1 and take projected gradient steps
r_d <- max(0, r_d - p_d g), or max(1, ...) where a domain is kept whole and leads. The vector g of K
numbers is the residual under a preconditioner over domains (three kinds: from the rows whose rate is
free, from all rows, and its diagonal) times a step length; one pass over the whole table returns the
totals of all of them and the nearest is taken, until the residuals stand below ``TOLERANCE`` of the
smallest share or no step comes nearer. As a rate depends on the posterior and the steps alone, passes
exchange a few sums and no rate is stored. Steps lie in the span of the posteriors, so rates move no
further from 1 than the targets ask. T is set so that the domain with the largest weight is neither
thinned nor repeated.

A rate becomes whole copies: its integer part, and one more where the hash of the id falls below the
fraction, so expected totals are kept.

Defined results: a null or empty text has no words, its posteriors come from the empty text and its
rate from the same steps; labels with a null mark, or for missing documents, are ignored; with no
label or one domain only every posterior is that of the prior (uniform without labels); targets for
domains never seen are ignored and the rest are scaled to one; repeated rows each get a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsemart.llm import common
from pulsemart.llm.quality import measures

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
SAMPLE_ROWS, WORDS, LEAST_USES = 12_000, 400, 5
FIT_STEPS, FIT_RIDGE = 300, 1e-4
RIDGE, TOLERANCE, HALVINGS, PROGRESS = 1e-3, 1e-6, 8, 1e-3

_EDGES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_USES = pa.schema([("domain", pa.int32()), ("word", pa.string())])
_SAMPLED = pa.schema([("domain", pa.int32()), ("features", pa.binary())])
_POSTERIOR = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64()), *((f"p_{d}", pa.float64()) for d in DOMAINS)])
_SUMS = pa.schema([("step", pa.int32()), ("nth", pa.int32()), ("value", pa.float64())])
_RATED = _POSTERIOR.append(pa.field("rate", pa.float64()))


def domain_of(quality, toxic):
    """Index into DOMAINS; null where a mark is missing."""
    return (
        F.when(quality == 0, DOMAINS.index("low")).when(toxic == 1, DOMAINS.index("toxic"))
        .when((quality == 1) & (toxic == 0), DOMAINS.index("clean"))
    )


def bag(text: str | None) -> set[bytes]:
    return set((text or "").encode().lower().translate(_EDGES).split())


def _uses(parts):
    for part in parts:
        for domain, text in zip(part["domain"], part["text"]):
            words = [w.decode() for w in bag(text)]
            for some in common.chunked(words, 50_000):
                yield {"domain": [domain] * len(some), "word": some}


def speaking_words(texts: DataFrame, sizes: list[int]) -> list[str]:
    """The words of ``texts`` (domain, text) whose share differs most between a domain and the others."""
    total = sum(sizes)
    uses = common.map_arrow(texts.select("domain", "text"), common.batches(_uses, _USES), _USES)
    counts = uses.groupBy("word").agg(*(F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))))
    n = sum((F.col(f"n{k}") for k in range(len(DOMAINS))), F.lit(0))
    gains = []
    for k, size in enumerate(sizes):
        if 0 < size < total:
            inside, outside = (F.col(f"n{k}") + 0.5) / (size + 1.0), (n - F.col(f"n{k}") + 0.5) / (total - size + 1.0)
            gains.append(F.col(f"n{k}") * F.log(inside / outside))
    gain = F.greatest(*gains) if len(gains) > 1 else gains[0]
    best = counts.where(n >= LEAST_USES).withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(WORDS)
    return [row["word"] for row in best.collect()]


class Classifier:
    """Softmax over the presence of chosen words and standardised measures of the text."""

    def __init__(self, words: list[str]):
        self.at = {w.encode(): i for i, w in enumerate(words)}
        self.w, self.prior = None, np.full(len(DOMAINS), 1 / len(DOMAINS))

    def features(self, text: str | None) -> np.ndarray:
        present = np.zeros(len(self.at))
        for word in bag(text) & self.at.keys():
            present[self.at[word]] = 1
        return np.r_[present, measures(text)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Classifier:
        counts = np.bincount(y, minlength=len(DOMAINS))
        if len(y):
            self.prior = counts / len(y)
        if (counts > 0).sum() < 2:
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 0.05)
        z, hot = self._ready(x), np.eye(len(DOMAINS))[y]
        rate = 4 / (np.linalg.norm(z, 2) ** 2 / len(z) + FIT_RIDGE) / 2
        w = ahead = np.zeros((z.shape[1], len(DOMAINS)))
        for step in range(FIT_STEPS):
            new = ahead - rate * (z.T @ (_softmax(z @ ahead) - hot) / len(z) + FIT_RIDGE * ahead)
            ahead, w = new + step / (step + 3) * (new - w), new
        self.w, self.seen = w, counts > 0
        return self

    def _ready(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1))])

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        if self.w is None or not texts:
            return np.tile(self.prior, (len(texts), 1))
        margins = self._ready(np.array([self.features(t) for t in texts])) @ self.w
        return _softmax(np.where(self.seen, margins, -np.inf))


def _softmax(margins: np.ndarray) -> np.ndarray:
    shares = np.exp(margins - margins.max(1, keepdims=True))
    return shares / shares.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fits the domain classifier on a bounded sample of the labelled rows of ``docs``, taken whole."""
    marked = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).cast("int").alias("domain")
    ).where("domain is not null AND doc_id is not null").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    present = marked.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = common.stored(present.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample_rows), "chosen")
    known = common.stored(rows.join(F.broadcast(chosen), "doc_id").select("domain", "text"), "labelled")  # ``sample_rows`` ids
    counted = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sizes = [counted.get(k, 0) for k in range(len(DOMAINS))]
    words = speaking_words(known, sizes) if sum(s > 0 for s in sizes) > 1 else []
    empty = Classifier(words)

    def sampled(part: dict[str, list]) -> dict[str, list]:
        return {"domain": part["domain"], "features": [empty.features(t).astype(np.float32).tobytes() for t in part["text"]]}

    found = common.map_arrow(known, common.per_batch(sampled, _SAMPLED), _SAMPLED).toArrow().to_pydict()
    order = sorted(range(len(found["domain"])), key=lambda i: (found["features"][i], found["domain"][i]))
    x = np.frombuffer(b"".join(found["features"][i] for i in order), np.float32).reshape(-1, len(empty.features(None))).astype(float)
    return empty.fit(x, np.array([found["domain"][i] for i in order], np.int64))


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens and a posterior per domain for every row."""

    def run(part: dict[str, list]) -> dict[str, list]:
        p = model.posteriors(part["text"])
        return {
            "doc_id": part["doc_id"], "tokens": [len((t or "").split()) for t in part["text"]],
            **{f"p_{d}": p[:, k] for k, d in enumerate(DOMAINS)},
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_arrow(rows, common.per_batch(run, _POSTERIOR), _POSTERIOR)


def _domains(part: Mapping[str, list]) -> np.ndarray:
    return np.array([part[f"p_{d}"] for d in DOMAINS], np.float64).reshape(len(DOMAINS), -1).T


def least_rates(p: np.ndarray, whole: Collection[str]) -> np.ndarray:
    """1 for documents whose leading domain is in ``whole``, 0 for the others."""
    return np.isin(p.argmax(1), [DOMAINS.index(d) for d in whole]).astype(float)


def rates_after(p: np.ndarray, steps: np.ndarray, whole: Collection[str] = ()) -> np.ndarray:
    """The rates of documents with posteriors p after the projected steps (one row of domain gradients each)."""
    least = least_rates(p, whole)
    rates = np.ones(len(p))
    for step in steps:
        rates = np.maximum(least, rates - p @ step)
    return rates


def _totals(steps: np.ndarray, trials: np.ndarray, whole: Collection[str]):
    """Per trial of a next step: the domains' words at its rates, and their products over rows whose rate is free."""

    def run(parts):
        k = len(DOMAINS)
        sums = np.zeros((len(trials), k + k * k))
        for part in parts:
            p, tokens = _domains(part), np.array(part["tokens"], np.float64)[:, None]
            least = least_rates(p, whole)[:, None]
            rates = np.maximum(least, rates_after(p, steps, whole)[:, None] - p @ trials.T)
            squares = (p[:, :, None] * p[:, None, :]).reshape(len(p), -1)
            sums[:, :k] += (tokens * rates).T @ p
            sums[:, k:] += (tokens * (rates > least)).T @ squares
        step, nth = np.indices(sums.shape)
        yield {"step": step.ravel(), "nth": nth.ravel(), "value": sums.ravel()}

    return run


def fit_rates(scored: DataFrame, targets: Mapping[str, float], whole: Collection[str] = ()) -> np.ndarray:
    """The projected-gradient steps, a row of K numbers each; ``rates_after`` turns them into the rate of any document."""
    k = len(DOMAINS)

    def totals(steps, trials):
        sums = common.map_arrow(scored.drop("doc_id"), common.batches(_totals(steps, trials, whole), _SUMS), _SUMS)
        out = np.zeros((len(trials), k + k * k))
        for row in sums.groupBy("step", "nth").agg(F.sum("value").alias("value")).collect():  # a few sums per trial
            out[row["step"], row["nth"]] = row["value"]
        return out

    steps = np.zeros((0, k))
    plain = totals(steps, np.zeros((1, k)))[0]
    weights = np.array([max(0.0, targets.get(d, 0.0)) if plain[i] > 0 else 0.0 for i, d in enumerate(DOMAINS)])
    if not weights.sum():
        return steps
    weights = weights / weights.sum()
    main = int(weights.argmax())
    tokens = plain[:k].sum()
    wanted = weights * plain[main] / weights[main] / tokens
    shares = np.r_[plain[:k] / tokens, wanted]
    least = shares[shares > 0].min()
    scale = np.maximum(wanted, least)  # a residual counts against the share its domain shall have
    spread = plain[k:].reshape(k, k) / tokens

    def risk(state):
        return 0.5 * (((state[:k] / tokens - wanted) / scale) ** 2).sum()

    state = plain
    while True:
        residual = state[:k] / tokens - wanted
        if np.abs(residual).max() <= TOLERANCE * least:
            return steps
        free, small = state[k:].reshape(k, k) / tokens, RIDGE * least * np.eye(k)
        ways = [np.linalg.solve(free + small, residual), np.linalg.solve(spread + small, residual), residual / (np.diag(spread) + RIDGE * least)]
        trials = np.array([way / 2**i for way in ways for i in range(HALVINGS)])
        found = totals(steps, trials)
        risks = [risk(one) for one in found]
        lowest = int(np.argmin(risks))
        if not risks[lowest] < risk(state) * (1 - PROGRESS):
            return steps  # no step brings the totals nearer
        steps, state = np.vstack([steps, trials[lowest]]), found[lowest]


def document_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """doc_id, tokens, posteriors, rate, copies for every row of ``docs``."""
    scored = common.stored(posteriors(docs, fit(docs, labels)), "posteriors")
    steps = fit_rates(scored, targets)

    def rated(part: dict[str, list]) -> dict[str, list]:
        return {**part, "rate": rates_after(_domains(part), steps)}

    with_rates = common.map_arrow(scored, common.per_batch(rated, _RATED), _RATED)
    return with_rates.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def copies(rate, doc_id):
    """Whole copies: the integer part, and one more where the hash of the id falls below the fraction."""
    uniform = F.pmod(F.xxhash64(doc_id, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + uniform)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], repeat: bool = True, whole: Collection[str] = ()) -> DataFrame:
    """The rows of ``docs``, all columns, as often as their copies say; ``repeat=False``: once at most.

    Documents whose leading domain is in ``whole`` have a rate of 1 at least, so all of them stay.
    """
    model = fit(docs, labels)
    steps = fit_rates(common.stored(posteriors(docs, model), "posteriors"), targets, whole)
    rate_type = pa.float64()

    def run(parts):
        for part in parts:
            rates = rates_after(model.posteriors(part.column("text").to_pylist()), steps, whole)
            yield part.append_column("_rate_", pa.array(rates, type=rate_type))

    from pyspark.sql.types import DoubleType, StructType

    common.importable(docs.sparkSession)
    rated = docs.mapInArrow(run, StructType([*docs.schema.fields]).add("_rate_", DoubleType()))
    times = copies(F.col("_rate_"), F.col("doc_id"))
    if not repeat:
        return rated.where(times >= 1).select(*docs.columns)
    return rated.where(times >= 1).withColumn("_copy_", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


SQL: dict[str, str] = {}
QUERIES = {"op6_mixing": op6_mixing}
