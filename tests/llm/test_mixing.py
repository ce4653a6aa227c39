import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemart.llm import mixing as m

LABELS = "doc_id long, quality int, toxic int, text string, rate double"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_totals_reach_the_targets(tables):
    rated = m.document_rates(*tables).collect()
    tokens = np.array([r.tokens for r in rated], float)
    p = np.array([[r[f"p_{d}"] for d in m.DOMAINS] for r in rated])
    rate = np.array([r.rate for r in rated])
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    shares = (tokens * rate) @ p / (tokens * rate).sum()
    assert np.abs(shares - [m.TARGETS[d] for d in m.DOMAINS]).max() < 0.005
    assert all(r.copies in (int(np.floor(r.rate)), int(np.floor(r.rate)) + 1) for r in rated)


def test_domains_on_rows_not_learned_from(tables):
    docs, labels = tables
    model = m.fit(docs, labels.where("doc_id % 3 <> 0"))
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    got = model.posteriors([r.text for r in held]).argmax(1)
    true = [m.DOMAINS.index("low" if r.quality == 0 else "toxic" if r.toxic == 1 else "clean") for r in held]
    assert np.mean(got == np.array(true)) > 0.93


def scored_rows(spark, p, tokens):
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p))]
    return spark.createDataFrame(rows, "doc_id long, tokens long, " + ", ".join(f"p_{d} double" for d in m.DOMAINS))


@pytest.mark.parametrize("alpha, targets", [
    (0.5, {"clean": 0.7, "low": 0.2, "toxic": 0.1}), (0.5, m.TARGETS), (2.0, m.TARGETS), (0.1, {"clean": 1.0}), (1.0, {"clean": 1.0, "low": 1.0}),
])
def test_steps_reach_the_least_squares_solution(spark, alpha, targets):
    rng = np.random.default_rng(3)
    p, tokens = rng.dirichlet([alpha] * 3, 200), rng.integers(1, 900, 200)
    rate = m.rates_after(p, m.fit_rates(scored_rows(spark, p, tokens), targets))
    w = np.array([targets.get(d, 0.0) for d in m.DOMAINS])
    w /= w.sum()
    main, plain, total = int(w.argmax()), tokens @ p, tokens.sum()
    wanted = w * plain[main] / w[main] / total
    shares = np.r_[plain / total, wanted]
    scale = np.maximum(wanted, shares[shares > 0].min())

    def risk(r):
        return ((((r * tokens) @ p / total - wanted) / scale) ** 2).sum() / 2

    best = np.ones(200)
    for _ in range(20_000):  # plain projected gradient, much longer
        best = np.maximum(0, best - 0.3 * scale.min() ** 2 * (p @ ((((best * tokens) @ p) / total - wanted) / scale**2)))
    assert (rate >= 0).all() and risk(rate) <= risk(best) * 1.02 + 1e-6


def test_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    rated = m.document_rates(odd, none).collect()
    assert len(rated) == odd.count() and all(abs(r.p_clean - 1 / 3) < 1e-9 for r in rated)
    one = spark.createDataFrame([(5, 1, 0, "t", 0.0), (6, None, 0, "t", 0.0), (77777, 1, 0, "t", 0.0)], LABELS)
    assert {r.p_clean for r in m.document_rates(odd, one).collect()} == {1.0}
    two = one.unionByName(spark.createDataFrame([(i, 0, 0, "t", 0.0) for i in range(0, 40, 2)], LABELS))
    mixed = m.mix(odd, two, {"clean": 1.0, "low": 0.0})
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert m.document_rates(empty, two).collect() == [] and m.mix(empty, two, m.TARGETS).collect() == []


def test_copies_keep_the_expected_number(spark):
    df = spark.range(20_000).select(m.copies(F.lit(1.3), F.col("id")).alias("n"))
    assert abs(df.agg(F.avg("n")).first()[0] - 1.3) < 0.02


@pytest.mark.parametrize("sharp", [1.0, 0.9])
def test_rare_domains_reach_their_targets(spark, sharp):
    """Toxic text of 0.1 % of the words is brought to 5 %."""
    kinds = np.repeat([0, 1, 2], [9490, 500, 10])
    p = np.eye(3)[kinds] * sharp + np.array([[1.0, 0.0, 0.0]]) * (1 - sharp)
    rate = m.rates_after(p, m.fit_rates(scored_rows(spark, p, [100] * len(p)), m.TARGETS))
    shares = rate @ p / rate.sum()
    assert np.abs(shares / [m.TARGETS[d] for d in m.DOMAINS] - 1).max() < 0.01


def test_rates_of_whole_domains_are_the_bounded_minimum(spark):
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([0.5, 0.5, 0.5], 300), rng.integers(1, 900, 300)
    rate = m.rates_after(p, m.fit_rates(scored_rows(spark, p, tokens), m.TARGETS, ["clean"]), ["clean"])
    lead = p.argmax(1) == 0
    assert (rate[lead] >= 1).all() and (rate >= 0).all() and (rate[~lead] < 1).any()
