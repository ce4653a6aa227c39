import zlib

import numpy as np

from pulsemart.llm import language, quality
from tests.llm.conftest import DOCS, rows

LABELS = "doc_id long, quality int, toxic int, text string"
DATA = "/root/testdata/sf0.01"


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts_have_defined_languages(odd):
    got = {r.doc_id: r for r in language.identify(odd).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == got[10].lang_pred == "und" and got[0].score == 0
    assert got[5].lang_pred == "en" and got[8].lang_pred == "en" and got[5].score == 1


def test_unknown_codes_are_families(spark):
    texts = ["aaa bab aba " * 5, "zzz yzy xyx " * 5] * 20
    df = spark.createDataFrame([(i, t, ["xx", "yy"][i % 2], *r[3:]) for i, (t, r) in enumerate(zip(texts, rows(texts)))], DOCS)
    assert all(r.lang_pred == ["xx", "yy"][r.doc_id % 2] for r in language.identify(df).collect())


def test_pairs_of_a_family_of_three_vote(spark):
    """One machine for each pair; the votes equal those counted by hand."""
    rng = np.random.default_rng(4)
    roots = {"fr": "eau oui aux", "es": "cion llo que", "it": "zio gli che", "de": "ung sch ein"}
    texts, codes = [], []
    for i in range(200):
        code = list(roots)[i % 4]
        texts.append(" ".join(rng.choice(roots[code].split()) + rng.choice(["a", "e", "i", "na"]) for _ in range(30)))
        codes.append(code)
    df = spark.createDataFrame([(i, t, c, *r[3:]) for i, (t, c, r) in enumerate(zip(texts, codes, rows(texts)))], DOCS)
    model = language.fit(df)
    assert model.members["romance"] == ["es", "fr", "it"] and model.inner["romance"].shape[1] == 3 and "germanic" not in model.inner
    for text, code in zip(texts, codes):
        got, score = model.predict(text)
        assert got == code and 0 < score <= 1
        margins = np.append(language.cells(text), np.float32(1)) @ model.inner["romance"]
        wins = [(m >= 0, pair) for m, pair in zip(margins, [("es", "fr"), ("es", "it"), ("fr", "it")])]
        votes = [pair[0] if first else pair[1] for first, pair in wins]
        if code != "de":
            assert votes.count(code) == 2
    got = language.identify(df).where("held_out").collect()
    assert np.mean([r.lang_pred == codes[r.doc_id] for r in got]) > 0.95


def test_many_languages_and_many_rows_of_one_id_stay_bounded(spark):
    texts = [f"{c}{d} {d}{c} {c}{c}" for c in "abcdefghij" for d in "klmnopqrst"] * 3
    df = spark.createDataFrame([(i % 3, t, f"x{i % 90}", *r[3:]) for i, (t, r) in enumerate(zip(texts, rows(texts)))], DOCS)
    assert len(language.fit(df, sample_rows=20).learned) <= 20


def test_prior_is_read_off_positives_and_unlabelled_rows():
    rng = np.random.default_rng(6)
    for prior in (0.2, 0.5, 0.8):
        def draw(share, n):
            return rng.normal(size=(n, 4)) + 2.2 * (rng.random(n) < share)[:, None]

        found = quality.class_prior(draw(1.0, 3000), draw(prior, 3000))
        assert abs(found - prior) < 0.06, (prior, found)
    assert quality.class_prior(np.zeros((0, 4)), np.zeros((9, 4))) == 0.5


def test_labels_rich_in_positives_do_not_move_the_prior(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    biased = labels.where("quality = 1 or doc_id % 10 = 0")
    a, b = (quality.score_quality(docs, x).orderBy("doc_id").collect() for x in (labels, biased))
    assert a == b


def test_risk_equals_its_definition():
    """The gradient of the scorer is that of the non-negative unbiased risk, by differences."""
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(1, 1, (300, 3)), np.vstack([rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (300, 3))]), 0.4
    w = quality.Scorer(p, u, prior).w

    def risk(w):
        both = np.vstack([p, u])
        ready = lambda r: np.hstack([np.clip((r - both.mean(0)) / (both.std(0) + 1e-6), -6, 6), np.ones((len(r), 1))])
        gp, gu = ready(p) @ w, ready(u) @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return prior * np.logaddexp(0, -gp).mean() + max(negative, -quality.SLACK) + quality.RIDGE / 2 * w @ w

    least = min(risk(w + d) for d in rng.normal(scale=0.3, size=(2000, 4)))
    assert risk(w) <= least + 0.02


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert sum(r.quality == r.predicted for r in held) / len(held) > 0.95
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) quality")
    a, b = (sorted(quality.score_quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_quality_of_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert all(r.score == 0.5 and r.predicted == 1 for r in quality.score_quality(odd, none).collect())
    some = spark.createDataFrame([(i, i % 2 if i % 5 else None, 0, "t") for i in range(60)] * 2, LABELS)
    got = quality.score_quality(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1  # a null text is an empty one
    assert quality.score_quality(empty, some).collect() == [] and language.identify(empty).collect() == []


def test_measures_of_a_long_text_are_finite():
    assert np.isfinite(quality.measures("x" * 300_000)).all() and np.isfinite(quality.measures(None)).all()
