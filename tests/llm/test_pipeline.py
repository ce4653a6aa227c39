import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as c
from pulsemart.llm import common, mixing, packing, quality
from tests.llm.test_simhash import brute_components, brute_print


def chained(spark, docs, sf_dir, tmp_path):
    """The result of each stage on what its predecessor kept."""
    out = []
    for name, stage in c.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    return out


def test_near_dedup_broadcasts_no_replicas(spark, odd, monkeypatch):
    plans, components = [], common.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    monkeypatch.setattr(common, "components", seen)
    c.near_dedup_stage(spark, odd, "")
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_each_stage_equals_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good, single, apart, mixed, packed = chained(spark, docs, sf_dir, tmp_path)
    assert all(d.schema == docs.schema for d in (good, single, apart, mixed))

    marks = {r.doc_id: r for r in labels.collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in good.collect()}
    scorer = quality.fit(docs, labels, F.lit(True))
    ids = sorted(rows)
    assert kept == {i for i, s in zip(ids, scorer.score([rows[i].text for i in ids])) if s >= 0.5}
    wrong = sum((i in kept) != (marks[i].quality == 1) for i in marks)
    assert wrong / len(marks) < 0.03

    owner = {}
    for i in sorted(kept):
        owner[rows[i].text] = i  # the largest id
    assert {r.doc_id for r in single.collect()} == set(owner.values())

    left = sorted(owner.values())
    top = brute_components([brute_print(rows[i].text, c.SHINGLE_WORDS) for i in left], c.MAX_BITS)
    stands = sorted(r.doc_id for r in apart.collect())
    assert stands == [left[k] for k in sorted(set(top))]

    stays = [r.doc_id for r in mixed.collect()]
    assert len(stays) == len(set(stays))
    clean = [i for i in stands if i in marks and marks[i].toxic == 0]
    toxic = [i for i in stands if i in marks and marks[i].toxic == 1]
    assert np.mean([i in set(stays) for i in clean]) > 0.99 and np.mean([i in set(stays) for i in toxic]) < 0.4
    model = mixing.fit(apart, labels)
    p, tokens = model.posteriors([rows[i].text for i in stays]), np.array([len((rows[i].text or "").split()) for i in stays])
    shares = tokens @ p / tokens.sum()
    assert abs(shares[0] - c.TARGETS["clean"]) < 0.02

    pieces = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in pieces} == set(stays) and all(r.n == r.m for r in pieces)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.WINDOW).count() == 0


def test_odd_and_empty_documents(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        *kept, packed = chained(spark, docs, "/root/testdata/sf0.001", tmp_path / name)
        assert all(d.columns == docs.columns for d in kept)
        assert (packed.count() == 0) == (kept[-1].count() == 0)


def test_run(spark):
    assert c.run(spark, "/root/testdata/sf0.001").count() > 0


def test_mixing_keeps_every_clean_document(spark, tmp_path):
    """Words of both kinds in every text make the posteriors soft; what leads as clean stays all the same."""
    rng, words = np.random.default_rng(4), np.array([f"w{i}" for i in range(10)])
    odds = np.r_[np.full(5, 1.6), np.ones(5)]
    toxic = np.arange(900) % 9 == 0
    texts = [" ".join(rng.choice(words, 6, p=(o := odds[::-1] if t else odds) / o.sum())) for t in toxic]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    p = mixing.fit(docs, labels).posteriors(texts)
    leads = set(np.flatnonzero(p.argmax(1) == 0).tolist())
    assert p[sorted(leads), 0].mean() < 0.97
    stays = [r.doc_id for r in c.mixing_stage(spark, docs, str(tmp_path)).collect()]
    assert leads <= set(stays) and len(stays) == len(set(stays)) < 900
