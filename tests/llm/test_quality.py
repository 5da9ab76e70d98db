import math

import numpy as np
from pyspark.sql import functions as F

from churnlens.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good, poor = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > p) + 0.5 * (g == p) for g in good for p in poor])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_negative_and_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.where("quality = 1").where("crc32(cast(doc_id AS string)) % 5 <> 0")
    score = lambda t: {r.doc_id: r.score for r in Q.score_quality(docs, t).collect()}
    assert score(labels) == score(changed)


def test_class_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    mixed = np.concatenate([rng.normal(2, 1, 2400), rng.normal(-2, 1, 1600)])
    at = np.unique(positive)
    above = np.array([(mixed >= a).sum() for a in at])
    assert abs(Q.class_prior(positive, at, above, len(mixed)) - 0.6) < 0.08


def plain_risk(w, xp, xu, prior, l2=Q.L2):
    """The non-negative unbiased risk, written out."""
    loss = lambda z: np.log1p(np.exp(-z))
    return prior * loss(xp @ w).mean() + max(0.0, loss(-(xu @ w)).mean() - prior * loss(-(xp @ w)).mean()) + l2 * (w @ w) / 2


def test_fit_minimises_the_non_negative_risk():
    """No step in any single weight, and no random step, lowers the written-out risk by more than a trace."""
    rng = np.random.default_rng(3)
    positive, unlabelled = rng.normal(1, 1, (600, 3)), np.vstack([rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (600, 3))])
    cuts = tuple(np.quantile(unlabelled[:, i], [0.25, 0.5, 0.75]) for i in range(3))
    model = Q.fit(positive, unlabelled, cuts, 0.4, steps=6000, l2=1e-2)
    xp, xu = Q._design(positive, cuts), Q._design(unlabelled, cuts)
    best = plain_risk(model.weights, xp, xu, 0.4, 1e-2)
    assert best < plain_risk(np.zeros(len(model.weights)), xp, xu, 0.4, 1e-2) - 0.05
    for step in (0.3, 0.03):
        for d in [*np.eye(len(model.weights)), *rng.normal(size=(50, len(model.weights))) / 3]:
            for sign in (1, -1):
                assert plain_risk(model.weights + sign * step * d, xp, xu, 0.4, 1e-2) > best - 1e-4


def test_a_repeated_id_keeps_the_sample_bounded(spark, monkeypatch):
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1, 0), (2500, 1, 0)], "doc_id long, quality int, toxic int")
    seen, real = [], Q.bounded_rows
    monkeypatch.setattr(Q, "bounded_rows", lambda rows, most: seen.append(real(rows, most)) or seen[-1])
    assert Q.score_quality(docs, labels, sample=100).count() == 3000
    assert all(s.count() <= 200 for s in seen) and len(seen) == 2


def test_cuts_are_quantiles_of_all_training_rows(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models, real = [], Q.learn
    monkeypatch.setattr(Q, "learn", lambda *a, **k: models.append(real(*a, **k)) or models[-1])
    Q.score_quality(docs, labels, sample=60).count()
    import zlib
    own = np.array([Q.statistics(r.text or "") for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0])
    for i, c in enumerate(models[0].cuts):
        grid = np.sort(np.floor(np.minimum(own[:, i], Q.FAR) * Q.GRID))
        wanted = {grid[math.ceil(k * len(own) / Q.BINS) - 1] / Q.GRID for k in range(1, Q.BINS)}
        assert c.tolist() == sorted(wanted)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (8, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.score_quality(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert Q.score_quality(no_docs, labels).count() == 0
    assert {r.score for r in Q.score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score_quality(odd_docs, labels).select(F.max("predicted")).first()[0] in (0, 1)
