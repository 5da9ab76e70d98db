"""The low-rank text model against a dense decomposition, and what its vectors are for."""

import random

import numpy as np

from churnlens.operators import segments as SG
from churnlens.operators.text_model import TextModel, fit_text_model


def corpus(n=400):
    """Topics with words of their own; within a topic two words stand for each other."""
    r = random.Random(3)
    topics = {"billing": (["invoice", "charge", "refund", "card"], ["price", "cost"]), "phone": (["call", "ring", "dial", "line"], ["drop", "cutoff"]),
              "sync": (["data", "record", "import", "patient"], ["error", "failure"])}
    out = []
    for _ in range(n):
        own, pair = topics[r.choice(list(topics))]
        out.append(" ".join(r.sample(own, 3) + [r.choice(pair)] + r.sample(["the", "a", "and", "we", "it"], 3)))
    return out


def dense(model, texts):
    a = np.zeros((len(texts), len(model.words)))
    for i, t in enumerate(texts):
        at, value = model.row(t)
        a[i, at] = value
    return a


def test_axes_are_those_of_a_dense_decomposition(spark):
    texts = corpus()
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "?!"]], "t string").repartition(5)
    model = fit_text_model(df, "t", 5, rounds=30, spare=4)
    a = dense(model, texts)
    assert np.allclose(model.axes.T @ model.axes, np.eye(5), atol=1e-10)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    held = ((a @ model.axes) ** 2).sum(axis=0)
    assert np.allclose(held, s[:5] ** 2, rtol=1e-6)
    assert np.allclose(np.abs(np.sum(model.axes[:, :3] * vt[:3].T, axis=0)), 1, atol=1e-4)


def test_words_of_like_use_are_nearer_than_chance(spark):
    texts = corpus()
    model = fit_text_model(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 3)
    vec = {w: model([w])[0] for w in model.words}
    like = [vec[a] @ vec[b] for a, b in (("price", "cost"), ("drop", "cutoff"), ("error", "failure"))]
    content = [w for w in model.words if len(w) > 3]
    chance = [vec[a] @ vec[b] for a in content for b in content if a < b]
    assert min(like) > 0.9 and np.median(chance) < 0.2
    # the pairs never stand in one text, so counting words cannot find them
    assert not any("price" in t and "cost" in t for t in texts)


def test_as_embedder_saved_and_loaded(spark, tmp_path):
    texts = corpus(60)
    df = spark.createDataFrame([(f"r{i}", "Dental", t) for i, t in enumerate(texts)], "row_id STRING, CORE_INDUSTRY STRING, SWAT_CANCEL_SUMMARY STRING")
    model = fit_text_model(df, SG.REASON_COLUMN, 3, words=30)
    model.save(spark, str(tmp_path / "m"))
    back = TextModel.load(spark, str(tmp_path / "m"))
    assert back.words == model.words and (back.axes == model.axes).all() and (back([*texts, None, "zzz"]) == model([*texts, "", "zzz"])).all()
    assert (model(["zzz"]) == 0).all()
    emb = SG.embed(df, embedder=back, profile_dim=3, reason_dim=3)
    out, centres = SG.cluster(emb, k=3)
    assert out.count() == 60 and len(centres[0]) == 6
    assert fit_text_model(df.where("false"), SG.REASON_COLUMN, 3)(["x"]).shape == (1, 3)
