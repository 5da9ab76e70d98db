import numpy as np
from pyspark.sql import functions as F

from churnlens.llm import source_mix as M
from corpus_docs import make_docs

SF = "/root/testdata/sf0.01"


def fitted(spark, seed, targets, whole, size=400, sharp=0.3):
    rng = np.random.default_rng(seed)
    members = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(rng.integers(0, 500, size), rng.dirichlet([sharp] * 3, size))],
                                    "n_tokens long, p array<double>")
    fit = M.fit_rates(members, targets, whole)
    least = [float(d in whole) for d in range(3)]
    rows = np.array([[r.n_tokens, *r.p, r.x] for r in members.withColumn("x", M._rate(F.col("p"), fit.g, least)).collect()])
    n, p, x = rows[:, 0], rows[:, 1:4], rows[:, 4]
    low = np.array(least)[p.argmax(axis=1)]
    assert (x >= low).all()
    return fit, n, p, x, low


def check_optimal(fit, n, p, x, low):
    """The conditions of a convex optimum, from the rates alone: free documents have no slope, bound ones a slope into the bound."""
    mass = (p * n[:, None]).T @ p
    mu = np.linalg.solve(mass, (n * x) @ p - fit.wanted)
    slope = M.RIDGE * (x - 1) + p @ mu
    scale = M.RIDGE * np.abs(x).max()
    assert np.abs(slope[(x > low) & (n > 0)]).max(initial=0) < 1e-2 * scale + 1e-9
    assert (slope[x == low] > -1e-2 * scale - 1e-9).all()
    assert fit.off <= M.OPTIMALITY


def test_rates_meet_targets_as_near_to_one_copy_as_can_be(spark):
    for seed in range(3):
        fit, n, p, x, low = fitted(spark, seed, [0.45, 0.35, 0.2], [0])
        got = (n * x) @ p
        assert np.allclose(got / got.sum(), [0.45, 0.35, 0.2], atol=1e-6) and fit.residual < 1e-6
        check_optimal(fit, n, p, x, low)
        # any other rates that meet the targets are farther from one copy: random directions that keep the totals
        rng, used = np.random.default_rng(seed), n > 0
        for _ in range(20):
            d = rng.normal(size=len(x)) * (x > low) * used
            a = (p * n[:, None])[used].T
            d[used] -= np.linalg.lstsq(a, a @ d[used], rcond=None)[0] * ((x > low)[used])
            other = np.maximum(x + 0.05 * d, low)
            if np.allclose((n * other) @ p, got, rtol=1e-6):
                assert (n * (other - 1) ** 2).sum() > (n * (x - 1) ** 2).sum() - 1e-6


def test_sharp_targets_end_at_the_constrained_optimum(spark):
    """Targets that two whole domains make hard or impossible: optimal all the same, and the residual tells."""
    for seed in range(6):
        fit, n, p, x, low = fitted(spark, seed, [0.9, 0.09, 0.01], [0, 1], size=300)
        check_optimal(fit, n, p, x, low)
        got = (n * x) @ p
        assert abs(fit.residual - np.abs(got / got.sum() - [0.9, 0.09, 0.01]).max()) < 1e-9


def test_a_repeated_id_keeps_the_sample_bounded(spark):
    """One labelled id on most rows, all texts different: the rows that are fitted on stay within twice the sample."""
    docs = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"))
    labelled = spark.createDataFrame([(1, "good"), (5500, "toxic"), (5501, "toxic")], "doc_id long, domain string")
    seen = []
    real = M.bounded_rows
    M.bounded_rows = lambda rows, most: seen.append(real(rows, most)) or seen[-1]
    try:
        model = M.fit_domains(docs, labelled, sample=50)
    finally:
        M.bounded_rows = real
    assert seen[0].count() == 100 and model.domains


def test_labelled_table_separates_domains(spark):
    good = [f"calm plain sentence number {i} about rivers and hills" for i in range(60)]
    toxic = [f"calm plain sentence number {i} about rivers and scum" for i in range(60)]
    docs = make_docs(spark, good + toxic)
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(0, 120, 2)] + [(3, None, None), (None, 1, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rates = {r.doc_id: r for r in M.mix_rates(docs, M.label_domains(labels)).collect()}
    assert all(rates[i].domain == ("toxic" if i >= 60 else "good") for i in range(120))
    assert all(rates[i].rate >= 1 and rates[i].copies >= 1 for i in range(60)) and max(rates[i].rate for i in range(60, 120)) < 0.5
    kept = M.mix(docs, M.label_domains(labels))
    assert kept.columns == [*docs.columns, "mix_rate", "mix_copies"]
    assert {r.doc_id for r in kept.collect()} >= set(range(60))


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("crc32(cast(doc_id AS string)) % 4 <> 0")
    rates = M.mix_rates(docs, M.label_domains(train))
    test = M.label_domains(labels.where("crc32(cast(doc_id AS string)) % 4 = 0"))
    hit = rates.select("doc_id", F.col("domain").alias("found")).join(test, "doc_id").agg(F.avg((F.col("found") == F.col("domain")).cast("int"))).first()[0]
    assert hit > 0.8


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    rows = M.mix_rates(odd_docs, M.label_domains(labels)).collect()
    assert len(rows) == odd_docs.count() and all(r.rate >= 0 for r in rows)
    assert len({(r.rate, r.copies) for r in rows if r.doc_id == 4}) == 1
    assert M.mix(odd_docs, M.label_domains(labels)).count() <= odd_docs.count()
    assert M.mix_rates(no_docs, M.label_domains(labels)).count() == 0
    unlabelled = M.mix_rates(odd_docs, M.label_domains(labels.limit(0))).collect()
    assert {(r.rate, r.copies, r.domain) for r in unlabelled} == {(1.0, 1, None)}
