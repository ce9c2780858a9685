import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.functions.order_stats import average_rank, exact_quantiles, ranked_counts
from tillscope.operators import bootstrap, classification, correlation, group_tests, normality, power, rank_tests, regression


def value(spark, sql):
    return spark.range(1).selectExpr(f"{sql} AS v").first().v


@pytest.mark.parametrize("sql, expected", [
    (sp.f_sf("4.102821e0", "2", "10"), 0.05), (sp.f_sf("2.2142e0", "5", "60000"), 0.05),
    (sp.chi2_sf("3.841459e0", "1"), 0.05), (sp.chi2_sf("18.307038e0", "10"), 0.05), (sp.chi2_sf("3e0", "2"), math.exp(-1.5)),
    (sp.normal_two_sided("1.959964e0"), 0.05), (sp.kolmogorov_sf("1.3581e0"), 0.05),
    (sp.f_sf("2.2141e0", "5e0", "1e12"), 0.05), (sp.normal_quantile("0.02e0"), statistics.NormalDist().inv_cdf(0.02)),
])
def test_tail_probabilities(spark, sql, expected):
    assert value(spark, sql) == pytest.approx(expected, abs=1e-5)


@pytest.mark.parametrize("k", [30_000, 2_500_000, 10_000_000, 1_000_000_000])
@pytest.mark.parametrize("z", [-3.0, -1e-3, 0.0, 0.5, 2.5])
def test_upper_gamma_at_many_degrees_of_freedom(spark, k, z):
    # cube-root normal approximation, whose error is far below 1e-6 at these sizes
    x = k + z * math.sqrt(2 * k)
    w = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    assert value(spark, sp.chi2_sf(sp.num(x), sp.num(k))) == pytest.approx(statistics.NormalDist().cdf(-w), abs=2e-6)


def test_noncentral_f_where_the_first_weight_underflows(spark):
    # with these many degrees of freedom the ratio is close to normal
    d1, d2, ncp = 1e6, 1e9, 3536.0
    mean, sd = (d1 + ncp) / d1, math.sqrt(2 * (d1 + 2 * ncp)) / d1
    for z in (-1.0, 0.0, 1.5):
        got = value(spark, sp.noncentral_f_cdf(sp.num(mean + z * sd), sp.num(d1), sp.num(d2), sp.num(ncp)))
        assert got == pytest.approx(statistics.NormalDist().cdf(z), abs=1.5e-2)


def test_equal_values_of_many_groups_spread_over_the_ranges(spark):
    counts = spark.range(200_000).selectExpr("id % 2000 AS g", "id DIV 2000 AS v", "1L AS n")
    sample = counts.selectExpr("struct(v) AS k").distinct().count()
    ranks = ranked_counts(counts, ["v"], ["n"]).groupBy("v").agg(F.min("through_n").alias("t")).orderBy("v").collect()
    assert sample == 100 and [r.t for r in ranks] == [2000 * (i + 1) for i in range(100)]


def test_noncentral_f_agrees_with_the_central_one_and_with_simulation(spark):
    central = value(spark, sp.noncentral_f_cdf("3e0", "2", "20", "0e0"))
    assert central == pytest.approx(1 - value(spark, sp.f_sf("3e0", "2", "20")), abs=1e-12)
    rng = np.random.default_rng(1)
    x = ((rng.standard_normal(400_000) + math.sqrt(5)) ** 2 + rng.standard_normal(400_000) ** 2) / 2
    draws = x / (rng.chisquare(20, 400_000) / 20)
    assert value(spark, sp.noncentral_f_cdf("3e0", "2", "20", "5e0")) == pytest.approx((draws <= 3).mean(), abs=0.005)


def test_quantiles_equal_a_full_sort(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.lognormal(3, 2, 3000), -rng.exponential(5, 500), np.full(2000, 7.25), [0.0, 1e300, -1e-300],
                        1e6 + rng.random(800) * 1e-6])
    g = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, v double").repartition(5)
    probs = [0, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    assert exact_quantiles(df, "v", probs).first().q == pytest.approx(list(np.quantile(x, probs)), rel=1e-12)
    for row in exact_quantiles(df, "v", probs, ["g"]).collect():
        assert row.q == pytest.approx(list(np.quantile(x[g == row.g], probs)), rel=1e-12)
    assert exact_quantiles(df.where("g = 9"), "v", [0.5]).first().q in (None, [])


def test_ranks_equal_a_full_sort(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 40, 3000), rng.normal(20, 5, 3000)])
    counts = spark.createDataFrame([(float(v),) for v in x], "v double").groupBy("v").agg(F.count("*").alias("n"))
    got = {r.v: r.rank for r in ranked_counts(counts, ["v"], ["n"]).select("v", average_rank().alias("rank")).collect()}
    ordered = np.sort(x)
    for v, rank in got.items():
        lo, hi = np.searchsorted(ordered, v), np.searchsorted(ordered, v, side="right")
        assert rank == (lo + 1 + hi) / 2


def pairs(spark, counts):
    rows = [(a, b) for (a, b), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "a string, y string")


def test_chi_square_with_yates_and_empty_cells(spark):
    two = pairs(spark, {("x", "Yes"): 10, ("x", "No"): 20, ("z", "Yes"): 30, ("z", "No"): 5})
    row = group_tests.chi2_independence(two, "a", "y").first()
    assert row.chi2 == pytest.approx(16.5785, abs=1e-4) and row.dof == 1 and row.significant
    assert group_tests.chi2_independence(two, "a", "y", yates=False).first().chi2 == pytest.approx(18.7262, abs=1e-4)
    holes = pairs(spark, {("x", "Yes"): 10, ("z", "No"): 5, ("w", "No"): 5})
    assert group_tests.chi2_independence(holes, "a", "y").first().chi2 == pytest.approx(20)
    assert group_tests.chi2_independence(pairs(spark, {("x", "Yes"): 3, ("x", "No"): 2}), "a", "y").first().chi2 is None


def test_anova_kruskal_levene_on_a_small_table(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, x double")
    row = group_tests.anova(df, "g", "x").first()
    assert row.f_stat == pytest.approx(9.2647, abs=1e-3) and row.p_value == pytest.approx(0.0024, abs=1e-4)
    assert row.ssb + row.ssw == pytest.approx(sum((v - 8) ** 2 for vs in groups.values() for v in vs))
    h = rank_tests.kruskal(df, "g", "x").first()
    assert rank_tests.kruskal(df.withColumn("x", F.exp("x")), "g", "x").first().h_stat == pytest.approx(h.h_stat)
    assert group_tests.levene(df, "g", "x").first().k == 3


def test_two_sample_rank_tests(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, 300), rng.integers(3, 33, 200)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, x double")
    u = rank_tests.mann_whitney(df, "g", "a", "b", "x").first()
    brute = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert u.u_stat == brute
    assert u.u_stat + rank_tests.mann_whitney(df, "g", "b", "a", "x").first().u_stat == len(a) * len(b)
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert rank_tests.ks_2samp(df, "g", "a", "b", "x").first().d_stat == pytest.approx(d)


def test_correlations(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 400).astype(float)
    y, z = x + rng.normal(0, 4, 400), rng.normal(0, 1, 400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, 2 * x, np.ones(400))],
                               "x double, y double, z double, twice double, one double")
    r = correlation.pearson_test(df, "x", "y").first()
    assert r.r == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.significant
    spear = {(m.x, m.y): m.r for m in correlation.corr_matrix(df, ["x", "y"], "spearman").collect()}
    mono = {(m.x, m.y): m.r for m in correlation.corr_matrix(
        df.withColumn("y", F.exp("y")), ["x", "y"], "spearman").collect()}
    assert spear["x", "y"] == pytest.approx(mono["x", "y"]) and spear["x", "x"] == pytest.approx(1)
    part = correlation.partial_corr(df, "x", "y", "z").first()
    res = [v - np.polyval(np.polyfit(z, v, 1), z) for v in (x, y)]
    assert part.partial_r == pytest.approx(np.corrcoef(*res)[0, 1])
    vif = {v.variable: v.vif for v in correlation.vif(df, ["x", "twice", "z", "one"]).collect()}
    assert vif["x"] == vif["twice"] == math.inf and vif["one"] == 1 and vif["z"] == pytest.approx(1, abs=0.1)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.03, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "id int, p_value double")
    rows = group_tests.bh_adjust(df, "p_value", ["id"]).orderBy("id").collect()
    got = [r.p_adjusted for r in rows]
    assert got == pytest.approx([0.03, 0.048, 0.045, 0.03, 0.045, 0.9])
    assert all(a >= b for a, b in zip(got, p)) and got[2] == got[4]


def test_normality_and_quantile_points(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, 800), rng.exponential(1, 800)))],
                               "id int, bell double, skewed double")
    bell, skewed = (normality.normality(df, c, key=["id"]).first() for c in ("bell", "skewed"))
    assert not bell.rejected and bell.w_stat > 0.99 and skewed.rejected and skewed.w_stat < 0.9
    points = normality.qq_points(df.select(F.round("bell", 1).alias("v")), "v").orderBy("position").collect()
    assert [p.position for p in points] == list(range(1, 801))
    assert [p.value for p in points] == sorted(p.value for p in points)
    assert points[0].quantile == pytest.approx(statistics.NormalDist().inv_cdf(1 - 0.5 ** (1 / 800)))


def test_bootstraps_repeat_and_surround_the_plain_value(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 4}", float(np.round(rng.normal(i % 4, 2), 1)), "Yes" if rng.random() < 0.2 + 0.1 * (i % 4) else "No")
            for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, final_price double, return_status string")
    for kind in ("cramers_v", "eta_squared"):
        one = bootstrap.bootstrap_effect(df, "g", kind).first()
        two = bootstrap.bootstrap_effect(df.repartition(3), "g", kind).first()
        assert one.replicates == 200 and one.ci_low < one.point < one.ci_high
        assert [one.point, one.ci_low, one.ci_high] == pytest.approx([two.point, two.ci_low, two.ci_high], rel=1e-9)
        assert one.ci_low < one.plug_in < one.ci_high


def test_copies_are_drawn_like_separate_rows():
    h = bootstrap.mix(np.arange(1, 4001, dtype=np.uint64))
    for copies in (1, 5, 200):
        w = bootstrap.poisson_weights(h[:500], np.full(500, copies), 100)
        assert w.mean() == pytest.approx(copies, rel=0.02) and w.var() == pytest.approx(copies, rel=0.05)


def test_power_reaches_its_target_at_the_detectable_effect(spark):
    df = spark.createDataFrame([(f"g{i % 5}", f"h{i % 2}") for i in range(400)], "g string, h string")
    rows = power.detectable_effects(df, ["g", "h"]).withColumn("power", F.expr(power.anova_power("mde"))).collect()
    assert all(r.power == pytest.approx(0.8, abs=1e-6) for r in rows)
    curve = [r.power for r in power.anova_power_table(df, ["g"], points=10).orderBy("point").collect()]
    assert curve == sorted(curve) and curve[0] == pytest.approx(0.05, abs=0.01)


def test_roc_measures(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.8, 0.7, 0.7, 0.6, 0.4, 0.4, 0.1]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    pos, neg = [v for t, v in zip(y, s) if t], [v for t, v in zip(y, s) if not t]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 16
    assert classification.roc_auc(df).first().auc == pytest.approx(auc)
    curve = classification.roc_curve(df).orderBy("fpr", "tpr").collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(auc) and (curve[-1].fpr, curve[-1].tpr) == (1, 1)
    cells = {(r.actual, r.predicted): r.n for r in classification.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 2, (1, 0): 1, (1, 1): 3}
    none = classification.classification_metrics(df.withColumn("score", F.lit(0.0))).first()
    assert none.precision == 0 and none.recall == 0


def test_models_on_a_small_table(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(p), int(q), float(d), float(p * q * (1 - d / 100))) for i, (p, q, d) in enumerate(
        zip(rng.uniform(1, 100, 600), rng.integers(1, 5, 600), rng.integers(0, 30, 600)))]
    df = spark.createDataFrame(rows, "id int, product_price double, quantity int, discount_percentage double, final_price double")
    with pytest.raises(ValueError):
        regression.revenue_models(df.limit(100), key=["id"])
    out = regression.revenue_models(df, key=["id"], trees=5, depth=6).first()
    assert 0.5 < out.lr_r2 < 1 and 0.5 < out.rf_r2 < 1 and out.n_train + out.n_test == 600
    predictions = regression.ols_predictions(df, key=["id"])
    assert regression.fit_quality(predictions).first().r2 == pytest.approx(out.lr_r2)
    importance = regression.forest_importance(df, key=["id"], trees=5, depth=6).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1)


def test_qq_line_runs_through_the_mean(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(100, 111)], "v double")
    got = {r["position"]: r for r in normality.qq_points(rows, "v").collect()}
    assert abs(got[6]["reference"] - 105) < 1e-6 and abs(got[6]["quantile"]) < 1e-9


def test_spearman_ranks_present_values(spark):
    rows = pd.DataFrame({"a": [3.0, 1.0, None, 1.0, 5.0, None, 0.0], "b": [2.0, None, 4.0, 4.0, 9.0, None, -1.0]})
    ranks = rows.rank()
    want = ranks.dropna()["a"].corr(ranks.dropna()["b"])
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "a double, b double")
    got = {(r.x, r.y): r.r for r in correlation.corr_matrix(df, ["a", "b"], "spearman").collect()}
    assert got["a", "b"] == pytest.approx(want) and got["b", "a"] == pytest.approx(want)
    assert got["a", "a"] == pytest.approx(1)


def test_multinomial_draws_have_the_moments_of_their_law(spark):
    rng = np.random.default_rng(3)
    n = np.concatenate([rng.integers(1, 5, 40), rng.integers(100, 5000, 10)])
    sizes = np.bincount(np.arange(50) % 8, weights=n, minlength=8).astype(np.int64)
    draws = np.zeros((50, 4000))
    for bucket in range(8):
        own = np.arange(50) % 8 == bucket
        drawn = bootstrap.bucket_draws(sizes, bucket, 4000, 1)
        for at, out in bootstrap.cell_draws(n[own], drawn, 1, bucket):
            draws[np.flatnonzero(own)[at:at + len(out)]] = out
    assert (draws.sum(0) == n.sum()).all()
    p = n / n.sum()
    sd = np.sqrt(n.sum() * p * (1 - p))
    assert (np.abs(draws.mean(1) - n) < 5 * sd / np.sqrt(4000)).all()
    assert (np.abs(draws.var(1) / sd ** 2 - 1) < 0.15).all()
    cov = np.cov(draws[-2:])[0, 1]
    assert cov == pytest.approx(-n.sum() * p[-1] * p[-2], rel=0.35)


def test_cramers_v_redraws_do_not_depend_on_buckets_of_other_cells(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CELLS_PER_BUCKET", 4)
    rows = [(f"a{i % 9}", ("x", "y", "z", None)[(i * i) % 4]) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, return_status string").repartition(3)
    cells = df.where("return_status is not null").groupBy(F.col("g").alias("a"), F.col("return_status").alias("b")).agg(F.count("*").alias("n"))
    drawn = bootstrap.redrawn(cells, 20, 42)
    again = bootstrap.redrawn(cells.repartition(7), 20, 42)
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, again.collect()))
    sums = {r["replicate"]: r["n"] for r in drawn.groupBy("replicate").agg(F.sum("n").alias("n")).collect()}
    assert set(sums.values()) == {cells.agg(F.sum("n")).first()[0]} and len(sums) == 20
    got = {r["replicate"]: r["value"] for r in bootstrap.bootstrap_cramers_v(df, "g", n_boot=20).collect()}
    table = drawn.toPandas().pivot_table(index=["replicate", "a"], columns="b", values="n", fill_value=0)
    for r in range(20):
        t = table.loc[r].to_numpy(float)
        expected = np.outer(t.sum(1), t.sum(0)) / t.sum()
        chi2 = ((t - expected) ** 2 / np.where(expected == 0, 1, expected)).sum()
        free = min(cells.select("a").distinct().count(), cells.select("b").distinct().count()) - 1
        assert got[r] == pytest.approx(np.sqrt(chi2 / t.sum() / free), rel=1e-9)


@pytest.mark.parametrize("copies", [1, 3, 33, 500, 10 ** 6, 10 ** 9])
def test_poisson_draws_by_one_rule_for_all_counts(copies):
    h = bootstrap.mix(np.arange(1, 301, dtype=np.uint64))
    w = bootstrap.poisson_weights(h, np.full(300, copies), 100).ravel()
    assert abs(w.mean() - copies) < 5 * np.sqrt(copies / len(w)) and w.var() == pytest.approx(copies, rel=0.05)
    assert w.min() >= 0 and (w == np.floor(w)).all()


@pytest.mark.parametrize("m, n", [(1, 1), (1, 5), (2, 3), (4, 4), (5, 3), (7, 5), (8, 4), (8, 8)])
def test_exact_rank_tests_equal_enumeration(m, n):
    import itertools

    from tillscope.functions.small_samples import ks_exact, mann_whitney_exact

    h, u = [], []
    for chosen in itertools.combinations(range(m + n), m):
        i = j = most = pairs = 0
        for k in range(m + n):
            if k in chosen:
                i, pairs = i + 1, pairs + j
            else:
                j += 1
            most = max(most, abs(i * n - j * m))
        h.append(most)
        u.append(pairs)
    h, u = np.array(h), np.array(u)
    for k in {0, 1, *h.tolist(), m * n + 1}:
        assert ks_exact(m, n, k) == pytest.approx((h >= k).mean(), abs=1e-12)
    for k in range(m * n + 1):
        assert mann_whitney_exact(m, n, k) == pytest.approx(min(1, 2 * min((u <= k).mean(), (u >= k).mean())), abs=1e-12)


def test_exact_and_limiting_p_values_on_both_sides_of_the_switch(spark):
    def frame(a, b):
        return spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")

    from tillscope.functions.small_samples import ks_exact, mann_whitney_exact

    rng = np.random.default_rng(2)
    a, b = rng.permutation(1000)[:8], 2000 + rng.permutation(1000)[:30] - rng.integers(0, 2, 30) * 2000 + 0.5
    u = sum((y < x) for x in a for y in b)
    got = rank_tests.mann_whitney(frame(a, b), "g", "a", "b", "v").first()
    assert got["u_stat"] == u and got["p_value"] == pytest.approx(mann_whitney_exact(8, 30, u), rel=1e-12)
    nine = rank_tests.mann_whitney(frame([*a, 1e6], b), "g", "a", "b", "v").first()["p_value"]
    tied = rank_tests.mann_whitney(frame([*a[:7], b[0]], b), "g", "a", "b", "v").first()
    for p, (m, n) in ((nine, (9, 30)), (tied["p_value"], (8, 30))):
        assert p is not None
    z = max(0, abs(tied["u_stat"] - 120) - 0.5) / np.sqrt(240 / 12 * (39 - 6 / (38 * 37)))
    assert tied["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    both = rank_tests.ks_2samp(frame([1, 2, 2, 5], [2, 3, 7]), "g", "a", "b", "v").first()
    assert both["p_value"] == pytest.approx(ks_exact(4, 3, round(both["d_stat"] * 12)), rel=1e-12)
    big = spark.range(10_001).selectExpr("'a' as g", "cast(id as double) as v").union(spark.range(50).selectExpr("'b' as g", "cast(id * 200 as double) as v"))
    long = rank_tests.ks_2samp(big, "g", "a", "b", "v").first()
    short = rank_tests.ks_2samp(big.where("v < 10000 or g = 'b'"), "g", "a", "b", "v").first()
    assert long["n_a"] == 10_001 and short["n_a"] == 10_000 and long["p_value"] == pytest.approx(short["p_value"], abs=0.02)


def test_ranks_of_few_and_of_many_values_agree(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in (rng.integers(0, 4), rng.normal(), rng.integers(0, 30))) for _ in range(300)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = {c: [None if v is None else v for v in df.toPandas()[c].rank(method="average").astype(object).where(df.toPandas()[c].notna(), None)] for c in df.columns}
    for limit in (50_000, 30, 0):  # all, some and no columns by broadcast
        monkeypatch.setattr(correlation, "GROUP_BROADCAST_LIMIT", limit)
        got = [tuple(r) for r in correlation.with_ranks(df, df.columns).collect()]
        key = lambda t: tuple((v is None, v or 0) for v in t)
        have = sorted((t for t in got if any(v is not None for v in t)), key=key)
        assert have == sorted((t for t in zip(*want.values()) if any(v is not None for v in t)), key=key)


def test_cells_of_few_values_do_not_travel(spark):
    df = spark.range(2000).selectExpr("CAST(id % 5 AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    seen = []
    kept = correlation.stage
    try:
        correlation.stage = lambda d, name: (seen.append((name, d._jdf.queryExecution().executedPlan().toString())), kept(d, name))[1]
        correlation.with_ranks(df, ["a", "b"]).count()
    finally:
        correlation.stage = kept
    plan = dict(seen)["ranked-rows"]
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
