"""Splits, forest and logistic model against plain NumPy on hand tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.operators import forest, regression, sampling
from tillscope.operators.sampling import row_digest


def digest(*parts, seed=42):
    return hashlib.md5("|".join([str(seed), *("" if p is None else str(p) for p in parts)]).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 3, 4, 101, 1000])
def test_split_takes_the_smallest_digests(spark, n):
    df = spark.createDataFrame([(i, f"x{i % 7}") for i in range(n)], "id long, c string").repartition(3)
    got = {r["id"]: r["is_test"] for r in sampling.split(df, key=["id"]).collect()}
    order = sorted(range(n), key=lambda i: digest(i))
    assert {i for i, t in got.items() if t} == set(order[:math.ceil(n / 4)]) and len(got) == n


def test_stratified_split_stays_within_one_row(spark):
    sizes = {"a": 400, "b": 37, None: 11, "c": 2, "d": 1}
    rows = [(i, c) for c, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, j long, c string").repartition(4)
    got = sampling.split(df, key=["id"], by=["c"]).collect()
    test = Counter(r["c"] for r in got if r["is_test"])
    assert sum(test.values()) == math.ceil(len(rows) / 4)
    for c, n in sizes.items():
        assert abs(test[c] - n * sum(test.values()) / len(rows)) < 1
        order = sorted((r["id"] for r in got if r["c"] == c), key=lambda i: digest(i))
        assert {r["id"] for r in got if r["c"] == c and r["is_test"]} == set(order[:test[c]])


@pytest.mark.parametrize("by", [[], ["c"]])
def test_split_of_equal_rows_is_exact(spark, by):
    rows = [(1, "x")] * 333 + [(2, "x")] * 7 + [(3, "y")] * 12
    df = spark.createDataFrame(rows, "id long, c string").repartition(5)
    got = sampling.split(df, by=by).collect()
    assert len(got) == len(rows) and sum(r["is_test"] for r in got) == 88
    if by:
        assert sum(r["is_test"] for r in got if r["c"] == "y") == 3
    assert sampling.split(df.limit(0), by=by).count() == 0


def plain_forest(cells, depth):
    """{(tree, cell): node}, {(tree, node): (w, s)} and {(tree, feature): gain}, grown one node at a time."""
    leaf, stats, gains = {}, {}, Counter()
    for tree, own in cells.items():
        todo = [(1, list(own))]
        while todo:
            node, members = todo.pop()
            w, s = (sum(own[c][k] for c in members) for k in (0, 1))
            stats[tree, node] = (w, s)
            best = None
            if node < 1 << depth:
                for f in range(len(members[0])):
                    for b in sorted({c[f] for c in members if own[c][0]}):
                        left = [own[c] for c in members if c[f] <= b]
                        wl, sl = (sum(x[k] for x in left) for k in (0, 1))
                        d = sl * w - s * wl
                        if wl < w and d:
                            gain = float(sl) * w - float(s) * wl
                            gain = gain * gain / (float(w) * (float(wl) * (w - wl)))
                            if best is None or gain > best[0]:
                                best = (gain, f, b)
            if best is None:
                leaf.update({(tree, c): node for c in members})
                continue
            gains[tree, best[1]] += best[0]
            todo.append((2 * node, [c for c in members if c[best[1]] <= best[2]]))
            todo.append((2 * node + 1, [c for c in members if c[best[1]] > best[2]]))
    return leaf, stats, gains


def xxhash_weights(spark, digests, trees):
    rows = spark.createDataFrame([(d,) for d in digests], "digest string").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("digest", "tree"), 11) * F.lit(2.0 ** -53))
    out = {}
    for r in rows.collect():
        p, total, k = math.exp(-1), math.exp(-1), 0
        while r["u"] >= total:  # the smallest count whose distribution function is above u
            k += 1
            p /= k
            total += p
        out[r["digest"], r["tree"]] = k
    return out


@pytest.mark.parametrize("shared", [7, 2])
def test_forest_equals_one_grown_node_by_node(spark, monkeypatch, shared):
    monkeypatch.setattr(forest, "SHARED_LEVELS", shared)
    rng = np.random.default_rng(6)
    n, trees, depth = 400, 7, 5
    x = np.column_stack([rng.integers(0, 9, n), np.round(rng.normal(size=n), 1), np.full(n, 3)])
    y = np.round(x[:, 0] * 2 + np.abs(x[:, 1]) * 5 + rng.normal(size=n) * 0.1, 2)
    test = rng.random(n) < 0.3
    rows = [(f"k{i}", float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(y[i]), bool(test[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double, label double, is_test boolean").repartition(3)
    grown = forest.grow(df, ["a", "b", "c"], "label", ~F.col("is_test"), 42, ["id"], trees, depth)
    cuts = [(lambda v: [(p + q) / 2 for p, q in zip(v, v[1:])])(sorted(set(x[~test, f].tolist()))) for f in range(3)]
    assert grown.cuts == cuts
    cell = [tuple(sum(c <= x[i, f] for c in cuts[f]) for f in range(3)) for i in range(n)]
    digests = [digest(f"k{i}") for i in range(n)]
    weights = xxhash_weights(spark, digests, trees)
    low, high = y[~test].min(), y[~test].max()
    centre, unit = low + (high - low) / 2, 2.0 ** math.frexp(high - low)[1] / (1 << 24)
    q = [math.floor((v - centre) / unit + 0.5) if v >= centre else -math.floor((centre - v) / unit + 0.5) for v in y]
    cells = {}
    for t in range(trees):
        own = cells.setdefault(t, {})
        for i in range(n):
            w, s = own.get(cell[i], (0, 0))
            k = 0 if test[i] else weights[digests[i], t]
            if k or test[i]:
                own[cell[i]] = (w + k, s + k * q[i])
    leaf, stats, gains = plain_forest(cells, depth)
    mean = lambda t, c: centre + unit * stats[t, leaf[t, c]][1] / stats[t, leaf[t, c]][0]
    got = {r["id"]: r["fitted"] for r in forest.predicted(grown, df.where("is_test")).collect()}
    assert len(got) == test.sum()
    for i in np.flatnonzero(test):
        assert got[f"k{i}"] == pytest.approx(np.mean([mean(t, cell[i]) for t in range(trees)]), rel=1e-12)
    share = {r["feature"]: r["importance"] for r in forest.importances(grown).collect()}
    total = {t: sum(g for (u, _), g in gains.items() if u == t) for t in range(trees)}
    assert share == pytest.approx({f: np.mean([gains[t, f] / total[t] for t in range(trees)]) for f in (0, 1)}, rel=1e-9)


def test_forest_of_many_values_learns_and_one_of_equal_labels_has_no_split(spark):
    rng = np.random.default_rng(7)
    x = rng.random((3000, 2))
    rows = [(i, float(a), float(b), float(10 * a + (b > 0.5))) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    out = regression.forest_predictions(df, ["a", "b"], "y", key=["id"], trees=10, depth=8)
    assert out.count() == 750 and regression.fit_quality(out).first()["r2"] > 0.99
    same = forest.grow(df.withColumn("label", F.lit(5.0)), ["a"], "label", F.col("id") % 2 == 0, 1, ["id"], 3, 4)
    assert same.splits.count() == 0 and {r["fitted"] for r in forest.predicted(same, df.where("id % 2 = 1")).collect()} == {5.0}
    assert forest.importances(same).count() == 0


def test_poisson_copies_have_their_chances(spark):
    u = spark.range(200_000).select(F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0 ** -53).alias("u"))
    u = u.toDF("u").select(F.expr(forest.copies("u")).alias("k")).groupBy("k").count().collect()
    got = {r["k"]: r["count"] / 200_000 for r in u}
    for k in range(5):
        assert got[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert row_digest(["id"], 42) is not None


def test_logistic_coefficients_equal_plain_newton(spark, tx):
    from tillscope.operators import classification

    rng = np.random.default_rng(9)
    n = 900
    age, level = rng.integers(18, 70, n), rng.integers(0, 3, n)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.08 * (age - 40) + (level == 2) - 0.5)))
    df = tx(*[dict(order_id=f"o{k}", age=int(age[k]), customer_segment=None if k % 50 == 0 else "ABC"[level[k]], delivery_days=7.0, return_status="Yes" if y[k] else "No") for k in range(n)])
    df = df.withColumn("returned", (F.col("return_status") == "Yes").cast("int")).repartition(4)
    scored, weights, data = classification.fit_returns(df, ["age", "delivery_days"], ["customer_segment", "gender"], key=["order_id"])
    test = {r["order_id"] for r in sampling.split(df, key=["order_id"], by=["returned"]).where("is_test").select("order_id").collect()}
    x = np.column_stack([age, np.full(n, 7.0), *(((level == k) & (np.arange(n) % 50 != 0)) for k in (1, 2))]).astype(float)
    train = np.array([f"o{k}" not in test for k in range(n)])
    m, s = x[train].mean(0), x[train].std(0)
    z = np.column_stack([np.ones(n), (x - m) / np.where(s == 0, 1, s)])
    beta = np.zeros(5)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[train] @ beta))
        g = z[train].T @ (y[train] - p) - [0, *beta[1:]]
        beta += np.linalg.solve((z[train] * (p * (1 - p))[:, None]).T @ z[train] + np.diag([0, 1, 1, 1, 1]), g)
    assert np.abs(g).max() < 1e-8
    got = {r["feature"]: r["coef"] for r in weights.collect()}
    assert got == pytest.approx(dict(zip(["age", "delivery_days", "customer_segment_B", "customer_segment_C"], beta[1:])), abs=1e-8)
    want = sorted((1 / (1 + np.exp(-z[~train] @ beta))).tolist())
    assert sorted(r["score"] for r in scored.collect()) == pytest.approx(want, abs=1e-9)


def test_draws_are_summed_where_rows_arrive(spark):
    rows = spark.range(500).selectExpr("CAST(id % 5 AS INT) AS _bin0", "CAST(id % 3 AS INT) AS _bin1", "id % 4 > 0 AS train", "id AS q", "md5(CAST(id AS STRING)) AS digest")
    text = forest._drawn(rows, ["_bin0", "_bin1"], 20)._jdf.queryExecution().executedPlan().toString()
    text = text[:text.index("Initial Plan")] if "Initial Plan" in text else text
    above = text[:text.index("Generate explode")]
    assert above.count("Exchange") == 1  # of sums, not of draws
    between = above[above.rindex("Exchange"):]
    assert between.count("HashAggregate") == 2


def test_rows_of_an_outsize_cell_are_dealt_over_tasks_with_the_same_forest(spark, monkeypatch):
    df = spark.range(600).selectExpr("id", "CAST(IF(id % 10 = 0, id % 7, 3) AS DOUBLE) AS a", "CAST(id % 13 AS DOUBLE) AS label", "id % 4 = 1 AS is_test")
    kept = []
    for most in (forest.CELL_ROWS, 20):
        monkeypatch.setattr(forest, "CELL_ROWS", most)
        bins = df.selectExpr("CAST(a AS INT) AS _bin0", "md5(CAST(id AS STRING)) AS digest")
        parts = forest._dealt(bins, ["_bin0"]).groupBy("_bin0").agg(F.count_distinct("part").alias("n"), F.count("*").alias("rows"))
        kept.append({r["_bin0"]: (r["n"], r["rows"]) for r in parts.collect()})
        grown = forest.grow(df, ["a"], "label", ~F.col("is_test"), 1, ["id"], 5, 3)
        kept.append([{r["id"]: r["fitted"] for r in forest.predicted(grown, df.where("is_test")).collect()},
                     {tuple(r) for r in grown.splits.select("tree", "node", "feature", "bin", "w", "s", "wl", "sl").collect()}])
    assert kept[1] == kept[3] and len(kept[1][0]) == 150
    assert {n for n, _ in kept[0].values()} == {1} and kept[2][3][0] > 5
    assert {b: rows for b, (_, rows) in kept[0].items()} == {b: rows for b, (_, rows) in kept[2].items()}


def staged(spark, since=()):
    """Names of the staged tables, of those that are not in ``since``."""
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir"))
    return [p for p in root.iterdir() if p not in since]


def test_nodes_of_few_cells_grow_where_they_arrive_to_the_same_forest(spark, monkeypatch):
    df = spark.range(900).selectExpr("id", "CAST(id * 7 % 31 AS DOUBLE) AS a", "CAST(id * id % 17 AS DOUBLE) AS b", "CAST(id * 31 % 101 + id % 3 AS DOUBLE) AS label", "id % 4 = 1 AS is_test")
    kept = []
    for most in (0, 200, forest.NODE_CELLS):  # level by level; the lower levels in tasks; all in tasks
        monkeypatch.setattr(forest, "NODE_CELLS", most)
        before = staged(spark)
        grown = forest.grow(df, ["a", "b"], "label", ~F.col("is_test"), 1, ["id"], 6, 7)
        cells = sum(p.name.startswith("cells-") for p in staged(spark, before))
        fitted = {r["id"]: r["fitted"] for r in forest.predicted(grown, df.where("is_test")).collect()}
        rows = grown.splits.select("tree", "node", "feature", "bin", "gain", "w", "s", "wl", "sl").collect()
        kept.append((cells, fitted, set(map(tuple, rows)), len(rows), {r["feature"]: r["importance"] for r in forest.importances(grown).collect()}))
    (a, fitted, splits, n, share), *others = kept
    assert a == 8 and 1 < others[0][0] < 6 and others[1][0] == 1  # cells are written once, not at every level
    assert len(fitted) == 225 and len(splits) == n > 150
    for _, f, x, m, i in others:
        assert f == pytest.approx(fitted, rel=1e-12) and x == splits and m == n and i == pytest.approx(share, rel=1e-12)


def test_one_row_a_cell_travels_of_rows_that_are_not_trained_on(spark):
    rows = spark.range(500).selectExpr("CAST(id % 5 AS INT) AS _bin0", "id % 4 > 0 AS train", "id AS q", "md5(CAST(id AS STRING)) AS digest")
    dealt, deal = [], forest._dealt
    try:
        forest._dealt = lambda marked, bins: dealt.append(marked) or deal(marked, bins)
        cells = forest._drawn(rows, ["_bin0"], 20)
    finally:
        forest._dealt = deal
    assert {(r["train"], r["digest"] and len(r["digest"])): r["count"] for r in dealt[0].groupBy("train", "digest").count().collect()}.keys() == {(True, 16), (False, None)}
    assert dealt[0].where("NOT train").count() == 5 and dealt[0].where("train").count() == 375
    assert cells.where("asked").count() == 100


def test_models_stage_neither_digests_nor_assembled_features(spark):
    df = spark.range(400).selectExpr("CAST(id AS STRING) AS id", "CAST(id % 9 AS DOUBLE) AS a", "CAST(id % 11 AS DOUBLE) AS y", "'not used' AS more")
    before = staged(spark)
    out = regression.forest_predictions(df, ["a"], "y", key=["id"], trees=2, depth=2)
    assert out.count() == 100
    names = {p.name.rsplit("-", 1)[0]: spark.read.parquet(str(p)).columns for p in staged(spark, before) if p.name.startswith(("rows-", "model-input-", "digests-"))}
    assert names == {"rows": ["id", "a", "y"], "model-input": ["a", "id", "label", "is_test"]}
