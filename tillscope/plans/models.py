"""Registered queries: splits, regression, residuals, classification."""

from __future__ import annotations

from tillscope.functions.special import DUCK
from tillscope.functions import special as sp
from tillscope.functions.staging import stage
from tillscope.operators import classification as cl
from tillscope.operators import normality as nm
from tillscope.operators import regression as rg
from tillscope.operators.sampling import extremes, split
from tillscope.plans.catalog import Query
from tillscope.plans.reports import SAMPLE_KEYS

QUERIES: list[Query] = []
KEYS = ("order_id", "customer_id", "order_date")
MODEL_COLS = (*SAMPLE_KEYS, "product_price", "discount_percentage", "final_price")


def add(name, columns, run, body=None):
    QUERIES.append(Query(name, columns, run, body))


def revenue(c):
    return c.df.select(*MODEL_COLS)


def returns(c):
    return c.df.select(*KEYS, *cl.NUMERIC, *cl.CATEGORICAL, "returned")


SPLIT_SQL = """sp AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || order_id || '|' || customer_id || '|' ||
  CAST(order_date AS VARCHAR) || '|' || CAST(quantity AS VARCHAR))) <= ceil(count(*) OVER () * 0.25) AS is_test FROM en)"""
OLS_SQL = SPLIT_SQL + """,
tr AS (SELECT product_price AS a, CAST(quantity AS DOUBLE) AS b, discount_percentage AS c, final_price AS y FROM sp WHERE NOT is_test),
cv AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, var_pop(a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac,
  var_pop(b) AS bb, covar_pop(b, c) AS bc, var_pop(c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, covar_pop(c, y) AS cy FROM tr),
dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM cv),
wt AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det AS w1,
  (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det AS w2,
  (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det AS w3 FROM dt),
w0 AS (SELECT w1, w2, w3, my - w1 * ma - w2 * mb - w3 * mc AS w0 FROM wt),
pr AS (SELECT final_price AS actual, w0 + w1 * product_price + w2 * quantity + w3 * discount_percentage AS fitted,
  final_price - (w0 + w1 * product_price + w2 * quantity + w3 * discount_percentage) AS residual FROM sp, w0 WHERE is_test)"""

add("model_guard", "rows_seen:l classes:l ok:b", lambda c: rg.model_guard(returns(c), "returned"),
    """SELECT count(*) AS rows_seen, count(DISTINCT returned) AS classes,
  count(*) >= 200 AND count(DISTINCT returned) >= 2 AS ok FROM en""")
add("ols_coefficients", "feature coefficient:4", lambda c: rg.ols_coefficients(revenue(c), key=SAMPLE_KEYS),
    OLS_SQL + """
---
SELECT 'product_price' AS feature, w1 AS coefficient FROM w0 UNION ALL SELECT 'quantity', w2 FROM w0
  UNION ALL SELECT 'discount_percentage', w3 FROM w0 UNION ALL SELECT '(intercept)', w0 FROM w0""")
add("ols_predictions", "actual:4 fitted:1 residual:1", lambda c: rg.ols_predictions(revenue(c), key=SAMPLE_KEYS),
    OLS_SQL + "\n---\nSELECT * FROM pr")
add("ols_quality", "r2:6 mae:2 n_test:l", lambda c: rg.fit_quality(rg.ols_predictions(revenue(c), key=SAMPLE_KEYS)),
    OLS_SQL + """
---
SELECT 1 - sum(power(actual - fitted, 2)) / (var_pop(actual) * count(*)) AS r2, avg(abs(actual - fitted)) AS mae,
  count(*) AS n_test FROM pr""")


def staged_predictions(c):
    return stage(rg.ols_predictions(revenue(c), key=SAMPLE_KEYS), "predictions")


add("residual_shape", "skewness:4 kurtosis:4 near_normal:b",
    lambda c: nm.residual_shape(rg.ols_predictions(revenue(c), key=SAMPLE_KEYS), "residual"),
    OLS_SQL + """,
mo AS (SELECT avg(residual) AS m, var_pop(residual) AS v FROM pr),
sh AS (SELECT avg(power(residual - m, 3)) / power(any_value(v), 1.5) AS skewness,
  avg(power(residual - m, 4)) / power(any_value(v), 2) - 3 AS kurtosis FROM pr, mo)
---
SELECT *, abs(skewness) < 0.5 AND abs(kurtosis) < 1 AS near_normal FROM sh""")
_P = sp.f_sf("w_stat", "1", "(n - 2)", DUCK)
add("heteroscedasticity", "variance_ratio:4 w_stat:3 p_value:6 constant_variance:b",
    lambda c: rg.heteroscedasticity(staged_predictions(c)),
    OLS_SQL + f""",
hh AS (SELECT residual AS r, fitted > (SELECT median(fitted) FROM pr) AS h FROM pr),
hm AS (SELECT h, median(r) AS m FROM hh GROUP BY 1),
hz AS (SELECT hh.h, abs(r - m) AS z FROM hh JOIN hm ON hh.h = hm.h),
hg AS (SELECT h, count(*) AS n, avg(z) AS mean, var_pop(z) AS vp FROM hz GROUP BY 1),
hs AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * power(mean - (SELECT avg(z) FROM hz), 2)) / (sum(n * vp) / (sum(n) - 2)) AS w_stat FROM hg)
---
SELECT (SELECT var_pop(r) FILTER (WHERE h) / var_pop(r) FILTER (WHERE NOT h) FROM hh) AS variance_ratio, w_stat,
  {_P} AS p_value, {_P} >= 0.05 AS constant_variance FROM hs""")
add("residual_qq_points", "position:l quantile:6 value:1 reference:1",
    lambda c: nm.qq_points(staged_predictions(c), "residual"),
    OLS_SQL + f""",
qp AS (SELECT residual AS value, row_number() OVER (ORDER BY residual) AS position, count(*) OVER ()::DOUBLE AS n,
  stddev_pop(residual) OVER () AS sd, avg(residual) OVER () AS mean FROM pr),
qm AS (SELECT *, CASE WHEN position = n THEN power(0.5, 1 / n) WHEN position = 1 THEN 1 - power(0.5, 1 / n)
  ELSE (position - 0.3175) / (n + 0.365) END AS p FROM qp),
qq AS (SELECT *, {sp.normal_quantile('p', DUCK)} AS quantile FROM qm)
---
SELECT position, quantile, value, mean + quantile * sd AS reference FROM qq""")
add("revenue_models", "lr_r2:6 lr_mae:2 rf_r2:6 rf_mae:2 r2_gap:6 solved:b n_train:l n_test:l "
    "importance_product_price:6 importance_quantity:6 importance_discount_percentage:6",
    lambda c: rg.revenue_models(revenue(c), key=SAMPLE_KEYS))
add("forest_predictions", "actual:4 fitted:1 residual:1", lambda c: rg.forest_predictions(revenue(c), key=SAMPLE_KEYS))

# --- returns ----------------------------------------------------------------

add("one_hot", "feature ones:l", lambda c: cl.one_hot_counts(c.flat(*cl.CATEGORICAL)),
    " UNION ALL ".join(
        f"""SELECT '{x}_' || {x} AS feature, count(*) AS ones FROM en WHERE {x} > (SELECT min({x}) FROM en) GROUP BY 1"""
        for x in cl.CATEGORICAL))
add("standardise", "order_id age:6 product_price:6 quantity:6 final_price:6",
    lambda c: cl.standardise(split(c.df.select(*MODEL_COLS, "age"), 25, 42, SAMPLE_KEYS),
                             ["age", "product_price", "quantity", "final_price"]).where("is_test"),
    SPLIT_SQL + "\n---\nSELECT order_id, " + ", ".join(
        f"({x} - (SELECT avg({x}) FROM sp WHERE NOT is_test)) / (SELECT stddev_pop({x}) FROM sp WHERE NOT is_test) AS {x}"
        for x in ("age", "product_price", "quantity", "final_price")) + " FROM sp WHERE is_test")
#: Levels of the categorical columns in the test tables, in the order of ``cl.CATEGORICAL``.
LEVELS = (2, 5, 6, 5, 2)
NEWTON_STEPS = 8


def logistic_sql() -> str:
    """CTEs of the fitted model: Newton steps one after another, each solved by elimination over a list of lists.

    ``nm``: feature names in order, ``bt``: the coefficients, ``sc``: scored test rows.
    """
    names = [f"'{c}'" for c in cl.NUMERIC] + [f"'{c}_' || lv.{c}[{k}]" for c, n in zip(cl.CATEGORICAL, LEVELS) for k in range(2, n + 1)]
    raw = [f"CAST(sp.{c} AS DOUBLE)" for c in cl.NUMERIC] + [f"CAST(sp.{c} = lv.{c}[{k}] AS INTEGER)::DOUBLE" for c, n in zip(cl.CATEGORICAL, LEVELS) for k in range(2, n + 1)]
    p = len(raw) + 1
    every = range(p)
    levels = ", ".join(f"(SELECT list_sort(list(DISTINCT {c})) FROM sp) AS {c}" for c in cl.CATEGORICAL)
    parts = [f"""dg AS (SELECT *, md5('42|' || order_id || '|' || customer_id || '|' || CAST(order_date AS VARCHAR)) AS d FROM en),
tl AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.25) AS BIGINT) AS t FROM dg),
cc AS (SELECT returned, count(*) * any_value(t) // any_value(n) AS whole, count(*) * any_value(t) % any_value(n) AS rest
  FROM dg, (SELECT n, t FROM tl) GROUP BY 1),
qt AS (SELECT returned, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, returned) <= (SELECT t FROM tl) - sum(whole) OVER () THEN 1 ELSE 0 END AS want FROM cc),
sp AS (SELECT dg.*, row_number() OVER (PARTITION BY dg.returned ORDER BY d) <= want AS is_test FROM dg JOIN qt ON dg.returned = qt.returned),
lv AS (SELECT {levels}),
nm AS (SELECT [{', '.join(names)}] AS names FROM lv),
rw AS MATERIALIZED (SELECT is_test, returned::DOUBLE AS y, {', '.join(f'{r} AS r{i + 1}' for i, r in enumerate(raw))} FROM sp, lv),
mo AS MATERIALIZED (SELECT {', '.join(f'avg(r{i}) AS m{i}, coalesce(nullif(stddev_pop(r{i}), 0), 1) AS s{i}' for i in every[1:])} FROM rw WHERE NOT is_test),
xx AS MATERIALIZED (SELECT is_test, y, 1.0::DOUBLE AS x0, {', '.join(f'(r{i} - m{i}) / s{i} AS x{i}' for i in every[1:])} FROM rw, mo),
b0 AS (SELECT {', '.join(f'0.0::DOUBLE AS b{i}' for i in every)})"""]
    for k in range(1, NEWTON_STEPS + 1):
        z = " + ".join(f"x{i} * b{i}" for i in every)
        entry = lambda i, j: f"sum(w * x{min(i, j)} * x{max(i, j)})"
        rows = ", ".join("[" + ", ".join([entry(i, j) + (" + 1" if i == j and i else "") for j in every] + [f"sum((y - q) * x{i})" + (f" - any_value(b{i})" if i else "")]) + "]" for i in every)
        parts.append(f"""z{k} AS (SELECT xx.*, b{k - 1}.*, 1 / (1 + exp(-({z}))) AS q FROM xx, b{k - 1} WHERE NOT is_test),
g{k} AS MATERIALIZED (SELECT [{rows}] AS m FROM (SELECT *, q * (1 - q) AS w FROM z{k})),
e{k} AS (SELECT 1 AS k, m FROM g{k} UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN r
  ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM e{k} WHERE k <= {p}),
b{k} AS MATERIALIZED (SELECT {', '.join(f'b{i} + m[{i + 1}][{p + 1}] / m[{i + 1}][{i + 1}] AS b{i}' for i in every)} FROM e{k}, b{k - 1} WHERE k = {p + 1})""")
    z = " + ".join(f"x{i} * b{i}" for i in every)
    parts.append(f"""bt AS MATERIALIZED (SELECT * FROM b{NEWTON_STEPS}),
wt AS (SELECT unnest(names) AS feature, unnest([{', '.join(f'b{i}' for i in every[1:])}]) AS coef FROM nm, bt),
sc AS (SELECT y, 1 / (1 + exp(-({z}))) AS s FROM xx, bt WHERE is_test)""")
    return ",\n".join(parts)


LOGISTIC_SQL = logistic_sql()
add("logistic_coefficients", "feature coef:6", lambda c: cl.fit_returns(returns(c), key=KEYS)[1],
    LOGISTIC_SQL + "\n---\nSELECT feature, coef FROM wt")
add("return_model", "auc:6 accuracy:6 precision:6 recall:6 n_train:l n_test:l base_rate:6 near_chance:b",
    lambda c: cl.return_model(returns(c), key=KEYS),
    LOGISTIC_SQL + """,
rr AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM sc),
ac AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auc FROM rr),
oc AS (SELECT count(*) FILTER (WHERE y = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND s >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 1 AND s < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND s < 0.5) AS tn FROM sc)
---
SELECT auc, (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, (SELECT count(*) FROM xx WHERE NOT is_test) AS n_train,
  (SELECT count(*) FROM xx WHERE is_test) AS n_test, (SELECT avg(y) FROM xx) AS base_rate, auc < 0.6 AS near_chance FROM ac, oc""")
add("coef_extremes", "feature coef:6", lambda c: cl.coef_extremes(returns(c), key=KEYS),
    LOGISTIC_SQL + """,
ex AS (SELECT * FROM (SELECT * FROM wt ORDER BY coef, feature LIMIT 8) UNION SELECT * FROM (SELECT * FROM wt ORDER BY coef DESC, feature DESC LIMIT 8))
---
SELECT min(feature) AS feature, coef FROM ex GROUP BY coef""")
add("extremes_by_subcategory", "product_subcategory n:l",
    lambda c: extremes(c.df.groupBy("product_subcategory").count().withColumnRenamed("count", "n"), "n", "product_subcategory"),
    """x AS (SELECT product_subcategory, count(*) AS n FROM en GROUP BY 1),
ex AS (SELECT * FROM (SELECT * FROM x ORDER BY n, product_subcategory LIMIT 8) UNION
  SELECT * FROM (SELECT * FROM x ORDER BY n DESC, product_subcategory DESC LIMIT 8))
---
SELECT min(product_subcategory) AS product_subcategory, n FROM ex GROUP BY n""")

# measures of a score that SQL can rebuild: discount or price as the score
add("roc_auc", "positives:l negatives:l auc:6", lambda c: cl.roc_auc(c.flat("returned", "final_price"), "returned", "final_price"),
    """rr AS (SELECT returned, rank() OVER (ORDER BY final_price) + (count(*) OVER (PARTITION BY final_price) - 1) / 2.0 AS r FROM en),
t AS (SELECT sum(returned)::DOUBLE AS p, sum(1 - returned)::DOUBLE AS q, sum(r) FILTER (WHERE returned = 1) AS r FROM rr)
---
SELECT p AS positives, q AS negatives, (r - p * (p + 1) / 2) / (p * q) AS auc FROM t""")
ROC_SQL = """vc AS (SELECT CAST({s} AS DOUBLE) AS v, sum(returned) AS pos, sum(1 - returned) AS neg FROM en GROUP BY 1),
cu AS (SELECT v, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS spot, pos, neg, lead(pos) OVER w AS np,
  lead(neg) OVER w AS nn FROM vc WINDOW w AS (ORDER BY v DESC))
---
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr UNION ALL
SELECT v, fp / (SELECT sum(neg) FROM vc)::DOUBLE, tp / (SELECT sum(pos) FROM vc)::DOUBLE FROM cu
  WHERE spot = 1 OR np IS NULL OR np != pos OR nn != neg"""
for _s in ("discount_percentage", "final_price"):
    add(f"roc_curve_{_s}", "threshold:4 fpr:8 tpr:8", lambda c, s=_s: cl.roc_curve(c.flat("returned", s), "returned", s),
        ROC_SQL.format(s=_s))
OUTCOME_SQL = """t AS (SELECT count(*) FILTER (WHERE returned = 1 AND s >= 0.5) AS tp, count(*) FILTER (WHERE returned = 0 AND s >= 0.5) AS fp,
  count(*) FILTER (WHERE returned = 1 AND s < 0.5) AS fn, count(*) FILTER (WHERE returned = 0 AND s < 0.5) AS tn
  FROM (SELECT returned, discount_percentage / 30 AS s FROM en))
---
"""


def discount_score(c):
    return c.df.selectExpr("returned AS label", "discount_percentage / 30 AS score")


add("classification_metrics", "accuracy:6 precision:6 recall:6", lambda c: cl.classification_metrics(discount_score(c)),
    OUTCOME_SQL + "SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM t")
add("confusion_matrix", "actual:i predicted:i n:l", lambda c: cl.confusion_matrix(discount_score(c)),
    OUTCOME_SQL + """SELECT 0 AS actual, 0 AS predicted, tn AS n FROM t UNION ALL SELECT 0, 1, fp FROM t
  UNION ALL SELECT 1, 0, fn FROM t UNION ALL SELECT 1, 1, tp FROM t""")
