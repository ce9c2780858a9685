"""Registered queries: correlation, group and rank tests, normality, effect sizes, power."""

from __future__ import annotations

from tillscope.functions import special as sp
from tillscope.functions.special import DUCK
from tillscope.model import NUM_COLS, TEST_DIMS
from tillscope.operators import bootstrap as bs
from tillscope.operators import correlation as co
from tillscope.operators import group_tests as gt
from tillscope.operators import normality as nm
from tillscope.operators import power as pw
from tillscope.operators import rank_tests as rk
from tillscope.plans.catalog import Query
from tillscope.plans.reports import SAMPLE_KEYS, SAMPLE_SQL

QUERIES: list[Query] = []


def add(name, columns, run, body=None):
    QUERIES.append(Query(name, columns, run, body))


# --- correlation ------------------------------------------------------------

def matrix_sql(source, names):
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM {source}"
                              for a in names for b in names)


add("corr_matrix_pearson", "x y r:6", lambda c: co.corr_matrix(c.flat(*NUM_COLS), NUM_COLS), matrix_sql("en", NUM_COLS))
add("corr_matrix_spearman", "x y r:6", lambda c: co.corr_matrix(c.df.select(*NUM_COLS), NUM_COLS, "spearman"),
    "rk AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}" for x in NUM_COLS)
    + " FROM en)\n---\n" + matrix_sql("rk", NUM_COLS))
for _x, _y in (("product_price", "final_price"), ("quantity", "product_price")):
    add(f"pearson_test_{_x}_{_y}", "n:l r:6 p_value:6 significant:b",
        lambda c, x=_x, y=_y: co.pearson_test(c.df, x, y),
        f"""t AS (SELECT count(*) AS n, corr({_x}, {_y}) AS r FROM en)
---
SELECT *, {sp.r_pvalue('r', 'n', DUCK)} AS p_value, {sp.r_pvalue('r', 'n', DUCK)} < 0.05 AS significant FROM t""")
add("point_biserial", "variable n:l r:6 p_value:6 significant:b",
    lambda c: co.point_biserial(c.df, "returned", NUM_COLS),
    "t AS (" + " UNION ALL ".join(f"SELECT '{x}' AS variable, count(*) AS n, corr(returned, {x}) AS r FROM en" for x in NUM_COLS)
    + f""")
---
SELECT *, {sp.r_pvalue('r', 'n', DUCK)} AS p_value, {sp.r_pvalue('r', 'n', DUCK)} < 0.05 AS significant FROM t""")
add("trend_line", "point:i x:4 y:4", lambda c: co.trend_line(c.df, "product_price", "final_price"),
    """f AS (SELECT regr_slope(final_price, product_price) AS b, regr_intercept(final_price, product_price) AS a,
  min(product_price) AS lo, max(product_price) AS hi FROM en)
---
SELECT i AS point, lo + (hi - lo) * i / 99 AS x, a + b * (lo + (hi - lo) * i / 99) AS y FROM f, range(100) AS t(i)""")
add("residualise", "order_id residual:2",
    lambda c: co.residualise(c.df.select("order_id", "final_price", "product_price"), "final_price", "product_price", "residual"),
    """f AS (SELECT regr_slope(final_price, product_price) AS b, regr_intercept(final_price, product_price) AS a FROM en)
---
SELECT order_id, final_price - (a + b * product_price) AS residual FROM en, f""")
add("partial_corr", "n:l raw_r:6 raw_p:6 partial_r:6 partial_p:6 strengthens:b",
    lambda c: co.partial_corr(c.df, "discount_percentage", "final_price", "product_price"),
    f"""f AS (SELECT regr_slope(final_price, product_price) AS b, regr_intercept(final_price, product_price) AS a,
  regr_slope(discount_percentage, product_price) AS d, regr_intercept(discount_percentage, product_price) AS e FROM en),
t AS (SELECT count(*) AS n, corr(discount_percentage, final_price) AS raw_r,
  corr(discount_percentage - (e + d * product_price), final_price - (a + b * product_price)) AS partial_r FROM en, f)
---
SELECT *, {sp.r_pvalue('raw_r', 'n', DUCK)} AS raw_p, {sp.r_pvalue('partial_r', 'n', DUCK)} AS partial_p,
  abs(partial_r) > abs(raw_r) AS strengthens FROM t""")
_CORR = ", ".join("[" + ", ".join(f"corr({a}, {b})" if a != b else "1.0::DOUBLE" for b in NUM_COLS) + "]" for a in NUM_COLS)
_NAMES = ", ".join(f"'{x}'" for x in NUM_COLS)
add("vif", "variable vif:4 flag", lambda c: co.vif(c.flat(*NUM_COLS), NUM_COLS),
    f"""sw(k, m) AS (SELECT 0, [{_CORR}] FROM en UNION ALL SELECT k + 1, list_transform(range(1, 9), lambda i: list_transform(
  range(1, 9), lambda j: CASE WHEN i = k + 1 AND j = k + 1 THEN -1 / m[k + 1][k + 1]
    WHEN i = k + 1 OR j = k + 1 THEN m[i][j] / m[k + 1][k + 1]
    ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM sw WHERE k < 8),
v AS (SELECT [{_NAMES}][i] AS variable, -m[i][i] AS vif FROM sw, range(1, 9) AS r(i) WHERE k = 8)
---
SELECT *, CASE WHEN vif >= 10 THEN 'High' WHEN vif >= 5 THEN 'Moderate' ELSE 'OK' END AS flag FROM v""")

# --- group tests ------------------------------------------------------------

P_F = sp.f_sf("f_stat", "df1", "df2", DUCK)


def anova_sql(by, value, source="en", stat="f_stat"):
    return f"""g AS (SELECT {by}, count(*) AS n, avg({value}) AS mean, var_pop({value}) AS vp FROM {source} GROUP BY ALL),
t AS (SELECT *, k - 1 AS df1, n - k AS df2, (ssb / (k - 1)) / (ssw / (n - k)) AS f_stat FROM (SELECT count(*) AS k,
  CAST(sum(n) AS BIGINT) AS n, sum(n * power(mean - (SELECT avg({value}) FROM {source}), 2)) AS ssb, sum(n * vp) AS ssw FROM g))
---
SELECT *, f_stat AS {stat if stat != 'f_stat' else 'f_again'}, {P_F} AS p_value, {P_F} < 0.05 AS significant,
  ssb / (ssb + ssw) AS eta_squared FROM t"""


ANOVA_COLS = "k:l n:l f_stat:4 p_value:6 eta_squared:8 significant:b"
for _by in TEST_DIMS:
    add(f"anova_final_price_by_{_by}", ANOVA_COLS,
        lambda c, by=_by: gt.anova(c.flat(by, "final_price") if by == "price_bucket" else c.df, by),
        anova_sql(_by, "final_price"))
add("anova_discount_by_category", ANOVA_COLS, lambda c: gt.anova(c.df, "product_category", "discount_percentage"),
    anova_sql("product_category", "discount_percentage"))
add("anova_cells", ANOVA_COLS, lambda c: gt.anova_cells(c.df), anova_sql("product_category, customer_segment", "final_price"))


def chi2_sql(by):
    p = sp.chi2_sf("chi2", "dof", DUCK)
    return f"""cell AS (SELECT {by} AS a, return_status AS b, count(*) AS n FROM en GROUP BY 1, 2),
grid AS (SELECT ra.a, cb.b, ra.n * cb.n / (SELECT CAST(count(*) AS DOUBLE) FROM en) AS e, coalesce(cell.n, 0) AS o
  FROM (SELECT a, sum(n) AS n FROM cell GROUP BY 1) AS ra CROSS JOIN (SELECT b, sum(n) AS n FROM cell GROUP BY 1) AS cb
  LEFT JOIN cell ON cell.a = ra.a AND cell.b = cb.b),
sz AS (SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM grid),
t AS (SELECT sum(o) AS n, r, c, (r - 1) * (c - 1) AS dof, sum(CASE WHEN (r - 1) * (c - 1) = 1
  THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS chi2,
  sqrt(sum(power(o - e, 2) / e) / (sum(o) * (least(r, c) - 1))) AS cramers_v FROM grid, sz GROUP BY r, c)
---
SELECT *, {p} AS p_value, {p} < 0.05 AS significant FROM t"""


for _by in TEST_DIMS:
    add(f"chi2_return_status_by_{_by}", "n:l dof:l chi2:4 p_value:6 cramers_v:8 significant:b",
        lambda c, by=_by: gt.chi2_independence(c.full if by == "price_bucket" else c.df, by), chi2_sql(_by))
for _by in TEST_DIMS:
    _p = sp.chi2_sf("chi2", "dof", DUCK)
    add(f"chi2_uniform_{_by}", "k:l chi2:4 max_dev_pct:6 dof:l p_value:6 significant:b",
        lambda c, by=_by: gt.chi2_uniform(c.full if by == "price_bucket" else c.df, by),
        f"""o AS (SELECT {_by}, count(*) AS o, sum(count(*)) OVER () / CAST(count(*) OVER () AS DOUBLE) AS e FROM en GROUP BY 1),
t AS (SELECT count(*) AS k, count(*) - 1 AS dof, sum(power(o - e, 2) / e) AS chi2, max(abs(o - e) / e * 100) AS max_dev_pct FROM o)
---
SELECT *, {_p} AS p_value, {_p} < 0.05 AS significant FROM t""")
add("chi2_uniform_table", "level observed:l expected:4 deviation_pct:6", lambda c: gt.uniform_table(c.df, "product_category"),
    """o AS (SELECT product_category AS level, count(*) AS observed,
  sum(count(*)) OVER () / CAST(count(*) OVER () AS DOUBLE) AS expected FROM en GROUP BY 1)
---
SELECT *, (observed - expected) / expected * 100 AS deviation_pct FROM o""")
for _by, _value in (("product_category", "final_price"), ("customer_segment", "final_price"), ("state", "quantity")):
    add(f"levene_{_value}_by_{_by}", "k:l n:l w_stat:4 p_value:6 significant:b",
        lambda c, by=_by, v=_value: gt.levene(c.flat(by, v), by, v),
        f"""md AS (SELECT {_by} AS gr, median({_value}) AS m FROM en GROUP BY 1),
dz AS (SELECT {_by} AS gr, abs({_value} - m) AS z FROM en JOIN md ON gr = {_by}),
""" + anova_sql("gr", "z", "dz", "w_stat"))
for _by in (None, "product_category", "state"):
    _key = f"{_by}, " if _by else ""
    _p = sp.r_pvalue("r", "months", DUCK)
    _trend = f"""ms AS (SELECT *, row_number() OVER ({'PARTITION BY ' + _by if _by else ''} ORDER BY order_month) - 1 AS idx
  FROM (SELECT {_key}order_month, sum(final_price) AS revenue FROM en GROUP BY ALL)),
t AS (SELECT {_key}count(*) AS months, regr_slope(revenue, idx) AS slope, regr_intercept(revenue, idx) AS intercept,
  corr(revenue, idx) AS r FROM ms GROUP BY ALL HAVING count(*) >= 3),
p AS (SELECT *, r * r AS r2, {_p} AS p_value, {_p} < 0.05 AS significant FROM t)
---
"""
    add(f"trend_test{'_by_' + _by if _by else ''}", f"{_by or ''} months:l slope:4 intercept:2 r2:6 p_value:6 significant:b",
        lambda c, by=_by: gt.trend_test(c.df, by), _trend + "SELECT * FROM p")
    if _by:
        add(f"trend_count_by_{_by}", "significant:l series:l", lambda c, by=_by: gt.trend_count(c.df, by),
            _trend + "SELECT count(*) FILTER (WHERE significant) AS significant, count(*) AS series FROM p")

# the battery: every dimension × {ANOVA, χ²}
_P_CHI = sp.chi2_sf("stat", "df1", DUCK)
_P_ANOVA = sp.f_sf("stat", "df1", "df2", DUCK)
FDR_SQL = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS dim, CAST({x} AS VARCHAR) AS lev, return_status AS b, final_price AS v FROM en" for x in TEST_DIMS) + """),
gm AS (SELECT dim, avg(v) AS gm FROM lv GROUP BY 1),
gl AS (SELECT dim, lev, count(*) AS n, avg(v) AS mean, var_pop(v) AS vp FROM lv GROUP BY 1, 2),
fa AS (SELECT 'ANOVA: final_price ~ ' || dim AS test, count(*) - 1 AS df1, CAST(sum(n) AS BIGINT) - count(*) AS df2,
  (sum(n * power(mean - gm, 2)) / (count(*) - 1)) / (sum(n * vp) / (sum(n) - count(*))) AS stat
  FROM gl JOIN gm USING (dim) GROUP BY dim),
cl AS (SELECT dim, lev, b, count(*) AS n FROM lv GROUP BY 1, 2, 3),
gr AS (SELECT l.dim, l.lev, s.b, l.n * s.n / CAST(t.n AS DOUBLE) AS e, coalesce(cl.n, 0) AS o, t.k FROM
  (SELECT dim, lev, sum(n) AS n FROM cl GROUP BY 1, 2) AS l JOIN (SELECT dim, b, sum(n) AS n FROM cl GROUP BY 1, 2) AS s USING (dim)
  JOIN (SELECT dim, sum(n) AS n, count(DISTINCT lev) AS k FROM cl GROUP BY 1) AS t USING (dim)
  LEFT JOIN cl ON cl.dim = l.dim AND cl.lev = l.lev AND cl.b = s.b),
ch AS (SELECT 'Chi-square: return_status ~ ' || dim AS test, k - 1 AS df1, 0 AS df2, sum(CASE WHEN k = 2
  THEN power(abs(o - e) - least(0.5, abs(o - e)), 2) / e ELSE power(o - e, 2) / e END) AS stat FROM gr GROUP BY dim, k),
""" + f"""pv AS (SELECT test, stat, {_P_ANOVA} AS p FROM fa UNION ALL SELECT test, stat, {_P_CHI} AS p FROM ch),
rk AS (SELECT *, row_number() OVER (ORDER BY p, test) AS rn, count(*) OVER () AS m FROM pv),
bh AS (SELECT test, stat AS statistic, p AS p_value, least(1, min(p * m / rn) OVER (ORDER BY rn DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM rk),
fd AS (SELECT *, p_value < 0.05 AS significant_raw, p_adjusted < 0.05 AS significant_bh FROM bh)
---
"""
_BATTERY = (*TEST_DIMS, "final_price", "return_status")
add("fdr_battery", "test statistic:4 p_value:6 p_adjusted:6 significant_raw:b significant_bh:b",
    lambda c: gt.fdr_battery(c.flat(*_BATTERY), TEST_DIMS), FDR_SQL + "SELECT * FROM fd")
add("fdr_counts", "tests:l significant_raw:l significant_bh:l", lambda c: gt.fdr_counts(c.flat(*_BATTERY), TEST_DIMS),
    FDR_SQL + """SELECT count(*) AS tests, count(*) FILTER (WHERE significant_raw) AS significant_raw,
  count(*) FILTER (WHERE significant_bh) AS significant_bh FROM fd""")
add("benjamini_hochberg", "variable p_value:6 p_adjusted:6",
    lambda c: gt.bh_adjust(co.point_biserial(c.df, "returned", NUM_COLS), "p_value", ["variable"]),
    "t AS (" + " UNION ALL ".join(f"SELECT '{x}' AS variable, count(*) AS n, corr(returned, {x}) AS r FROM en" for x in NUM_COLS)
    + f"""),
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, variable) AS rn, count(*) OVER () AS m FROM
  (SELECT variable, {sp.r_pvalue('r', 'n', DUCK)} AS p_value FROM t))
---
SELECT variable, p_value, least(1, min(p_value * m / rn) OVER (ORDER BY rn DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_adjusted FROM rk""")

# --- rank tests -------------------------------------------------------------

_P_KW = sp.chi2_sf("h_stat", "(k - 1)", DUCK)
for _by in ("product_category", "shipping_type", "city"):
    add(f"kruskal_by_{_by}", "k:l n:l h_stat:4 p_value:6 significant:b",
        lambda c, by=_by: rk.kruskal(c.flat(by, "final_price"), by),
        f"""rr AS (SELECT {_by} AS g, rank() OVER (ORDER BY final_price) + (count(*) OVER (PARTITION BY final_price) - 1) / 2.0 AS r FROM en),
ti AS (SELECT sum(power(c::DOUBLE, 3) - c) AS s FROM (SELECT count(*) AS c FROM en GROUP BY final_price)),
nn AS (SELECT count(*)::DOUBLE AS n FROM en),
t AS (SELECT count(*) AS k, any_value(nn.n) AS n, (12 / (any_value(nn.n) * (any_value(nn.n) + 1)) * sum(q) - 3 * (any_value(nn.n) + 1))
  / (1 - any_value(s) / (power(any_value(nn.n), 3) - any_value(nn.n))) AS h_stat
  FROM (SELECT g, power(sum(r), 2) / count(*) AS q FROM rr GROUP BY 1), nn, ti)
---
SELECT *, {_P_KW} AS p_value, {_P_KW} < 0.05 AS significant FROM t""")
GROUP_A, GROUP_B = "ECONOMY", "LARGE"
_P_MW = sp.normal_two_sided("z", DUCK)
for _value in ("final_price", "quantity"):
    add(f"mann_whitney_{_value}", "n_a:l n_b:l u_stat:1 p_value:6 significant:b",
        lambda c, v=_value: rk.mann_whitney(c.df.select("product_category", v), "product_category", GROUP_A, GROUP_B, v),
        f"""ab AS (SELECT product_category AS g, {_value} AS v FROM en WHERE product_category IN ('{GROUP_A}', '{GROUP_B}')),
rr AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM ab),
ti AS (SELECT sum(power(c::DOUBLE, 3) - c) AS s FROM (SELECT count(*) AS c FROM ab GROUP BY v)),
u AS (SELECT count(*) FILTER (WHERE g = '{GROUP_A}')::DOUBLE AS a, count(*) FILTER (WHERE g = '{GROUP_B}')::DOUBLE AS b,
  sum(r) FILTER (WHERE g = '{GROUP_A}') AS ra FROM rr),
t AS (SELECT a AS n_a, b AS n_b, ra - a * (a + 1) / 2 AS u_stat, greatest(0, abs(ra - a * (a + 1) / 2 - a * b / 2) - 0.5)
  / sqrt(a * b / 12 * (a + b + 1 - s / ((a + b) * (a + b - 1)))) AS z FROM u, ti)
---
SELECT *, {_P_MW} AS p_value, {_P_MW} < 0.05 AS significant FROM t""")
    _p_ks = sp.kolmogorov_sf("((sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * d_stat)", DUCK)
    for _name, _a, _b in ((f"ks_2samp_{_value}", GROUP_A, GROUP_B), (f"ks_2samp_{_value}_promo_small", "PROMO", "SMALL")):
        # up to 10,000 rows a side: the share of orders that reach the distance, by diagonals of a band
        add(_name, "n_a:l n_b:l d_stat:6 p_value:6 significant:b",
            lambda c, v=_value, a=_a, b=_b: rk.ks_2samp(c.flat("product_category", v), "product_category", a, b, v),
            f"""vc AS (SELECT {_value} AS v, count(*) FILTER (WHERE product_category = '{_a}') AS a,
  count(*) FILTER (WHERE product_category = '{_b}') AS b FROM en WHERE product_category IN ('{_a}', '{_b}') GROUP BY 1),
cu AS (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM vc),
t AS (SELECT any_value(ta)::DOUBLE AS n_a, any_value(tb)::DOUBLE AS n_b, max(abs(ca / ta::DOUBLE - cb / tb::DOUBLE)) AS d_stat,
  max(abs(ca * tb - cb * ta))::DOUBLE AS h FROM cu),
dg AS (SELECT 0::BIGINT AS s, 0::BIGINT AS lo, [0.0::DOUBLE] AS v UNION ALL
  SELECT s + 1, first, list_transform(range(first, last + 1), lambda i: least(1.0, greatest(0.0,
    (CASE WHEN i - 1 BETWEEN lo AND lo + len(v) - 1 THEN v[i - lo] ELSE 1.0 END) * i / (s + 1) +
    (CASE WHEN i BETWEEN lo AND lo + len(v) - 1 THEN v[i - lo + 1] ELSE 1.0 END) * (s + 1 - i) / (s + 1))))
  FROM (SELECT s, lo, v, floor(((s + 1) * n_a - h) / (n_a + n_b))::BIGINT + 1 AS first, ceil(((s + 1) * n_a + h) / (n_a + n_b))::BIGINT - 1 AS last
    FROM dg, t WHERE s < n_a + n_b AND greatest(n_a, n_b) <= 10000 AND h > 0)),
pv AS (SELECT CASE WHEN h = 0 THEN 1.0 WHEN greatest(n_a, n_b) <= 10000
  THEN coalesce((SELECT v[n_a::BIGINT - lo + 1] FROM dg WHERE s = n_a + n_b), 1.0) ELSE {_p_ks} END AS p_value, n_a, n_b, d_stat FROM t)
---
SELECT n_a, n_b, d_stat, p_value, p_value < 0.05 AS significant FROM pv""")

# --- normality --------------------------------------------------------------

_SW = f"""sa AS ({SAMPLE_SQL.format(seed=42, n=5000)}),
sc AS (SELECT final_price AS x, row_number() OVER (ORDER BY final_price) AS i, count(*) OVER ()::DOUBLE AS n FROM sa),
sm AS (SELECT *, {sp.normal_quantile('(i - 0.375e0) / (n + 0.25e0)', DUCK)} AS m FROM sc),
su AS (SELECT *, sum(m * m) OVER () AS mm, max(m) OVER () AS m1, max(CASE WHEN i = n - 1 THEN m END) OVER () AS m2,
  1e0 / sqrt(n) AS u FROM sm),
sb AS (SELECT *, {sp.horner(nm.W_LAST, 'u')} + m1 / sqrt(mm) AS a1, {sp.horner(nm.W_SECOND, 'u')} + m2 / sqrt(mm) AS a2 FROM su),
sf AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS fac FROM sb),
sd AS (SELECT *, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / fac END AS a FROM sf),
sw AS (SELECT max(n) AS n, power(sum(a * x), 2) / (var_pop(x) * count(*)) AS w_stat FROM sd),
sz AS (SELECT *, (ln(1 - w_stat) - {sp.horner(nm.LARGE_MEAN, 'ln(n)')}) / exp({sp.horner(nm.LARGE_LOG_SD, 'ln(n)')}) AS z FROM sw)"""
_P_SW = sp.normal_upper("z", DUCK)
_PRICE_SAMPLE = ("order_id", "customer_id", "order_date", "quantity", "product_price", "discount_percentage", "final_price")
add("shapiro_wilk", "n:l w_stat:6 p_value:6",
    lambda c: nm.shapiro_wilk(c.df.select(*_PRICE_SAMPLE), "final_price", 42, SAMPLE_KEYS),
    _SW + f"\n---\nSELECT n, w_stat, {_P_SW} AS p_value FROM sz")
_K2 = f"""km AS (SELECT count(*) AS rows, count(*)::DOUBLE AS n, avg(final_price) AS mu, var_pop(final_price) AS v FROM en),
kg AS (SELECT rows, n, avg(power(final_price - mu, 3)) / power(v, 1.5) AS g1, avg(power(final_price - mu, 4)) / (v * v) - 3 AS g2
  FROM en, km GROUP BY rows, n, v),
kz AS (SELECT *, {nm.skew_z('n', 'g1')} AS zs, {nm.kurtosis_z('n', 'g2')} AS zk FROM kg)"""
add("dagostino_k2", "n:l k2_stat:4 p_value:6", lambda c: nm.dagostino_k2(c.df, "final_price"),
    _K2 + "\n---\nSELECT rows AS n, zs * zs + zk * zk AS k2_stat, exp(-(zs * zs + zk * zk) / 2) AS p_value FROM kz")
add("normality", "w_stat:6 shapiro_p:6 k2_stat:4 k2_p:6 rejected:b",
    lambda c: nm.normality(c.df.select(*_PRICE_SAMPLE), "final_price", 42, SAMPLE_KEYS),
    _SW + ",\n" + _K2 + f"""
---
SELECT w_stat, {_P_SW} AS shapiro_p, zs * zs + zk * zk AS k2_stat, exp(-(zs * zs + zk * zk) / 2) AS k2_p,
  {_P_SW} < 0.05 OR exp(-(zs * zs + zk * zk) / 2) < 0.05 AS rejected FROM sz, kz""")
add("qq_points", "position:l quantile:6 value:4 reference:4", lambda c: nm.qq_points(c.flat("final_price"), "final_price"),
    f"""qp AS (SELECT final_price AS value, row_number() OVER (ORDER BY final_price) AS position, count(*) OVER ()::DOUBLE AS n,
  stddev_pop(final_price) OVER () AS sd, avg(final_price) OVER () AS mean FROM en),
qm AS (SELECT *, CASE WHEN position = n THEN power(0.5, 1 / n) WHEN position = 1 THEN 1 - power(0.5, 1 / n)
  ELSE (position - 0.3175) / (n + 0.365) END AS p FROM qp),
qq AS (SELECT *, {sp.normal_quantile('p', DUCK)} AS quantile FROM qm)
---
SELECT position, quantile, value, mean + quantile * sd AS reference FROM qq""")

# --- effect sizes and power -------------------------------------------------

add("effect_sizes", "eta_squared:8 cramers_v:8", lambda c: gt.effect_sizes(c.flat("product_category", "final_price", "return_status"), "product_category"),
    """ce AS (SELECT product_category AS a, return_status AS b, count(*) AS o, sum(count(*)) OVER (PARTITION BY product_category)
  * sum(count(*)) OVER (PARTITION BY return_status) / sum(count(*)) OVER ()::DOUBLE AS e FROM en GROUP BY 1, 2),
ge AS (SELECT count(*) AS n, avg(final_price) AS m FROM en GROUP BY product_category)
---
SELECT (SELECT sum(n * power(m - (SELECT avg(final_price) FROM en), 2)) FROM ge) / (SELECT var_pop(final_price) * count(*) FROM en)
  AS eta_squared, (SELECT sqrt(sum(power(o - e, 2) / e) / sum(o)) FROM ce) AS cramers_v""")
add("bootstrap_cramers_v", "replicates:l point:8 ci_low:8 ci_high:8 plug_in:8",
    lambda c: bs.bootstrap_effect(c.flat("product_category", "return_status"), "product_category"))
add("bootstrap_eta_squared", "replicates:l point:8 ci_low:8 ci_high:8 plug_in:8",
    lambda c: bs.bootstrap_effect(c.flat("product_category", "final_price"), "product_category", "eta_squared"))
_SIZES = "sz AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS category, count(*)::DOUBLE AS n, count(DISTINCT {x})::DOUBLE AS k FROM en" for x in TEST_DIMS) + """),
dg AS (SELECT *, k - 1 AS df1, n - k AS df2, 1.2e0 AS f_crit FROM sz)"""
# the engine bisects; here Newton steps find the critical value and secant steps the detectable effect
for _i in range(12):
    _density = ("exp(df1 / 2 * ln(df1 * f_crit / (df2 + df1 * f_crit)) + df2 / 2 * ln(df2 / (df2 + df1 * f_crit)) - "
                + sp.log_beta("df1 / 2", "df2 / 2", DUCK) + ") / f_crit")
    _prev = "dg" if _i == 0 else f"n{_i - 1}"
    _SIZES += (f",\nn{_i} AS (SELECT * REPLACE (f_crit + ({sp.f_sf('f_crit', 'df1', 'df2', DUCK)} - 0.05) / ({_density}) "
               f"AS f_crit) FROM {_prev})")
_SIZES += f""",
e0 AS (SELECT *, sqrt(8 / n) AS fa, sqrt(12 / n) AS fb FROM n11),
e1 AS (SELECT *, {pw.anova_power('fa', DUCK)} - 0.8 AS ga, {pw.anova_power('fb', DUCK)} - 0.8 AS gb FROM e0)"""
for _i in range(2, 12):
    _SIZES += (f",\nx{_i} AS (SELECT *, coalesce(fb - gb * (fb - fa) / nullif(gb - ga, 0), fb) AS fc FROM e{_i - 1}),"
               f"\ne{_i} AS (SELECT * EXCLUDE (fc) REPLACE (fb AS fa, gb AS ga, fc AS fb, {pw.anova_power('fc', DUCK)} - 0.8 AS gb) FROM x{_i})")
_SIZES += ",\nmd AS (SELECT *, fb AS mde FROM e11)"
add("detectable_effects", "category n:l k:l f_crit:6 mde:6 mde_eta_squared:8",
    lambda c: pw.detectable_effects(c.flat(*TEST_DIMS), TEST_DIMS),
    _SIZES + "\n---\nSELECT *, mde * mde / (1 + mde * mde) AS mde_eta_squared FROM md")
add("anova_power_table", "category n:l k:l mde:6 point:i cohens_f:6 power:6",
    lambda c: pw.anova_power_table(c.flat(*TEST_DIMS), TEST_DIMS),
    _SIZES + f""",
gp AS (SELECT *, CAST(i AS INTEGER) AS point, 0.001 + (greatest(0.15, coalesce(2 * mde, 0.15)) - 0.001) * i / 99 AS cohens_f
  FROM md, range(100) AS r(i))
---
SELECT *, {pw.anova_power('cohens_f', DUCK)} AS power FROM gp""")
