"""Registered queries: sources, columns, slices, aggregates, pivots, series, quality, RFM."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillscope.functions import sketches as sk
from tillscope.functions.memo import memoised
from tillscope.functions.staging import shared_path, shuffles_dropped, stage
from tillscope.model import FILTER_COLS, NUM_COLS
from tillscope.operators import metrics as m
from tillscope.operators import outliers as o
from tillscope.operators import pivots as p
from tillscope.operators import quality as dq
from tillscope.operators import rfm
from tillscope.operators import sampling as smp
from tillscope.operators import series as ts
from tillscope.operators import slices as sl
from tillscope.plans.catalog import Query
from tillscope.sources.inferred import read_inferred
from tillscope.sources.star import star_parts
from tillscope.sources.transactions import export_slice, read_transactions

YEAR = ("1998-01-01", "1998-12-31")
SLICE = dict(date_range=("1996-01-01", "1999-12-31"), age_range=(25, 55),
             choices={"customer_segment": ["BUILDING", "MACHINERY", "AUTOMOBILE"], "gender": ["F"]})
SLICE_SQL = """order_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND age BETWEEN 25 AND 55
  AND customer_segment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND gender = 'F'"""
RAW_COLS = ("order_id customer_id order_date:d age:i gender customer_segment product_category "
            "product_subcategory product_price:8 quantity:i discount_percentage:2 final_price:4 "
            "payment_method shipping_type delivery_days:2 return_status state city")
SAMPLE_ORDER = ("order_date", "order_id", "customer_id", "product_price", "quantity", "final_price")

QUERIES: list[Query] = []


def add(name, columns, run, body=None):
    QUERIES.append(Query(name, columns, run, body))


# --- sources and sinks ------------------------------------------------------

add("transactions", RAW_COLS, lambda c: c.raw, "SELECT * FROM tx")


def csv_round_trip(c, df):
    path = shared_path(c.spark, "csv")
    export_slice(df, path)
    schema = df.schema
    return read_transactions(c.spark, path, "csv", schema)


def inferred_round_trip(c):
    path = shared_path(c.spark, "csv")
    with shuffles_dropped(c.spark):
        for part in star_parts(c.spark, c.folder):
            export_slice(part, path, "append", "gzip")
    return read_inferred(c.spark, path).rows


add("csv_scan", RAW_COLS, lambda c: csv_round_trip(c, c.raw), "SELECT * FROM tx")
add("csv_inferred", "order_id order_date:d age:i quantity:i product_price:8 discount_percentage:2 final_price:4 return_status state", inferred_round_trip, "SELECT * FROM tx")
add("export_slice", RAW_COLS + " returned:i age_group disc_bucket order_month high_value:i price_bucket",
    lambda c: csv_round_trip(c, sl.slice_rows(c.full, **SLICE)), f"SELECT * FROM en WHERE {SLICE_SQL}")

# --- derived columns --------------------------------------------------------

for _col, _src in {
    "returned:i": "return_status", "age_group": "age:i", "disc_bucket": "discount_percentage:2",
    "order_month": "order_date:d", "order_quarter": "order_date:d", "order_year:i": "order_date:d",
    "order_dow": "order_date:d", "order_dom:i": "order_date:d", "high_value:i": "final_price:4",
    "revenue_per_unit:9": "final_price:4", "discount_impact:4": "final_price:4",
    "price_bucket": "product_price:8",
}.items():
    add(f"enrich_{_col.partition(':')[0]}", f"order_id customer_id {_src} {_col}",
        lambda c, x=_col: c.full if x in ("high_value:i", "price_bucket") else c.df, "SELECT * FROM en")

_WANTED = NUM_COLS + ("customer_id", "cust_id")
_ABSENT = ("revenue_per_unit", "discount_impact", "cust_id")
add("schema_discovery", "column present:b values:l levels:l", lambda c: dq.dq_columns(c.raw, _WANTED),
    " UNION ALL ".join(f"SELECT '{x}' AS \"column\", false AS present, 0 AS \"values\", 0 AS levels" if x in _ABSENT else
                       f"SELECT '{x}', true, count({x}), count(DISTINCT {x}) FROM tx" for x in sorted(_WANTED, key=lambda x: x not in _ABSENT)))

# --- slices and KPIs --------------------------------------------------------

add("slice", RAW_COLS, lambda c: sl.slice_rows(c.df, **SLICE), f"SELECT * FROM en WHERE {SLICE_SQL}")
add("slice_empty_list", "order_id final_price:4",
    lambda c: sl.slice_rows(c.df, choices={"gender": []}), "SELECT * FROM en WHERE false")
add("filter_domains", "date_min:d date_max:d age_min:i age_max:i " + " ".join(FILTER_COLS),
    lambda c: sl.filter_domains(c.df).withColumns(
        {x: m.F.concat_ws(",", x) for x in FILTER_COLS}),
    "SELECT min(order_date) AS date_min, max(order_date) AS date_max, min(age) AS age_min, max(age) AS age_max, "
    + ", ".join(f"string_agg(DISTINCT {x}, ',' ORDER BY {x}) AS {x}" for x in FILTER_COLS) + " FROM en")
add("prev_period_slice", "order_id order_date:d final_price:4",
    lambda c: sl.prev_period_slice(c.df, *YEAR),
    "SELECT * FROM en WHERE order_date BETWEEN DATE '1998-01-01' - 365 AND DATE '1997-12-31'")
add("slice_counts", "shown:l total:l", lambda c: sl.slice_counts(c.df, **SLICE),
    f"SELECT count(*) FILTER (WHERE {SLICE_SQL}) AS shown, count(*) AS total FROM en")

KPI_SQL = """SELECT sum(final_price) AS revenue, count(*) AS orders, avg(final_price) AS aov,
  avg(returned) * 100 AS return_rate, avg(delivery_days) AS delivery_days FROM en"""
add("kpi", "revenue:0 orders:l aov:4 return_rate:6 delivery_days:6", lambda c: sl.kpi(c.df), KPI_SQL)
add("kpi_delta", "revenue:0 orders:l aov:4 return_rate:6 delivery_days:6 revenue_delta:6 orders_delta:6 "
    "aov_delta:6 return_rate_delta:6 delivery_days_delta:6",
    lambda c: sl.kpi_delta(c.df, *YEAR),
    f"""cur AS ({KPI_SQL} WHERE order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'),
prev AS ({KPI_SQL} WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31')
---
SELECT cur.*, (cur.revenue - prev.revenue) / prev.revenue * 100 AS revenue_delta,
  (cur.orders - prev.orders) / prev.orders * 100 AS orders_delta, (cur.aov - prev.aov) / prev.aov * 100 AS aov_delta,
  cur.return_rate - prev.return_rate AS return_rate_delta,
  cur.delivery_days - prev.delivery_days AS delivery_days_delta FROM cur, prev""")

# --- aggregates -------------------------------------------------------------

add("monthly_revenue", "order_month revenue:4 orders:l", lambda c: m.monthly_revenue(c.df),
    "SELECT order_month, sum(final_price) AS revenue, count(order_id) AS orders FROM en GROUP BY 1")
add("monthly_return_rate", "order_month return_rate:6", lambda c: m.monthly_return_rate(c.df),
    "SELECT order_month, avg(returned) * 100 AS return_rate FROM en GROUP BY 1")
for _name, _by in (("segment_counts", "customer_segment"), ("category_counts", "product_category")):
    add(_name, "level n:l", lambda c, by=_by: m.level_counts(c.df, by),
        f"SELECT {_by} AS level, count(*) AS n FROM en GROUP BY 1")

CI_SQL = """SELECT {by}, avg({v}) AS mean, stddev_samp({v}) AS sd, count({v}) AS n,
  stddev_samp({v}) / sqrt(count({v})) AS sem, coalesce(1.96 * stddev_samp({v}) / sqrt(count({v})), 0) AS ci95,
  median({v}) AS median FROM en GROUP BY 1"""
add("monthly_aov_ci", "order_month mean:4 sd:4 n:l sem:4 ci95:4", lambda c: m.monthly_aov_ci(c.df),
    CI_SQL.format(by="order_month", v="final_price"))
add("state_price_ci", "state mean:4 sd:4 n:l ci95:4", lambda c: m.state_price_ci(c.df),
    CI_SQL.format(by="state", v="final_price"))
for _by in FILTER_COLS:
    add(f"group_spend_by_{_by}", f"{_by} mean:4 median:4 sd:4 n:l sem:4 ci95:4",
        lambda c, by=_by: m.group_spend(c.flat(by, "final_price"), by), CI_SQL.format(by=_by, v="final_price"))
add("dow_revenue", "pos:i day revenue:0", lambda c: m.dow_revenue(c.df),
    """SELECT pos, day, sum(final_price) AS revenue FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'),
  (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) AS s(pos, day) LEFT JOIN en ON order_dow = day
  GROUP BY 1, 2""")
add("dom_revenue", "order_dom:i revenue:0", lambda c: m.dom_revenue(c.df),
    "SELECT order_dom, sum(final_price) AS revenue FROM en GROUP BY 1")
add("daily_revenue", "date:d revenue:4", lambda c: m.daily_revenue(c.df),
    "SELECT order_date AS date, sum(final_price) AS revenue FROM en GROUP BY 1")
add("numeric_summary", "column mean:4 median:4 sd:4 skewness:6 kurtosis:4 min:4 max:4",
    lambda c: m.numeric_summary(c.flat(*NUM_COLS), NUM_COLS),
    " UNION ALL ".join(
        f"""SELECT '{x}' AS "column", avg({x}) AS mean, median({x}) AS median, stddev_samp({x}) AS sd,
  skewness({x}) AS skewness, kurtosis({x}) AS kurtosis, min({x}) AS min, max({x}) AS max FROM en""" for x in NUM_COLS))
SHARE_SQL = "SELECT {by} AS level, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM {t} GROUP BY 1"
for _by in ("customer_segment", "gender", "product_category", "payment_method", "shipping_type", "price_bucket",
            "return_status"):
    add(f"category_share_{_by}", "level n:l pct:6", lambda c, by=_by: m.category_share(c.full if by == "price_bucket" else c.df, by),
        SHARE_SQL.format(by=_by, t="en"))
RATE_SQL = "SELECT {by}, avg(returned) * 100 AS return_rate FROM en GROUP BY 1"
for _by in FILTER_COLS + ("state", "city"):
    add(f"return_rate_by_{_by}", f"{_by} return_rate:6", lambda c, by=_by: m.return_rate_by(c.df, by),
        RATE_SQL.format(by=_by))
add("high_value_profile", "orders avg_final_price:4 avg_quantity:6 avg_discount:6 return_rate:6 n:l",
    lambda c: m.high_value_profile(c.full),
    """SELECT CASE WHEN high_value = 1 THEN 'High-Value (top 10%)' ELSE 'Regular (bottom 90%)' END AS orders,
  avg(final_price) AS avg_final_price, avg(quantity) AS avg_quantity, avg(discount_percentage) AS avg_discount,
  avg(returned) * 100 AS return_rate, count(final_price) AS n FROM en GROUP BY 1""")
SUMMARY_SQL = """SELECT {by}, count(order_id) AS orders, sum(final_price) AS revenue, avg(final_price) AS avg_spend,
  avg(returned) * 100 AS return_rate FROM en GROUP BY 1"""
add("subcategory_performance", "product_subcategory orders:l revenue:0 return_rate:6",
    lambda c: m.group_summary(c.df, "product_subcategory"), SUMMARY_SQL.format(by="product_subcategory"))
add("segment_summary", "customer_segment orders:l revenue:0 avg_spend:4 return_rate:6",
    lambda c: m.group_summary(c.df, "customer_segment"), SUMMARY_SQL.format(by="customer_segment"))
for _by in ("state", "city"):
    add(f"{_by}_share", f"{_by} revenue:0 share:6 even_share:6", lambda c, by=_by: m.revenue_share(c.df, by),
        f"""SELECT {_by}, sum(final_price) AS revenue, sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share,
  100.0 / count(*) OVER () AS even_share FROM en GROUP BY 1""")
add("geo_artifact", "top_state top_share:6 top_cities:l city_list n_cities:l city_spread:6 artifact:b",
    lambda c: m.geo_artifact(c.df),
    """st AS (SELECT state, sum(final_price) AS r, sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share
  FROM en GROUP BY 1),
ct AS (SELECT city, sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share FROM en GROUP BY 1),
top AS (SELECT * FROM st ORDER BY r DESC, state DESC LIMIT 1)
---
SELECT top.state AS top_state, top.share AS top_share,
  (SELECT count(DISTINCT city) FROM en WHERE state = top.state) AS top_cities,
  (SELECT string_agg(DISTINCT city, ', ' ORDER BY city) FROM en WHERE state = top.state) AS city_list,
  (SELECT count(*) FROM ct) AS n_cities,
  (SELECT max(abs(share - (SELECT avg(share) FROM ct))) FROM ct) AS city_spread,
  (SELECT count(DISTINCT city) FROM en WHERE state = top.state) > 1 AS artifact FROM top""")
add("category_revenue", "product_category revenue:0 share:6", lambda c: m.revenue_share(c.df, "product_category"),
    """SELECT product_category, sum(final_price) AS revenue,
  sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share FROM en GROUP BY 1""")
add("payment_revenue", "payment_method revenue:0 share:6", lambda c: m.revenue_share(c.df, "payment_method"),
    """SELECT payment_method, sum(final_price) AS revenue,
  sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share FROM en GROUP BY 1""")
for _by in ("product_category", "state", "payment_method"):
    add(f"leader_by_{_by}", "leader revenue:0 share:6", lambda c, by=_by: m.leader(c.df, by),
        f"""SELECT {_by} AS leader, revenue, share FROM (SELECT {_by}, sum(final_price) AS revenue,
  sum(final_price) * 100 / sum(sum(final_price)) OVER () AS share FROM en GROUP BY 1) ORDER BY revenue DESC LIMIT 1""")
for _by, _guard in (("product_category", True), ("payment_method", False)):
    add(f"loss_rate_by_{_by}", f"{_by} lost:0 total:0 loss_rate:6 is_max:b",
        lambda c, by=_by, g=_guard: m.loss_rate_by(c.df, by, g),
        f"""x AS (SELECT {_by}, sum(CASE WHEN returned = 1 THEN final_price ELSE 0 END) AS lost, sum(final_price) AS total
  FROM en GROUP BY 1)
---
SELECT *, lost / total * 100 AS loss_rate, lost / total = max(lost / total) OVER () AS is_max FROM x""")
add("segment_stats", "customer_segment total:0 aov:4 leads_total:b leads_aov:b", lambda c: m.segment_stats(c.df),
    """x AS (SELECT customer_segment, sum(final_price) AS total, avg(final_price) AS aov FROM en GROUP BY 1)
---
SELECT *, total = max(total) OVER () AS leads_total, aov = max(aov) OVER () AS leads_aov FROM x""")
add("avg_discount_by_category", "product_category avg_discount:6 overall:6 range:6",
    lambda c: m.avg_discount_by(c.df),
    """x AS (SELECT product_category, avg(discount_percentage) AS avg_discount FROM en GROUP BY 1)
---
SELECT *, (SELECT avg(discount_percentage) FROM en) AS overall,
  max(avg_discount) OVER () - min(avg_discount) OVER () AS range FROM x""")
add("revenue_lost", "product_category lost:0 lost_pct:6 total_lost_pct:6", lambda c: m.revenue_lost(c.df),
    """SELECT product_category, sum(final_price) AS lost,
  sum(final_price) / (SELECT sum(final_price) FROM en) * 100 AS lost_pct,
  (SELECT sum(final_price) FROM en WHERE returned = 1) / (SELECT sum(final_price) FROM en) * 100 AS total_lost_pct
  FROM en WHERE returned = 1 GROUP BY 1""")
add("whale_share", "top:0 total:0 whale_share:6", lambda c: m.whale_share(c.flat("final_price")),
    """SELECT *, top / total * 100 AS whale_share FROM (SELECT sum(final_price) FILTER (WHERE final_price >=
  (SELECT quantile_cont(final_price, 0.9) FROM en)) AS top, sum(final_price) AS total FROM en)""")
add("whale_share_by_category", "product_category top:0 total:0 whale_share:6",
    lambda c: m.whale_share(c.flat("product_category", "final_price"), "product_category"),
    """t AS (SELECT product_category AS g, quantile_cont(final_price, 0.9) AS e FROM en GROUP BY 1)
---
SELECT *, top / total * 100 AS whale_share FROM (SELECT product_category, sum(final_price) FILTER (WHERE final_price >= e)
  AS top, sum(final_price) AS total FROM en JOIN t ON g = product_category GROUP BY 1)""")
_COUNTED = ("product_subcategory", "state", "city", "customer_id", "product_category", "customer_segment",
            "payment_method", "shipping_type", "gender", "price_bucket")
add("distinct_counts", "column distinct:l", lambda c: m.distinct_counts(c.full, _COUNTED),
    " UNION ALL ".join(f"SELECT '{x}' AS \"column\", count(DISTINCT {x}) AS \"distinct\" FROM en" for x in _COUNTED))
add("histogram", "bin:i bin_lo:4 bin_hi:4 n:l", lambda c: m.histogram(c.flat("final_price"), "final_price"),
    """r AS (SELECT min(final_price) AS lo, (max(final_price) - min(final_price)) / 40 AS w FROM en)
---
SELECT bin, lo + bin * w AS bin_lo, lo + (bin + 1) * w AS bin_hi, n FROM (SELECT CAST(least(39, floor((final_price - lo) / w))
  AS INTEGER) AS bin, lo, w, count(*) AS n FROM en, r GROUP BY 1, 2, 3)""")
add("box_stats", "q1:4 median:4 q3:4 mean:4 whisker_lo:4 whisker_hi:4 beyond:l",
    lambda c: m.box_stats(c.flat("final_price"), "final_price"),
    """q AS (SELECT quantile_cont(final_price, 0.25) AS q1, median(final_price) AS median,
  quantile_cont(final_price, 0.75) AS q3, avg(final_price) AS mean FROM en)
---
SELECT q1, median, q3, mean, min(final_price) FILTER (WHERE final_price >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
  max(final_price) FILTER (WHERE final_price <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
  count(*) FILTER (WHERE final_price < q1 - 1.5 * (q3 - q1) OR final_price > q3 + 1.5 * (q3 - q1)) AS beyond
  FROM en, q GROUP BY 1, 2, 3, 4""")

# --- pivots -----------------------------------------------------------------

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BUCKETS = ("Low (0–10%)", "Mid (11–20%)", "High (21–30%)")


def pivot_query(name, rows, cols, levels, agg, as_names=None):
    names = as_names or levels

    def run(c):
        wide = p.pivot_agg(c.df, rows, cols, "final_price", agg, levels if as_names else None)
        return wide.toDF(rows, *as_names) if as_names else wide

    cells = ", ".join(f"{agg}(final_price) FILTER (WHERE {cols} = '{v}') AS \"{n}\"" for v, n in zip(levels, names))
    add(name, rows + " " + " ".join(f"{n}:{0 if agg == 'sum' else 4}" for n in names), run,
        f"SELECT {rows}, {cells} FROM en WHERE {rows} IS NOT NULL GROUP BY 1")


pivot_query("pivot_age_segment", "age_group", "customer_segment", SEGMENTS, "avg")
pivot_query("pivot_category_discount", "product_category", "disc_bucket", BUCKETS, "avg", ("low", "mid", "high"))
pivot_query("pivot_state_category", "state", "product_category", CATEGORIES, "sum")
pivot_query("pivot_category_segment", "product_category", "customer_segment", SEGMENTS, "avg")
for _by in ("product_category", "state", "city", "payment_method"):
    add(f"crosstab_{_by}", f"{_by} No:l Yes:l", lambda c, by=_by: p.crosstab(c.df, by, "return_status", ["No", "Yes"]),
        f"""SELECT {_by}, count(*) FILTER (WHERE return_status = 'No') AS "No",
  count(*) FILTER (WHERE return_status = 'Yes') AS "Yes" FROM en GROUP BY 1""")
_MIX = ", ".join(f"count(*) FILTER (WHERE customer_segment = '{v}') * 100.0 / count(*) AS \"{v}\"" for v in SEGMENTS)
add("segment_mix_wide", "order_month " + " ".join(f"{v}:6" for v in SEGMENTS), lambda c: p.segment_mix_wide(c.df),
    f"SELECT order_month, {_MIX} FROM en GROUP BY 1")
add("segment_mix", "order_month segment share:6", lambda c: p.segment_mix(c.df),
    f"""w AS (SELECT order_month, {_MIX} FROM en GROUP BY 1)
---
UNPIVOT w ON COLUMNS(* EXCLUDE (order_month)) INTO NAME segment VALUE share""")
add("melt", "order_month measure value:4",
    lambda c: p.melt(m.mean_ci(c.df, "order_month").select("order_month", "mean", "sd", "ci95"), ["order_month"],
                     "measure", "value"),
    "w AS (SELECT order_month, mean, sd, ci95 FROM (" + CI_SQL.format(by="order_month", v="final_price") + """))
---
UNPIVOT w ON COLUMNS(* EXCLUDE (order_month)) INTO NAME measure VALUE value""")
RANGES_SQL = " UNION ALL ".join(
    f"""SELECT '{x}' AS "column", CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max, avg({x}) AS mean,
  stddev_samp({x}) AS sd FROM {{t}}""" for x in NUM_COLS[:6])
add("agg_transpose", "column min:4 max:4 mean:4 sd:4", lambda c: p.agg_transpose(c.df, NUM_COLS[:6]),
    RANGES_SQL.format(t="en"))

# --- series -----------------------------------------------------------------

add("daily_trend_7d", "date:d revenue:4 trend_7d:4", lambda c: ts.daily_trend_7d(c.df),
    """SELECT *, avg(revenue) OVER (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend_7d
  FROM (SELECT order_date AS date, sum(final_price) AS revenue FROM en GROUP BY 1)""")
DECOMPOSE = """mr AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, sum(final_price) AS revenue FROM en GROUP BY 1),
tr AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN avg(revenue) OVER w END AS trend FROM mr
  WINDOW w AS (ORDER BY month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
se AS (SELECT *, avg(revenue - trend) OVER (PARTITION BY month(month)) AS seasonal FROM tr),
de AS (SELECT *, revenue - trend - seasonal AS residual FROM se WHERE (SELECT count(*) FROM mr) >= 13)
---
"""
add("seasonal_decompose", "month:d revenue:4 trend:2 seasonal:2 residual:2", lambda c: ts.seasonal_decompose(c.df),
    DECOMPOSE + "SELECT * FROM de")
add("seasonal_profile", "month_of_year:i seasonal:2", lambda c: ts.seasonal_profile(c.df),
    DECOMPOSE + "SELECT month(month) AS month_of_year, min(seasonal) AS seasonal FROM de GROUP BY 1")
add("seasonal_strength", "seasonal_strength:6", lambda c: ts.seasonal_strength(c.df),
    DECOMPOSE + "SELECT greatest(0, 1 - var_samp(residual) / var_samp(residual + seasonal)) AS seasonal_strength FROM de")
add("lowest_month", "lowest_month seasonal:2", lambda c: ts.lowest_month(c.df),
    DECOMPOSE + "SELECT monthname(month) AS lowest_month, seasonal FROM de ORDER BY seasonal LIMIT 1")
for _by in (None, "product_category", "state"):
    _key = f"{_by}, " if _by else ""
    add(f"monthly_positions{'_by_' + _by if _by else ''}", f"{_by or ''} order_month revenue:4 idx:i",
        lambda c, by=_by: ts.monthly_positions(c.df, by),
        f"""SELECT *, row_number() OVER ({'PARTITION BY ' + _by if _by else ''} ORDER BY order_month) - 1 AS idx
  FROM (SELECT {_key}order_month, sum(final_price) AS revenue FROM en GROUP BY ALL)""")

# --- sketches ---------------------------------------------------------------


def sketched_ranks(c):
    """Quartiles of a year from the sketches of its months, and whether their true ranks are within the stated error."""
    facts = c.flat("order_month", "order_year", "final_price")
    months = stage(sk.quantile_sketches(facts, "final_price", ["order_year", "order_month"]), "sketches")
    probs = (0.25, 0.5, 0.75)
    told = sk.merged_quantiles(months, probs, ["order_year"]).withColumnRenamed("order_year", "_year")
    rows = facts.join(F.broadcast(told), F.col("order_year") == F.col("_year"))  # one row a year
    below = [F.count_if(F.col("final_price") < F.col("q")[i]) for i in range(len(probs))]
    upto = [F.count_if(F.col("final_price") <= F.col("q")[i]) for i in range(len(probs))]
    slack = F.count("*") * (2 * sk.RANK_ERROR) + 1
    near = [(b <= F.count("*") * p + slack) & (u >= F.count("*") * p - slack) for b, u, p in zip(below, upto, probs)]
    return rows.groupBy("order_year").agg(F.count("*").alias("n"), (near[0] & near[1] & near[2]).alias("within"))


def sketched_counts(c):
    """Distinct values of a year from the sketches of its months, and whether they are near the exact count."""
    cols = ["customer_id", "product_subcategory", "city", "order_id"]
    facts = c.flat("order_month", "order_year", *cols)
    months = stage(sk.distinct_sketches(facts, cols, ["order_year", "order_month"]), "sketches")
    told = sk.merged_distinct(months, ["order_year"]).select(F.col("order_year").alias("_year"), F.col("column").alias("_column"), F.col("distinct").alias("_told"))
    exact = facts.groupBy("order_year").agg(*[F.count_distinct(x).alias(x) for x in cols]).unpivot(["order_year"], cols, "column", "exact")
    both = exact.join(told, (F.col("order_year") == F.col("_year")) & (F.col("column") == F.col("_column")))
    return both.withColumn("within", F.abs(F.col("_told") - F.col("exact")) <= F.col("exact") * (5 * sk.DISTINCT_ERROR) + 1)


add("sketched_quantiles_by_year", "order_year:i n:l within:b", sketched_ranks, "SELECT order_year, count(*) AS n, true AS within FROM en GROUP BY 1")
add("sketched_distinct_by_year", "order_year:i column exact:l within:b", sketched_counts, " UNION ALL ".join(
    f"SELECT order_year, '{x}' AS \"column\", count(DISTINCT {x}) AS exact, true AS within FROM en GROUP BY 1" for x in ("customer_id", "product_subcategory", "city", "order_id")))
def _kpi(raw):
    return raw.agg(F.count("*").alias("orders"), F.sum("final_price").alias("revenue"), F.avg("final_price").alias("aov"))


add("memoised_kpi", "orders:l revenue:4 aov:4", lambda c: [memoised(c.raw, "kpi", _kpi) for _ in range(2)][1],
    "SELECT count(*) AS orders, sum(final_price) AS revenue, avg(final_price) AS aov FROM tx")

# --- samples and extremes ---------------------------------------------------

SAMPLE_KEYS = ("order_id", "customer_id", "order_date", "quantity")
SAMPLE_SQL = """SELECT *, md5('{seed}|' || order_id || '|' || customer_id || '|' || CAST(order_date AS VARCHAR) || '|' ||
  CAST(quantity AS VARCHAR)) AS d FROM en ORDER BY d, product_price, discount_percentage, final_price, product_category,
  product_subcategory, shipping_type, return_status LIMIT {n}"""
for _n, _seed in ((2000, 42), (3000, 42), (4000, 42), (5000, 42)):
    add(f"sample_{_n}", "order_id order_date:d product_price:8 quantity:i discount_percentage:2 final_price:4",
        lambda c, n=_n, s=_seed: smp.sample_n(
            c.df.select("order_id", "customer_id", "order_date", "quantity", "product_price", "discount_percentage",
                        "final_price"), n, s, SAMPLE_KEYS),
        SAMPLE_SQL.format(seed=_seed, n=_n))
SPLIT_COLS = (*SAMPLE_KEYS, "returned")
PLAIN_SQL = """dg AS (SELECT *, md5('42|' || order_id || '|' || customer_id || '|' || CAST(order_date AS VARCHAR) || '|' ||
  CAST(quantity AS VARCHAR)) AS d FROM en),
sp AS (SELECT *, row_number() OVER (ORDER BY d) <= ceil(count(*) OVER () * 0.25) AS is_test FROM dg)
---
"""
CLASS_SQL = """dg AS (SELECT *, md5('42|' || order_id || '|' || customer_id || '|' || CAST(order_date AS VARCHAR) || '|' ||
  CAST(quantity AS VARCHAR)) AS d FROM en),
tl AS (SELECT count(*) AS n, CAST(ceil(count(*) * 0.25) AS BIGINT) AS t FROM dg),
cl AS (SELECT returned, count(*) AS nc, count(*) * any_value(t) // any_value(n) AS whole, count(*) * any_value(t) % any_value(n) AS rest
  FROM dg, (SELECT n, t FROM tl) GROUP BY 1),
qt AS (SELECT returned, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, returned) <= (SELECT t FROM tl) - sum(whole) OVER () THEN 1 ELSE 0 END AS want FROM cl),
sp AS (SELECT dg.*, row_number() OVER (PARTITION BY dg.returned ORDER BY d) <= want AS is_test FROM dg JOIN qt ON dg.returned = qt.returned)
---
"""
SIDES = "count(*) FILTER (WHERE NOT is_test) AS n_train, count(*) FILTER (WHERE is_test) AS n_test FROM sp"


def sides(c, by=()):
    return smp.split(c.df.select(*SPLIT_COLS), 25, 42, SAMPLE_KEYS, by)


add("split_sizes", "n_train:l n_test:l", lambda c: smp.split_sizes(sides(c)), PLAIN_SQL + f"SELECT {SIDES}")
add("split_rows", "order_id is_test:b", sides, PLAIN_SQL + "SELECT order_id, is_test FROM sp")
add("stratified_split_sizes", "returned:i n_train:l n_test:l", lambda c: smp.split_sizes(sides(c, ["returned"]), ["returned"]),
    CLASS_SQL + f"SELECT returned, {SIDES} GROUP BY 1")
add("stratified_split_rows", "order_id is_test:b", lambda c: sides(c, ["returned"]), CLASS_SQL + "SELECT order_id, is_test FROM sp")

# --- outliers ---------------------------------------------------------------

FENCES = {
    "iqr": """f AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT
  quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM en))""",
    "zscore": "f AS (SELECT avg({v}) - 3 * stddev_samp({v}) AS lower, avg({v}) + 3 * stddev_samp({v}) AS upper FROM en)"}
for _method, _cte in FENCES.items():
    _cte = _cte.format(v="final_price")
    add(f"outliers_{_method}", "outliers:l outlier_pct:6 lower:4 upper:4",
        lambda c, k=_method: o.outliers(c.flat("final_price"), "final_price", k),
        _cte + """
---
SELECT count(*) FILTER (WHERE final_price < lower OR final_price > upper) AS outliers,
  count(*) FILTER (WHERE final_price < lower OR final_price > upper) * 100.0 / count(*) AS outlier_pct,
  lower, upper FROM en, f GROUP BY 3, 4""")
    add(f"outlier_rows_{_method}", "order_id customer_id order_date:d product_price:8 quantity:i final_price:4",
        lambda c, k=_method: o.outlier_rows(c.flat(*SAMPLE_ORDER), "final_price", SAMPLE_ORDER, k),
        _cte + f"""
---
SELECT en.* FROM en, f WHERE final_price < lower OR final_price > upper ORDER BY {', '.join(SAMPLE_ORDER)} LIMIT 20""")
SENS_SQL = """q AS (SELECT quantile_cont(final_price, 0.25) AS q1, quantile_cont(final_price, 0.75) AS q3 FROM en),
k AS (SELECT width, q1 - width * (q3 - q1) AS lower, q3 + width * (q3 - q1) AS upper
  FROM q, (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5), (3.0)) AS w(width)),
sens AS (SELECT width, lower, upper, count(*) FILTER (WHERE final_price < lower OR final_price > upper) AS outliers,
  count(*) FILTER (WHERE final_price < lower OR final_price > upper) * 100.0 / count(*) AS outlier_pct
  FROM en, k GROUP BY 1, 2, 3)
---
"""
add("outlier_sensitivity", "width:1 lower:4 upper:4 outliers:l outlier_pct:6",
    lambda c: o.outlier_sensitivity(c.flat("final_price"), "final_price"), SENS_SQL + "SELECT * FROM sens")
add("outlier_spread", "min_pct:6 max_pct:6 spread:6", lambda c: o.outlier_spread(c.flat("final_price"), "final_price"),
    SENS_SQL + "SELECT min(outlier_pct) AS min_pct, max(outlier_pct) AS max_pct,"
    " max(outlier_pct) - min(outlier_pct) AS spread FROM sens")

# --- data quality -----------------------------------------------------------

RAW_NAMES = [x.partition(":")[0] for x in RAW_COLS.split()]
_NULLS = " + ".join(f"CAST({x} IS NULL AS INTEGER)" for x in RAW_NAMES)
add("dq_overview", "rows:l columns:i duplicates:l duplicate_pct:6 missing_cells:l missing_pct:6 complete_rows:l span_days:i",
    lambda c: dq.dq_overview(c.raw),
    f"""b AS (SELECT count(*) AS rows, {len(RAW_NAMES)} AS columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tx))
  AS duplicates, sum({_NULLS}) AS missing_cells, count(*) FILTER (WHERE {_NULLS} = 0) AS complete_rows,
  date_diff('day', min(order_date), max(order_date)) AS span_days FROM tx)
---
SELECT *, duplicates * 100.0 / rows AS duplicate_pct, missing_cells * 100.0 / (rows * columns) AS missing_pct FROM b""")
add("dq_missing", "column missing:l missing_pct:6", lambda c: dq.dq_missing(c.raw),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", count(*) FILTER (WHERE {x} IS NULL) AS missing, "
        f"count(*) FILTER (WHERE {x} IS NULL) * 100.0 / count(*) AS missing_pct FROM tx" for x in RAW_NAMES)
    + ") WHERE missing > 0")
_DTYPE = {"order_date": "date", "age": "int", "quantity": "int", "product_price": "double",
          "discount_percentage": "double", "final_price": "double", "delivery_days": "double"}
add("dq_profile", "column dtype distinct:l missing:l", lambda c: dq.dq_profile(c.raw),
    " UNION ALL ".join(
        f"SELECT '{x}' AS \"column\", '{_DTYPE.get(x, 'string')}' AS dtype, count(DISTINCT {x}) AS \"distinct\", "
        f"count(*) FILTER (WHERE {x} IS NULL) AS missing FROM tx" for x in RAW_NAMES))
add("dq_ranges", "column min:4 max:4 mean:4 sd:4", lambda c: dq.dq_ranges(c.raw), RANGES_SQL.format(t="tx"))
add("dq_sanity", "negative_price:l bad_discount:l", lambda c: dq.dq_sanity(c.raw),
    """SELECT count(*) FILTER (WHERE final_price < 0) AS negative_price,
  count(*) FILTER (WHERE discount_percentage < 0 OR discount_percentage > 100) AS bad_discount FROM tx""")
add("dq_uniformity", "column level n:l pct:6", lambda c: m.uniformity(c.raw),
    " UNION ALL ".join(f"SELECT '{x}' AS \"column\", * FROM (" + SHARE_SQL.format(by=x, t="tx") + ")"
                       for x in ("customer_segment", "product_category")))

# --- RFM --------------------------------------------------------------------

add("rfm_gate", "has_id:b customers:l max_orders:l rfm_possible:b", lambda c: rfm.rfm_gate(c.df),
    """SELECT true AS has_id, count(*) AS customers, max(n) AS max_orders, max(n) > 1 AS rfm_possible
  FROM (SELECT customer_id, count(*) AS n FROM en GROUP BY 1)""")
RFM_CTES = """rb AS (SELECT customer_id AS customer, date_diff('day', max(order_date), (SELECT max(order_date) FROM en) + 1)
  AS recency, count(order_id) AS frequency, sum(final_price) AS monetary FROM en GROUP BY 1),
re AS (SELECT quantile_cont(recency, [0.2, 0.4, 0.6, 0.8]) AS r, quantile_cont(monetary, [0.2, 0.4, 0.6, 0.8]) AS m,
  count(*) AS n FROM rb),
rs AS (SELECT rb.*, CASE WHEN recency <= r[1] THEN 5 WHEN recency <= r[2] THEN 4 WHEN recency <= r[3] THEN 3
    WHEN recency <= r[4] THEN 2 ELSE 1 END AS r_score,
  greatest(1, CAST(ceil((row_number() OVER (ORDER BY frequency, customer) - 1) * 5.0 / (n - 1)) AS INTEGER)) AS f_score,
  CASE WHEN monetary <= m[1] THEN 1 WHEN monetary <= m[2] THEN 2 WHEN monetary <= m[3] THEN 3
    WHEN monetary <= m[4] THEN 4 ELSE 5 END AS m_score FROM rb, re),
rt AS (SELECT *, r_score + f_score + m_score AS rfm_score, CASE WHEN r_score + f_score + m_score >= 12 THEN 'Champions'
  WHEN r_score + f_score + m_score >= 9 THEN 'Loyal' WHEN r_score + f_score + m_score >= 6 THEN 'At Risk' ELSE 'Lost' END
  AS tier FROM rs)
---
"""
_SCORES = "customer recency:i frequency:l monetary:4 r_score:i f_score:i m_score:i rfm_score:i tier"
add("rfm_base", "customer recency:i frequency:l monetary:4", lambda c: rfm.rfm_base(c.df), RFM_CTES + "SELECT * FROM rb")
add("rfm_scores", _SCORES, lambda c: rfm.rfm_scores(c.df), RFM_CTES + "SELECT * FROM rt")
add("rfm_tiers", "tier customers:l", lambda c: rfm.rfm_tiers(c.df),
    RFM_CTES + "SELECT tier, count(*) AS customers FROM rt GROUP BY 1")
add("rfm_top20", _SCORES, lambda c: rfm.rfm_top20(c.df),
    RFM_CTES + "SELECT * FROM rt ORDER BY rfm_score DESC, customer LIMIT 20")
