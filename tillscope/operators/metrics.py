"""Grouped aggregates: revenue, returns, shares, spend and leaders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.order_stats import (all_present, exact_quantiles, few_groups, is_number,
                                             per_group)
from tillscope.functions.sketches import approx_quantiles, distinct_sketches, merged_distinct
from tillscope.model import VALUE_LABELS, WEEKDAYS

def everything():
    """Window over a whole table; only for small aggregates."""
    return Window.partitionBy()


def grouped(df: DataFrame, *by: str):
    """``groupBy`` without the rows whose key is missing."""
    return df.where(all_present(by)).groupBy(*by)


def share_of_total(value):
    """Percentage of ``value`` in its column total (for small aggregates)."""
    return F.try_divide(value, F.sum(value).over(everything())) * 100


def lost_price():
    return F.when(F.col("returned") == 1, F.col("final_price"))


# --- by calendar -----------------------------------------------------------

def monthly_revenue(df: DataFrame) -> DataFrame:
    return (grouped(df, "order_month")
            .agg(F.sum("final_price").alias("revenue"), F.count("order_id").alias("orders"))
            .orderBy("order_month"))


def monthly_return_rate(df: DataFrame) -> DataFrame:
    return (grouped(df, "order_month").agg((F.avg("returned") * 100).alias("return_rate"))
            .orderBy("order_month"))


def mean_ci(df: DataFrame, by: str, value: str = "final_price", fill: bool = True) -> DataFrame:
    """Mean with the half-width of its 95 % interval per level.

    ``sd`` is the sample deviation, NULL for a single row; ``fill`` turns the
    half-width of such a level into 0.
    """
    stats = (grouped(df, by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                 F.count(value).alias("n"))
             .withColumn("sem", F.try_divide(F.col("sd"), F.sqrt("n"))))
    ci = F.col("sem") * 1.96
    return stats.withColumn("ci95", F.coalesce(ci, F.lit(0.0)) if fill else ci)


def monthly_aov_ci(df: DataFrame) -> DataFrame:
    return mean_ci(df, "order_month").orderBy("order_month")


def state_price_ci(df: DataFrame) -> DataFrame:
    return mean_ci(df, "state", fill=False).drop("sem").orderBy("state")


def dow_revenue(df: DataFrame) -> DataFrame:
    """Revenue per weekday, Monday first; a day without orders shows NULL."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    spine = df.sparkSession.range(len(WEEKDAYS)).select(
        F.col("id").cast("int").alias("pos"), F.get(names, F.col("id").cast("int")).alias("day"))
    sums = grouped(df, "order_dow").agg(F.sum("final_price").alias("revenue"))
    return (F.broadcast(spine).join(sums, F.col("day") == F.col("order_dow"), "left")
            .select("pos", "day", "revenue").orderBy("pos"))


def dom_revenue(df: DataFrame) -> DataFrame:
    return grouped(df, "order_dom").agg(F.sum("final_price").alias("revenue")).orderBy("order_dom")


def daily_revenue(df: DataFrame) -> DataFrame:
    dated = df.select(F.to_date("order_date").alias("date"), "final_price")
    return grouped(dated, "date").agg(F.sum("final_price").alias("revenue")).orderBy("date")


# --- counts and shares ------------------------------------------------------

def level_counts(df: DataFrame, by: str) -> DataFrame:
    return (grouped(df, by).agg(F.count("*").alias("n"))
            .withColumnRenamed(by, "level").orderBy(F.desc("n"), "level"))


def category_share(df: DataFrame, by: str) -> DataFrame:
    """Percentage of rows per level, most frequent first."""
    return (level_counts(df, by).withColumn("pct", share_of_total(F.col("n")))
            .orderBy(F.desc("n"), "level"))


def uniformity(df: DataFrame, cols: Sequence[str] = ("customer_segment", "product_category")) -> DataFrame:
    """Row shares per level of several columns from one scan."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("x"))
    counts = grouped(pairs.select("x.*"), "column", "level").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("column"))
    return counts.withColumn("pct", F.col("n") * 100 / whole).orderBy("column", F.desc("n"), "level")


def missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN in a floating column."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(c)
    return F.col(c).isNull()


def value_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column, value, n), one per distinct value of each column.

    Values travel as text and combine map-side; a missing value is NULL, and
    minus zero is zero.
    """
    def text(c):
        kind = df.schema[c].dataType
        plain = F.col(c) + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)
        return plain.cast("string")

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), text(c)).alias("value")) for c in cols])
    return (df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value")
            .agg(F.count("*").alias("n")))


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Number of distinct values per column, missing values left out; ``approx``: by sketches, within their error."""
    if approx:
        return merged_distinct(distinct_sketches(df, cols))
    return value_table(df, cols).groupBy("column").agg(F.count("value").alias("distinct"))


# --- by category ------------------------------------------------------------

def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), small: bool | None = None,
              approx: bool = False) -> DataFrame:
    """Exact quantiles, or in one pass those of sketches."""
    return approx_quantiles(df, value, probs, by) if approx else exact_quantiles(df, value, probs, by, small)


def group_spend(df: DataFrame, by: str, value: str = "final_price", approx: bool = False) -> DataFrame:
    """Mean, median, deviation, count and 95 % half-width per level; ``approx``: the median within a rank error."""
    small = few_groups(df, [by])
    stats = mean_ci(df, by, value)
    medians = quantiles(df, value, [0.5], [by], small, approx)
    return (stats.join(per_group(medians.select(by, F.get("q", F.lit(0)).alias("median")), small), by, "left")
            .orderBy(by))


def return_rate_by(df: DataFrame, by: str) -> DataFrame:
    return (grouped(df, by).agg((F.avg("returned") * 100).alias("return_rate"))
            .orderBy(F.desc("return_rate"), by))


def high_value_profile(df: DataFrame) -> DataFrame:
    """Average order of the high-value rows against the rest."""
    label = F.when(F.col("high_value") == 1, VALUE_LABELS[1]).otherwise(VALUE_LABELS[0])
    return (df.groupBy("high_value")
            .agg(F.avg("final_price").alias("avg_final_price"), F.avg("quantity").alias("avg_quantity"),
                 F.avg("discount_percentage").alias("avg_discount"),
                 (F.avg("returned") * 100).alias("return_rate"), F.count("final_price").alias("n"))
            .select(label.alias("orders"), "avg_final_price", "avg_quantity", "avg_discount",
                    "return_rate", "n")
            .orderBy("orders"))


def group_summary(df: DataFrame, by: str) -> DataFrame:
    """Orders, revenue, average value and return rate per level."""
    return (grouped(df, by)
            .agg(F.count("order_id").alias("orders"), F.sum("final_price").alias("revenue"),
                 F.avg("final_price").alias("avg_spend"), (F.avg("returned") * 100).alias("return_rate"))
            .orderBy(by))


def revenue_share(df: DataFrame, by: str) -> DataFrame:
    """Revenue and its share per level, largest first, with the even split."""
    return (grouped(df, by).agg(F.sum("final_price").alias("revenue"))
            .withColumn("share", share_of_total(F.col("revenue")))
            .withColumn("even_share", F.lit(100.0) / F.count("*").over(everything()))
            .orderBy(F.desc("revenue"), by))


def geo_artifact(df: DataFrame) -> DataFrame:
    """Whether the leading state leads only because it has several cities."""
    cells = (df.groupBy("state", "city").agg(F.sum("final_price").alias("revenue")))
    states = (grouped(cells, "state")
              .agg(F.sum("revenue").alias("revenue"),
                   F.array_compact(F.sort_array(F.collect_set("city"))).alias("cities"))
              .withColumn("share", share_of_total(F.col("revenue"))))
    top = states.agg(F.max_by(F.struct("state", "share", "cities"),
                              F.struct("revenue", "state")).alias("top"))
    cities = (grouped(cells, "city").agg(F.sum("revenue").alias("revenue"))
              .withColumn("share", share_of_total(F.col("revenue")))
              .withColumn("off", F.abs(F.col("share") - F.avg("share").over(everything()))))
    spread = cities.agg(F.max("off").alias("city_spread"), F.count("*").alias("n_cities"))
    city = spread.select(F.struct("city_spread", "n_cities")).scalar()
    return top.withColumn("city", city).select(
        F.col("top.state").alias("top_state"), F.col("top.share").alias("top_share"),
        F.size("top.cities").cast("long").alias("top_cities"),
        F.array_join("top.cities", ", ").alias("city_list"),
        F.col("city.n_cities").alias("n_cities"), F.col("city.city_spread").alias("city_spread"),
        (F.size("top.cities") > 1).alias("artifact"))


def leader(df: DataFrame, by: str) -> DataFrame:
    """The level with the most revenue and its share."""
    return (grouped(df, by).agg(F.sum("final_price").alias("revenue"))
            .agg(F.max_by(by, F.struct("revenue", by)).alias("leader"), F.max("revenue").alias("revenue"),
                 (F.try_divide(F.max("revenue"), F.sum("revenue")) * 100).alias("share")))


def loss_rate_by(df: DataFrame, by: str, guard: bool = True) -> DataFrame:
    """Returned share of each level's revenue.

    ``guard`` reports 0 for a level without positive revenue.
    """
    total = F.col("total")
    rate = F.try_divide("lost", "total") * 100
    return (grouped(df, by)
            .agg(F.coalesce(F.sum(lost_price()), F.lit(0.0)).alias("lost"), F.sum("final_price").alias("total"))
            .withColumn("loss_rate", F.when(total > 0, rate).otherwise(0.0) if guard else rate)
            .withColumn("is_max", F.col("loss_rate") == F.max("loss_rate").over(everything()))
            .orderBy(by))


def segment_stats(df: DataFrame, by: str = "customer_segment") -> DataFrame:
    """Total and mean revenue per level, marking the leader of each."""
    stats = grouped(df, by).agg(F.sum("final_price").alias("total"), F.avg("final_price").alias("aov"))
    return (stats
            .withColumn("leads_total", F.col("total") == F.max("total").over(everything()))
            .withColumn("leads_aov", F.col("aov") == F.max("aov").over(everything()))
            .orderBy(by))


def avg_discount_by(df: DataFrame, by: str = "product_category") -> DataFrame:
    """Mean discount per level beside the overall mean and the range of means."""
    parts = grouped(df, by).agg(F.avg("discount_percentage").alias("avg_discount"))
    overall = df.agg(F.avg("discount_percentage")).scalar()
    return (parts
            .withColumn("overall", overall)
            .withColumn("range", F.max("avg_discount").over(everything()) - F.min("avg_discount").over(everything()))
            .orderBy(F.desc("avg_discount"), by))


def revenue_lost(df: DataFrame, by: str = "product_category") -> DataFrame:
    """Revenue of returned rows per level as a percentage of all revenue.

    Only levels with a return are listed; ``total_lost_pct`` covers all.
    """
    parts = df.groupBy(by).agg(F.sum(lost_price()).alias("lost"), F.sum("final_price").alias("all"),
                               F.count_if(F.col("returned") == 1).alias("returns"))
    total = F.sum("all").over(everything())
    return (parts
            .withColumn("lost_pct", F.try_divide(F.col("lost"), total) * 100)
            .withColumn("total_lost_pct", F.try_divide(F.sum("lost").over(everything()), total) * 100)
            .where(F.col(by).isNotNull() & (F.col("returns") > 0))
            .select(by, "lost", "lost_pct", "total_lost_pct")
            .orderBy(F.desc("lost_pct"), by))


def whale_share(df: DataFrame, by: str | None = None, q: float = 0.9) -> DataFrame:
    """Revenue share of the rows at or above their own group's quantile."""
    rows = df.where(is_number(F.col("final_price")))
    if by is None:
        edge = F.get(quantiles_of_revenue(rows, q), F.lit(0))
        parts = rows.agg(F.sum(F.when(F.col("final_price") >= edge, F.col("final_price"))).alias("top"),
                         F.sum("final_price").alias("total"))
    else:
        small = few_groups(rows, [by])
        edges = exact_quantiles(rows, "final_price", [q], [by], small)
        parts = (rows.join(per_group(edges.select(by, F.get("q", F.lit(0)).alias("_edge")), small), by)
                 .groupBy(by)
                 .agg(F.sum(F.when(F.col("final_price") >= F.col("_edge"), F.col("final_price"))).alias("top"),
                      F.sum("final_price").alias("total")))
    share = F.when(F.col("total") > 0, F.try_divide("top", "total") * 100).otherwise(0.0)
    return parts.withColumn("whale_share", share)


def quantiles_of_revenue(rows: DataFrame, q: float):
    return exact_quantiles(rows, "final_price", [q]).select("q").scalar()


# --- distributions ----------------------------------------------------------

def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the value range; the last bin holds the maximum."""
    rows = df.select(F.col(value).cast("double").alias("v")).where(is_number(F.col("v")))
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    pos = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("e.lo")) / width)))
    return (rows.withColumn("e", ends)
            .groupBy(F.coalesce(pos, F.lit(0)).cast("int").alias("bin"), "e").agg(F.count("*").alias("n"))
            .select("bin", (F.col("e.lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("e.lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n")
            .orderBy("bin"))


def box_stats(df: DataFrame, value: str, approx: bool = False) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, points beyond; ``approx``: quartiles within a rank error."""
    rows = df.select(F.col(value).cast("double").alias("v")).where(is_number(F.col("v")))
    q = quantiles(rows, "v", [0.25, 0.5, 0.75], approx=approx).select("q").scalar()
    v, iqr = F.col("v"), F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    inside = v.between(F.get("q", F.lit(0)) - iqr * 1.5, F.get("q", F.lit(2)) + iqr * 1.5)
    return (rows.withColumn("q", q)
            .agg(F.first("q").alias("q"), F.avg("v").alias("mean"), F.min(F.when(inside, v)).alias("whisker_lo"),
                 F.max(F.when(inside, v)).alias("whisker_hi"), F.count_if(~inside).alias("beyond"))
            .select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"),
                    F.get("q", F.lit(2)).alias("q3"), "mean", "whisker_lo", "whisker_hi", "beyond"))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, deviation, bias-corrected skewness and excess kurtosis, range."""
    pairs = stacked(df, cols)
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    stats = pairs.groupBy("column").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    medians = exact_quantiles(pairs, "value", [0.5], ["column"], small=True)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return (stats.join(F.broadcast(medians.select("column", F.get("q", F.lit(0)).alias("median"))), "column")
            .select("column", "mean", "median", "sd", skew.alias("skewness"), kurt.alias("kurtosis"),
                    "min", "max"))


def stacked(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, numeric column) with columns ``column`` and ``value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return (df.select(*keep, F.explode(pairs).alias("_x")).select(*keep, "_x.*")
            .where(is_number(F.col("value"))))
