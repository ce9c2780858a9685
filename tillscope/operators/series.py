"""Time series: rolling means, seasonal decomposition, monthly positions.

Windows here run over monthly or daily sums, whose number is bounded by the
calendar; the transactions themselves are only aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.operators.metrics import daily_revenue

MIN_MONTHS = 13


def rolling_centered(df: DataFrame, order: str, value: str, width: int, min_rows: int,
                     out: str = "rolling") -> DataFrame:
    """Centred mean over ``width`` rows; an even width reaches one row further back."""
    ahead = (width - 1) // 2
    frame = Window.orderBy(order).rowsBetween(ahead - width + 1, ahead)
    mean = F.when(F.count(value).over(frame) >= min_rows, F.avg(value).over(frame))
    return df.withColumn(out, mean)


def daily_trend_7d(df: DataFrame) -> DataFrame:
    return rolling_centered(daily_revenue(df), "date", "revenue", 7, 1, "trend_7d").orderBy("date")


def month_start_revenue(df: DataFrame, date: str = "order_date", value: str = "final_price") -> DataFrame:
    return (df.where(F.col(date).isNotNull())
            .groupBy(F.trunc(date, "MM").alias("month")).agg(F.sum(value).alias("revenue")))


def seasonal_decompose(df: DataFrame, date: str = "order_date", value: str = "final_price") -> DataFrame:
    """Additive trend, seasonal and residual part of monthly revenue.

    No rows come out of fewer than 13 months.
    """
    months = month_start_revenue(df, date, value)
    trended = rolling_centered(months, "month", "revenue", 12, 6, "trend")
    season = F.avg(F.col("revenue") - F.col("trend")).over(Window.partitionBy(F.month("month")))
    return (trended
            .withColumn("_n", F.count("*").over(Window.partitionBy()))
            .withColumn("seasonal", season)
            .withColumn("residual", F.col("revenue") - F.col("trend") - F.col("seasonal"))
            .where(F.col("_n") >= MIN_MONTHS).drop("_n").orderBy("month"))


def seasonal_strength(df: DataFrame) -> DataFrame:
    """1 − Var(residual) / Var(residual + seasonal), not below 0."""
    parts = seasonal_decompose(df).agg(
        F.count("*").alias("months"), F.var_samp("residual").alias("vr"),
        F.var_samp(F.col("residual") + F.col("seasonal")).alias("vd"))
    strength = F.greatest(F.lit(0.0), 1 - F.try_divide("vr", "vd"))
    return (parts.where(F.col("months") > 0)
            .select(F.coalesce(strength, F.lit(0.0)).alias("seasonal_strength")))


def seasonal_profile(df: DataFrame) -> DataFrame:
    """Average deviation from the trend per calendar month."""
    return (seasonal_decompose(df).groupBy(F.month("month").alias("month_of_year"))
            .agg(F.first("seasonal").alias("seasonal")).orderBy("month_of_year"))


def lowest_month(df: DataFrame) -> DataFrame:
    """Name of the calendar month with the lowest seasonal part."""
    low = seasonal_profile(df).agg(
        F.min_by("month_of_year", F.struct("seasonal", "month_of_year")).alias("m"),
        F.min("seasonal").alias("seasonal"))
    return (low.where(F.col("m").isNotNull())
            .select(F.date_format(F.make_date(F.lit(2024), F.col("m"), F.lit(1)), "MMMM").alias("lowest_month"),
                    "seasonal"))


def monthly_positions(df: DataFrame, by: str | None = None) -> DataFrame:
    """Monthly revenue with the 0-based position of each month in its series."""
    keys = [by] if by else []
    base = df.where(F.col("order_month").isNotNull())
    if by:
        base = base.where(F.col(by).isNotNull())
    sums = base.groupBy(*keys, "order_month").agg(F.sum("final_price").alias("revenue"))
    order = Window.partitionBy(*keys).orderBy("order_month")
    return sums.withColumn("idx", F.row_number().over(order) - 1)
