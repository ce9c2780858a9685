"""Slicing by date, age and category, and comparison with the period before."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.model import FILTER_COLS


def as_date(d) -> dt.date:
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def in_period(date: str, start, end) -> Column:
    """Whole days from ``start`` to ``end``, both included.

    The column stays bare so that the comparison reaches the file scan.
    """
    start, end = as_date(start), as_date(end)
    return (F.col(date) >= F.lit(start)) & (F.col(date) < F.lit(end + dt.timedelta(days=1)))


def matches(age_range=None, choices: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Age range and in-lists; an empty list matches nothing, NULL never matches.

    No age range stands for the full span, which a missing age is outside of.
    """
    cond = F.col("age").isNotNull() if age_range is None else F.col("age").between(*age_range)
    for c, allowed in (choices or {}).items():
        cond = cond & F.col(c).isin(list(allowed))
    return cond


def chosen(date_range=None, age_range=None, choices=None) -> Column:
    if date_range is not None and len(date_range) == 2:
        return in_period("order_date", *date_range) & matches(age_range, choices)
    return F.col("order_date").isNotNull() & matches(age_range, choices)


def slice_rows(df: DataFrame, date_range=None, age_range=None,
               choices: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of the selected period, ages and categories.

    A date range without two ends stands for the full span; a missing date is in none.
    """
    return df.where(chosen(date_range, age_range, choices))


def previous_period(start, end) -> tuple[dt.date, dt.date]:
    """The period of the same length that ends the day before ``start``."""
    start, end = as_date(start), as_date(end)
    day = dt.timedelta(days=1)
    return start - (end - start) - day, start - day


def prev_period_slice(df: DataFrame, start, end, age_range=None, choices=None) -> DataFrame:
    return slice_rows(df, previous_period(start, end), age_range, choices)


def filter_domains(df: DataFrame) -> DataFrame:
    """Bounds of date and age and the sorted levels of the filter columns."""
    return df.agg(
        F.min("order_date").alias("date_min"), F.max("order_date").alias("date_max"),
        F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        *[F.sort_array(F.collect_set(c)).alias(c) for c in FILTER_COLS])


def slice_counts(df: DataFrame, date_range=None, age_range=None, choices=None) -> DataFrame:
    """Rows in the slice and in the whole table, from one scan."""
    cond = chosen(date_range, age_range, choices)
    return df.agg(F.count_if(cond).alias("shown"), F.count("*").alias("total"))


def _measures(cond: Column | None = None) -> list[Column]:
    def only(c):
        return F.col(c) if cond is None else F.when(cond, F.col(c))

    rows = F.count("*") if cond is None else F.count_if(cond)
    return [F.sum(only("final_price")).alias("revenue"), rows.alias("orders"),
            F.avg(only("final_price")).alias("aov"),
            (F.avg(only("returned")) * 100).alias("return_rate"),
            F.avg(only("delivery_days")).alias("delivery_days")]


def kpi(df: DataFrame) -> DataFrame:
    """Revenue, orders, average order value, return rate and delivery days."""
    return df.agg(*_measures())


def kpi_delta(df: DataFrame, start, end, age_range=None, choices=None) -> DataFrame:
    """KPIs of a period with their change against the period before, in one scan.

    Relative change in percent for revenue, orders and order value; difference
    for the return rate (points) and the delivery days. NULL where the earlier
    period is empty or its value is zero.
    """
    prev_start, prev_end = previous_period(start, end)
    now, before = in_period("order_date", start, end), in_period("order_date", prev_start, prev_end)
    names = ["revenue", "orders", "aov", "return_rate", "delivery_days"]
    pick = df.where(in_period("order_date", prev_start, end) & matches(age_range, choices))
    both = pick.agg(F.struct(*_measures(now)).alias("c"), F.struct(*_measures(before)).alias("p"))

    def cur(n):
        return F.col(f"c.{n}")

    def prev(n):
        return F.when(F.col("p.orders") > 0, F.col(f"p.{n}"))

    relative = [(F.try_divide(cur(n) - prev(n), prev(n)) * 100).alias(f"{n}_delta") for n in names[:3]]
    plain = [(cur(n) - prev(n)).alias(f"{n}_delta") for n in names[3:]]
    return both.select(*[cur(n).alias(n) for n in names], *relative, *plain)
