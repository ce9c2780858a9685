"""Derived transaction columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import quantiles_of
from tillscope.model import (AGE_BANDS, DISCOUNT_BANDS, HIGH_VALUE_QUANTILE, PRICE_LABELS)


def band(c: Column, bands) -> Column:
    """Label of the right-closed interval that holds ``c``; NULL outside all."""
    out = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        out = F.when((c > low) & (c <= high), label).otherwise(out)
    return out


def quantile_label(c: Column, edges: Column, labels) -> Column:
    """Label of the value bin of ``c`` between sorted inner ``edges``.

    The lowest bin is open below; where edges repeat, the first label wins.
    """
    out = F.lit(labels[-1])
    for i in range(len(labels) - 2, -1, -1):
        out = F.when(c <= F.get(edges, F.lit(i)), labels[i]).otherwise(out)
    return F.when(c.isNotNull(), out)


def enrich(raw: DataFrame, thresholds: bool = True, thresholds_from: DataFrame | None = None) -> DataFrame:
    """Add the twelve derived columns.

    The high-value threshold and the price quartiles come from all of ``raw``
    as scalar subqueries: a plan that does not read those columns does not
    compute them either. ``thresholds=False`` leaves the two out, which keeps
    the plan small where they are not needed; ``thresholds_from`` names a cheaper
    source of the same two price columns, such as a staged copy.
    """
    date = F.col("order_date")
    df = raw.withColumns({
        "returned": F.coalesce((F.col("return_status") == "Yes").cast("int"), F.lit(0)),
        "age_group": band(F.col("age"), AGE_BANDS),
        "disc_bucket": band(F.col("discount_percentage"), DISCOUNT_BANDS),
        "order_month": F.date_format(date, "yyyy-MM"),
        "order_quarter": F.concat(F.year(date).cast("string"), F.lit("Q"),
                                  F.quarter(date).cast("string")),
        "order_year": F.year(date),
        "order_dow": F.date_format(date, "EEEE"),
        "order_dom": F.dayofmonth(date),
        "revenue_per_unit": F.try_divide("final_price", "quantity"),
        "discount_impact": F.col("product_price") * F.col("quantity") - F.col("final_price"),
    })
    if not thresholds:
        return df
    source = raw if thresholds_from is None else thresholds_from
    return df.withColumns({
        "high_value": F.coalesce(
            (F.col("final_price") > F.get(quantiles_of(source, "final_price", [HIGH_VALUE_QUANTILE]), F.lit(0)))
            .cast("int"), F.lit(0)),
        "price_bucket": quantile_label(
            F.col("product_price"), quantiles_of(source, "product_price", [0.25, 0.5, 0.75]), PRICE_LABELS),
    })


def load_data(spark, path: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """The enriched and the raw table, both lazy over one source."""
    from tillscope.sources.transactions import read_transactions

    raw = read_transactions(spark, path, fmt)
    return enrich(raw), raw
