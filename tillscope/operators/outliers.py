"""Outlier fences, flagged rows and the effect of the fence width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import quantiles_of
from tillscope.functions.sketches import approx_quantiles
from tillscope.model import FENCE_WIDTHS


def fences(df: DataFrame, value: str, method: str = "iqr", k: float | None = None, approx: bool = False) -> Column:
    """Lower and upper bound as a one-row scalar subquery (struct ``lo``, ``hi``); ``approx``: of quartiles within a rank error."""
    if method == "iqr":
        k = 1.5 if k is None else k
        q = F.col("q")
        quartiles = approx_quantiles(df, value, [0.25, 0.75]).select("q").scalar() if approx else quantiles_of(df, value, [0.25, 0.75])
        ends = df.sparkSession.range(1).select(quartiles.alias("q"))
        iqr = F.get(q, F.lit(1)) - F.get(q, F.lit(0))
        pair = F.struct((F.get(q, F.lit(0)) - iqr * k).alias("lo"), (F.get(q, F.lit(1)) + iqr * k).alias("hi"))
    elif method == "zscore":
        k = 3.0 if k is None else k
        ends = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
        pair = F.struct((F.col("m") - F.col("s") * k).alias("lo"), (F.col("m") + F.col("s") * k).alias("hi"))
    else:
        raise ValueError(f"unknown method: {method}")
    return ends.select(pair).scalar()


def flagged(df: DataFrame, value: str, method: str = "iqr", k: float | None = None, approx: bool = False) -> DataFrame:
    """``df`` with the fence ``_f`` and the flag ``_out``."""
    v = F.col(value)
    out = (v < F.col("_f.lo")) | (v > F.col("_f.hi"))
    return df.withColumn("_f", fences(df, value, method, k, approx)).withColumn("_out", F.coalesce(out, F.lit(False)))


def outliers(df: DataFrame, value: str, method: str = "iqr", k: float | None = None, approx: bool = False) -> DataFrame:
    """Number and percentage of rows outside the fences."""
    return (flagged(df, value, method, k, approx)
            .agg(F.count_if("_out").alias("outliers"),
                 (F.try_divide(F.count_if("_out"), F.count("*")) * 100).alias("outlier_pct"),
                 F.first("_f").alias("f"))
            .select("outliers", "outlier_pct", F.col("f.lo").alias("lower"), F.col("f.hi").alias("upper")))


def outlier_rows(df: DataFrame, value: str, order: Sequence[str], method: str = "iqr",
                 limit: int = 20) -> DataFrame:
    """The first flagged rows in the given order."""
    return (flagged(df, value, method).where("_out").drop("_f", "_out")
            .orderBy(*order).limit(limit))


def outlier_sensitivity(df: DataFrame, value: str, widths: Sequence[float] = FENCE_WIDTHS) -> DataFrame:
    """Flagged rows at several fence widths, all counted in one scan."""
    q, v = F.col("q"), F.col(value)
    iqr = F.get(q, F.lit(1)) - F.get(q, F.lit(0))

    def edge(i, k, sign):
        return F.get(q, F.lit(i)) + iqr * (sign * k)

    rows = df.select(value).withColumn("q", quantiles_of(df, value, [0.25, 0.75]))
    per_width = [F.struct(
        F.lit(float(k)).alias("width"), F.first(edge(0, k, -1)).alias("lower"), F.first(edge(1, k, 1)).alias("upper"),
        F.count_if((v < edge(0, k, -1)) | (v > edge(1, k, 1))).alias("outliers"),
        F.count("*").alias("n")) for k in widths]
    table = (rows.agg(F.array(*per_width).alias("w")).select(F.inline("w"))
             .withColumn("outlier_pct", F.try_divide("outliers", "n") * 100).drop("n"))
    return table


def outlier_spread(df: DataFrame, value: str, widths: Sequence[float] = FENCE_WIDTHS) -> DataFrame:
    """Range of the flagged percentage over the fence widths."""
    return (outlier_sensitivity(df, value, widths)
            .agg(F.min("outlier_pct").alias("min_pct"), F.max("outlier_pct").alias("max_pct"),
                 (F.max("outlier_pct") - F.min("outlier_pct")).alias("spread")))
