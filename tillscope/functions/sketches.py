"""Mergeable summaries of columns, kept as rows and united over any slice without the facts.

A quantile sketch (KLL) of a group answers quantiles whose true rank is off by
at most about ``RANK_ERROR`` of the rows, whatever the values are: sorted, tied or
heavy-tailed. A distinct sketch (HyperLogLog) gives counts with a relative
standard error of ``DISTINCT_ERROR``. Both have a fixed size, combine map-side,
and are as good after merging as if made at once. Missing values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import all_present, is_number

#: Size of a quantile sketch; with 2,048, ranks are off by 0.2 % of the rows or less in 99 % of all cases.
QUANTILE_K, RANK_ERROR = 2_048, 0.002
#: Logarithm of the registers of a distinct sketch; the error is 1.04 / sqrt(2^14).
DISTINCT_BITS, DISTINCT_ERROR = 14, 0.0082


def quantile_sketches(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, sketch): one sketch of ``value`` for each group."""
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(is_number(F.col("_v")) & all_present(by))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", QUANTILE_K).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, q): quantiles of the union of the sketches of each group; none for an empty group."""
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    whole = sketches.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", QUANTILE_K).alias("_s")).where("n > 0")
    return whole.select(*by, "n", F.kll_sketch_get_quantile_double("_s", ranks).alias("q"))


def approx_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """As ``exact_quantiles`` in one pass, within the rank error: values of the data, not interpolated."""
    return merged_quantiles(quantile_sketches(df, value, by), probs, by)


def distinct_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, sketch): a sketch of the distinct values of each column in each group, of text values."""
    wide = df.where(all_present(by)).groupBy(*by).agg(*[F.hll_sketch_agg(_text(df, c), F.lit(DISTINCT_BITS)).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "sketch")


def _text(df: DataFrame, c: str) -> Column:
    """A value as text, minus zero as zero, NaN as missing."""
    if df.schema[c].dataType.simpleString() not in ("double", "float"):
        return F.col(c).cast("string")
    return F.when(is_number(F.col(c)), F.col(c) + F.lit(0.0).cast(df.schema[c].dataType)).cast("string")


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, column, distinct): estimates for the union of the sketches of each group and column."""
    return sketches.groupBy(*by, "column").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
