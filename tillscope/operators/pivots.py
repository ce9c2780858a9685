"""Pivots, contingency tables and their long forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import all_present


#: Levels that may become columns; Spark's own limit for a pivot.
MOST_LEVELS = 10_000


def levels_of(df: DataFrame, col: str) -> list[str]:
    """Sorted levels of a column, needed to name columns; more than ``MOST_LEVELS`` are an error."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MOST_LEVELS + 1).collect()
    if len(rows) > MOST_LEVELS:
        raise ValueError(f"{col} has more than {MOST_LEVELS} levels")
    return sorted(r[0] for r in rows)


def pivot_agg(df: DataFrame, rows: str, cols: str, value: str = "final_price", agg: str = "avg",
              levels: Sequence[str] | None = None) -> DataFrame:
    """``agg`` of ``value`` per row and column level.

    Give ``levels`` where they are known; finding them takes a scan of one column.
    """
    base = df.where(all_present([rows, cols]))
    pivot = base.groupBy(rows).pivot(cols, list(levels or levels_of(base, cols)))
    return pivot.agg(getattr(F, agg)(value)).orderBy(rows)


def crosstab(df: DataFrame, a: str, b: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Counts of ``a`` by ``b``; a combination that does not occur counts 0."""
    base = df.where(all_present([a, b]))
    levels = list(levels or levels_of(base, b))
    return base.groupBy(a).pivot(b, levels).count().na.fill(0, levels).orderBy(a)


def segment_mix_wide(df: DataFrame, by: str = "order_month", of: str = "customer_segment",
                     levels: Sequence[str] | None = None) -> DataFrame:
    """Percentage of each ``of`` level within each ``by`` level."""
    levels = list(levels or levels_of(df, of))
    counts = crosstab(df, by, of, levels)
    whole = sum((F.col(c) for c in levels[1:]), F.col(levels[0]))
    return counts.select(by, *[(F.col(c) * 100 / whole).alias(c) for c in levels]).orderBy(by)


def melt(df: DataFrame, ids: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long over all columns but ``ids``."""
    return df.unpivot(list(ids), [c for c in df.columns if c not in ids], name, value)


def segment_mix(df: DataFrame, by: str = "order_month", of: str = "customer_segment",
                levels: Sequence[str] | None = None) -> DataFrame:
    return melt(segment_mix_wide(df, by, of, levels), [by], "segment", "share")


def agg_transpose(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Range, mean and sample deviation, one row per column.

    All columns are aggregated in one pass; the one-row result is then unfolded.
    """
    wide = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
                             F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "s").select("column", "s.*")
