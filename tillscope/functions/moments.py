"""Aggregates that stay defined on constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: str, y: str) -> str:
    """SQL for the correlation over the rows where both are present; NULL if one is constant.

    The built-in ``corr`` divides by zero there, an error in ANSI mode.
    """
    return f"try_divide(regr_sxy({y}, {x}), sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})))"


def corr(x: str, y: str) -> Column:
    return F.expr(correlation(f"`{x}`", f"`{y}`"))
