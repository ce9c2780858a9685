"""Power of the one-way F test and the smallest effect it can detect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.operators.metrics import value_table

F_MIN, F_MAX = 1e-5, 2.0


def anova_power(f: str, d: sp.Spark = sp.SPARK) -> str:
    """SQL for the power at Cohen's ``f`` given columns ``n``, ``df1``, ``df2``, ``f_crit``."""
    return f"(1e0 - {sp.noncentral_f_cdf('f_crit', 'df1', 'df2', f'({f}) * ({f}) * n', d)})"


def critical_f(alpha: float, d: sp.Spark = sp.SPARK) -> str:
    return sp.bisect("0e0", "1e5", 55, lambda x: f"{sp.f_sf(x, 'df1', 'df2', d)} > {sp.num(alpha)}", d)


def minimum_effect(target: float, d: sp.Spark = sp.SPARK) -> str:
    """SQL for the smallest ``f`` with the target power; NULL outside the searched range."""
    root = sp.bisect(sp.num(F_MIN), sp.num(F_MAX), 40, lambda x: f"{anova_power(x, d)} < {sp.num(target)}", d)
    return d.let("mde_", root, f"CASE WHEN mde_ > {sp.num(F_MIN)} AND mde_ < {sp.num(F_MAX * (1 - 1e-9))} THEN mde_ END")


def detectable_effects(df: DataFrame, cats: Sequence[str], alpha: float = 0.05, target: float = 0.8) -> DataFrame:
    """Rows, levels, critical F, smallest detectable f and its η² per category.

    The facts are read once, for the row and level counts of all categories.
    """
    sizes = (value_table(df, cats).groupBy(F.col("column").alias("category"))
             .agg(F.sum("n").alias("n"), F.count("value").alias("k")).where("k > 1 AND n > k")
             .selectExpr("category", "n", "k", "k - 1 AS df1", "n - k AS df2"))
    return (sizes.withColumn("f_crit", F.expr(critical_f(alpha)))
            .withColumn("mde", F.expr(minimum_effect(target)))
            .withColumn("mde_eta_squared", F.expr("mde * mde / (1 + mde * mde)")))


def anova_power_table(df: DataFrame, cats: Sequence[str], alpha: float = 0.05, target: float = 0.8,
                      points: int = 100) -> DataFrame:
    """Power over evenly spaced effect sizes up to twice the detectable one."""
    top = "greatest(0.15e0, coalesce(2 * mde, 0.15e0))"
    grid = (detectable_effects(df, cats, alpha, target)
            .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("cohens_f", F.expr(f"0.001e0 + ({top} - 0.001e0) * point / {points - 1}")))
    return grid.withColumn("power", F.expr(anova_power("cohens_f"))).select(
        "category", "n", "k", "mde", "point", "cohens_f", "power")
