"""Tests across groups from one pass of sufficient statistics.

Facts are aggregated to (test, level) or (test, level, outcome) rows; the
statistic and its p-value are expressions over those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.functions.moments import corr
from tillscope.functions.order_stats import all_present, exact_quantiles, few_groups, is_number, per_group
from tillscope.model import ALPHA
from tillscope.operators.series import monthly_positions


def flag(df: DataFrame, p: str = "p_value") -> DataFrame:
    """Add ``significant``: the unrounded p-value is below 0.05."""
    return df.withColumn("significant", F.col(p) < ALPHA)


def anova_from_groups(groups: DataFrame, test: Sequence[str] = ()) -> DataFrame:
    """One-way F per ``test`` from rows (test, n, mean, var_pop) of each level.

    NULL statistic where there is one level or no variation within levels.
    """
    keys = [f"`{c}`" for c in test]
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    sums = (groups.where("n > 0")
            .selectExpr("*", f"sum(n * mean) OVER ({part}) / sum(n) OVER ({part}) AS gm")
            .groupBy(*test).agg(F.expr("count(*) AS k"), F.expr("sum(n) AS n"),
                                F.expr("sum(n * power(mean - gm, 2)) AS ssb"), F.expr("sum(n * var_pop) AS ssw")))
    return (sums.selectExpr(*keys, "k", "n", "ssb", "ssw", "k - 1 AS df1", "n - k AS df2",
                            "try_divide(ssb / nullif(k - 1, 0), try_divide(ssw, n - k)) AS f_stat")
            .withColumn("p_value", F.expr(f"CASE WHEN f_stat IS NOT NULL THEN {sp.f_sf('f_stat', 'df1', 'df2')} END"))
            .withColumn("eta_squared", F.expr("try_divide(ssb, ssb + ssw)")))


def group_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return (df.where(all_present(by) & is_number(v)).groupBy(*by)
            .agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("var_pop")))


def anova(df: DataFrame, by: str, value: str = "final_price") -> DataFrame:
    """One-way analysis of variance of ``value`` across the levels of ``by``."""
    return flag(anova_from_groups(group_moments(df, [by], value)))


def anova_cells(df: DataFrame, by: Sequence[str] = ("product_category", "customer_segment"),
                value: str = "final_price") -> DataFrame:
    """One-way analysis of variance across the cells of several categories."""
    return flag(anova_from_groups(group_moments(df, list(by), value)))


def chi2_from_cells(cells: DataFrame, test: Sequence[str] = (), yates: bool = True) -> DataFrame:
    """χ² of independence per ``test`` from the non-empty cells (test, a, b, n).

    Empty cells add their expected count, which is what the non-empty ones leave
    of the total, so no level-by-level grid is built. With one degree of
    freedom each deviation is reduced by at most one half.
    """
    keys = [f"`{c}`" for c in test]

    def over(*cols):
        names = [*keys, *cols]
        return f"OVER (PARTITION BY {', '.join(names)})" if names else "OVER ()"

    sums = (cells.where("n > 0")
            .selectExpr("*", f"sum(n) {over('a')} AS ra", f"sum(n) {over('b')} AS cb", f"sum(n) {over()} AS total",
                        f"count(*) {over('a')} AS wa", f"count(*) {over('b')} AS wb")
            .withColumn("e", F.expr("CAST(ra AS DOUBLE) * cb / total"))
            .groupBy(*test)
            .agg(F.expr("max(total) AS n"), F.expr("CAST(round(sum(1D / wa)) AS BIGINT) AS r"),
                 F.expr("CAST(round(sum(1D / wb)) AS BIGINT) AS c"), F.expr("count(*) AS filled"),
                 F.expr("sum(power(n - e, 2) / e) AS dev"), F.expr("sum(e) AS seen"), F.expr("max(abs(n - e)) AS off"),
                 F.expr("sum(1D / ra / wa) AS inv_a"), F.expr("sum(1D / cb / wb) AS inv_b")))
    plain = "dev + CASE WHEN filled < r * c THEN greatest(0D, n - seen) ELSE 0D END"
    inverse = "n * inv_a * inv_b"
    corrected = f"power(off - least(0.5D, off), 2) * {inverse}"
    chosen = f"CASE WHEN dof = 1 THEN {corrected} ELSE {plain} END" if yates else plain
    return (sums.withColumn("dof", F.expr("(r - 1) * (c - 1)"))
            .withColumn("chi2", F.expr(f"CASE WHEN dof > 0 THEN {chosen} END"))
            .withColumn("chi2_plain", F.expr(f"CASE WHEN dof > 0 THEN {plain} END"))
            .withColumn("p_value", F.expr(f"CASE WHEN chi2 IS NOT NULL THEN {sp.chi2_sf('chi2', 'dof')} END"))
            .withColumn("cramers_v", F.expr("sqrt(chi2_plain / (n * nullif(least(r, c) - 1, 0)))"))
            .select(*test, "n", "r", "c", "dof", "chi2", "p_value", "cramers_v"))


def cells_of(df: DataFrame, a: str, b: str) -> DataFrame:
    return (df.where(all_present([a, b])).groupBy(F.col(a).alias("a"), F.col(b).alias("b"))
            .agg(F.count("*").alias("n")))


def chi2_independence(df: DataFrame, a: str, b: str = "return_status", yates: bool = True) -> DataFrame:
    return flag(chi2_from_cells(cells_of(df, a, b), yates=yates))


def uniform_table(df: DataFrame, by: str) -> DataFrame:
    """Observed and expected counts per level under an even split."""
    counts = df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("level")).agg(F.count("*").alias("observed"))
    return (counts.withColumn("expected", counts.agg(F.expr("sum(observed) / count(*)")).scalar())
            .withColumn("deviation_pct", F.expr("(observed - expected) / expected * 100")).orderBy("level"))


def chi2_uniform(df: DataFrame, by: str) -> DataFrame:
    """Goodness of fit against an even split over the observed levels."""
    sums = uniform_table(df, by).agg(
        F.expr("count(*) AS k"), F.expr("sum(power(observed - expected, 2) / expected) AS chi2"),
        F.expr("max(abs(deviation_pct)) AS max_dev_pct"))
    return flag(sums.withColumn("dof", F.expr("k - 1"))
                .withColumn("p_value", F.expr(f"CASE WHEN dof > 0 THEN {sp.chi2_sf('chi2', 'dof')} END")))


def levene(df: DataFrame, by: str, value: str = "final_price") -> DataFrame:
    """Equality of variances: analysis of variance of distances to the group median."""
    rows = (df.select(by, F.col(value).cast("double").alias("_x"))
            .where(all_present([by]) & is_number(F.col("_x"))))
    small = few_groups(rows, [by])
    medians = exact_quantiles(rows, "_x", [0.5], [by], small).select(by, F.get("q", F.lit(0)).alias("_m"))
    apart = (rows.join(per_group(medians, small), by)
             .select(by, F.abs(F.col("_x") - F.col("_m")).alias("_z")))
    out = anova_from_groups(group_moments(apart, [by], "_z"))
    return flag(out.select("k", "n", F.col("f_stat").alias("w_stat"), "p_value"))


def trend_test(df: DataFrame, by: str | None = None, min_months: int = 3) -> DataFrame:
    """Slope, r² and p of monthly revenue against the month's position.

    Series with fewer than three months are left out.
    """
    keys = [by] if by else []
    fits = (monthly_positions(df, by).groupBy(*keys)
            .agg(F.count("*").alias("months"), F.regr_slope("revenue", F.col("idx")).alias("slope"),
                 F.regr_intercept("revenue", F.col("idx")).alias("intercept"),
                 corr("revenue", "idx").alias("r")))
    out = (fits.where(F.col("months") >= min_months).withColumn("r2", F.col("r") * F.col("r"))
           .withColumn("p_value", F.expr(sp.r_pvalue("r", "months"))))
    return flag(out.select(*keys, "months", "slope", "intercept", "r2", "p_value"))


def trend_count(df: DataFrame, by: str) -> DataFrame:
    """How many series show a significant trend."""
    return trend_test(df, by).agg(F.count_if("significant").alias("significant"), F.count("*").alias("series"))


# --- many tests at once ------------------------------------------------------

def bh_adjust(df: DataFrame, p: str = "p_value", ids: Sequence[str] = ()) -> DataFrame:
    """Benjamini–Hochberg adjusted p-values over all rows of a table of tests."""
    order = ", ".join(f"`{c}`" for c in [p, *ids])
    return (df.selectExpr("*", "count(*) OVER () AS _n", f"row_number() OVER (ORDER BY {order}) AS _rank")
            .withColumn("_raw", F.expr(f"`{p}` * _n / _rank"))
            .withColumn("p_adjusted", F.expr(
                "least(1D, greatest(0D, min(_raw) OVER (ORDER BY _rank DESC ROWS UNBOUNDED PRECEDING)))"))
            .drop("_n", "_rank", "_raw"))


def dimension_cells(df: DataFrame, dims: Sequence[str], value: str, outcome: str) -> DataFrame:
    """One pass over the facts: moments per (dimension, level, outcome)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("level")) for c in dims])
    return (df.select(F.explode(pairs).alias("d"), F.col(value).cast("double").alias("v"), F.col(outcome).alias("b"))
            .select("d.dim", "d.level", "b", "v").where("level IS NOT NULL")
            .groupBy("dim", "level", "b")
            .agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.avg("v").alias("mean"), F.var_pop("v").alias("var_pop")))


def fdr_battery(df: DataFrame, dims: Sequence[str], value: str = "final_price",
                outcome: str = "return_status") -> DataFrame:
    """ANOVA of ``value`` and χ² of ``outcome`` for every dimension, with adjusted p-values.

    All tests share one aggregation; (dimension, level, outcome) moments are
    merged to (dimension, level) moments for the ANOVA.
    """
    cells = dimension_cells(df, dims, value, outcome)
    levels = (cells.where("nv > 0")
              .selectExpr("*", "sum(nv * mean) OVER (PARTITION BY dim, level) / sum(nv) OVER (PARTITION BY dim, level) AS m")
              .groupBy("dim", "level")
              .agg(F.expr("sum(nv) AS n"), F.expr("max(m) AS mean"),
                   F.expr("sum(nv * (var_pop + power(mean - m, 2))) / sum(nv) AS var_pop")))
    f_tests = anova_from_groups(levels, ["dim"]).select(
        F.concat(F.lit(f"ANOVA: {value} ~ "), "dim").alias("test"), F.col("f_stat").alias("statistic"), "p_value")
    pairs = cells.where("b IS NOT NULL").selectExpr("dim", "level AS a", "b", "n")
    chi_tests = chi2_from_cells(pairs, ["dim"]).select(
        F.concat(F.lit(f"Chi-square: {outcome} ~ "), "dim").alias("test"), F.col("chi2").alias("statistic"), "p_value")
    table = bh_adjust(f_tests.unionByName(chi_tests), "p_value", ["test"])
    return (table.withColumn("significant_raw", F.col("p_value") < ALPHA)
            .withColumn("significant_bh", F.col("p_adjusted") < ALPHA).orderBy("p_value", "test"))


def fdr_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Number of tests, and of significant ones before and after adjustment."""
    return fdr_battery(df, dims).agg(F.count("*").alias("tests"), F.count_if("significant_raw").alias("significant_raw"),
                                     F.count_if("significant_bh").alias("significant_bh"))


def effect_sizes(df: DataFrame, by: str, value: str = "final_price", outcome: str = "return_status") -> DataFrame:
    """η² of ``value`` and Cramér's V of ``outcome`` on the data as they are."""
    eta = anova(df, by, value).select("eta_squared").scalar()
    v = chi2_independence(df, by, outcome).select("cramers_v").scalar()
    return df.sparkSession.range(1).select(eta.alias("eta_squared"), v.alias("cramers_v"))

