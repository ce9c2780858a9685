"""Rank-based tests on distributed ranks of the distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.functions.small_samples import ks_p, mann_whitney_p
from tillscope.functions.order_stats import all_present, average_rank, is_number, ranked_counts
from tillscope.operators.group_tests import flag


def value_counts(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows per (group, value): equal values travel as one row."""
    return (df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
            .where(all_present(["g"]) & is_number(F.col("v")))
            .groupBy("g", "v").agg(F.count("*").alias("n")))


def kruskal(df: DataFrame, by: str, value: str = "final_price") -> DataFrame:
    """Kruskal–Wallis H with tie correction."""
    ranked = ranked_counts(value_counts(df, by, value), ["v"], ["n"]).withColumn("rank", average_rank())
    groups = ranked.groupBy("g").agg(
        F.expr("sum(n) AS n"), F.expr("sum(n * rank) / sum(n) AS mean_rank"),
        F.expr("sum(n * (power(CAST(peers_n AS DOUBLE), 2) - 1)) AS ties"))
    sums = (groups.selectExpr("*", "CAST(sum(n) OVER () AS DOUBLE) AS total")
            .agg(F.expr("count(*) AS k"), F.expr("max(total) AS total"), F.expr("sum(ties) AS ties"),
                 F.expr("12 / (max(total) * (max(total) + 1)) * sum(n * power(mean_rank - (total + 1) / 2, 2)) AS h0")))
    out = (sums.withColumn("h_stat", F.expr("try_divide(h0, 1 - ties / (power(total, 3) - total))"))
           .withColumn("p_value", F.expr(f"CASE WHEN k > 1 THEN {sp.chi2_sf('h_stat', 'k - 1')} END")))
    return flag(out.select("k", F.col("total").cast("long").alias("n"), "h_stat", "p_value"))


def two_sides(df: DataFrame, by: str, a: str, b: str, value: str) -> DataFrame:
    """Distinct values of two groups with the row counts ``na``, ``nb`` and ``n``."""
    return (df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
            .where(F.col("g").isin(a, b) & is_number(F.col("v")))
            .groupBy("v").agg(F.count_if(F.col("g") == a).alias("na"), F.count_if(F.col("g") == b).alias("nb"),
                              F.count("*").alias("n")))


def mann_whitney(df: DataFrame, by: str, a: str, b: str, value: str = "final_price") -> DataFrame:
    """U of group ``a`` and its two-sided p.

    Exact where a group has 8 rows or fewer and no values tie, else the normal
    one with tie and continuity correction.
    """
    ranked = ranked_counts(two_sides(df, by, a, b, value), ["v"], ["n"]).withColumn("rank", average_rank())
    sums = ranked.agg(F.expr("CAST(sum(na) AS DOUBLE) AS a"), F.expr("CAST(sum(nb) AS DOUBLE) AS b"),
                      F.expr("sum(na * rank) AS ra"), F.expr("sum(power(CAST(n AS DOUBLE), 3) - n) AS ties"))
    told = (sums.where("a > 0 AND b > 0")
            .selectExpr("CAST(a AS BIGINT) AS n_a", "CAST(b AS BIGINT) AS n_b", "ra - a * (a + 1) / 2 AS u_stat", "ties",
                        "a * b / 2 AS mu", "sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS sd")
            .withColumn("z", F.expr("try_divide(greatest(0D, abs(u_stat - mu) - 0.5D), sd)")))
    exact = F.when(F.col("ties") == 0, mann_whitney_p(F.col("n_a"), F.col("n_b"), F.col("u_stat")))
    return flag(told.withColumn("p_value", F.coalesce(exact, F.expr(sp.normal_two_sided("z")))).select("n_a", "n_b", "u_stat", "p_value"))


def ks_2samp(df: DataFrame, by: str, a: str, b: str, value: str = "final_price") -> DataFrame:
    """Largest distance of the two distribution functions and its p.

    Exact for groups of at most 10,000 rows, taking all orders of the rows as
    equally likely. Beyond that, the limiting distribution is evaluated at
    (√m + 0.12 + 0.11/√m)·D with m the effective sample size.
    """
    ranked = ranked_counts(two_sides(df, by, a, b, value), ["v"], ["na", "nb"])
    totals = two_sides(df, by, a, b, value).agg(F.struct(F.sum("na").alias("a"), F.sum("nb").alias("b"))).scalar()
    out = (ranked.withColumn("t", totals).where("t.a > 0 AND t.b > 0")
           .agg(F.expr("max(t.a) AS n_a"), F.expr("max(t.b) AS n_b"),
                F.expr("max(abs(through_na / t.a - through_nb / t.b)) AS d_stat"),
                F.expr("max(abs(CAST(through_na AS DECIMAL(19,0)) * t.b - CAST(through_nb AS DECIMAL(19,0)) * t.a)) AS h"))
           .where("n_a IS NOT NULL")
           .withColumn("m", F.expr("sqrt(CAST(n_a AS DOUBLE) * n_b / (n_a + n_b))")))
    # of whole numbers below 2^53 where it is used
    exact = ks_p(F.col("n_a"), F.col("n_b"), F.col("h").cast("double"))
    limit = F.expr(sp.kolmogorov_sf("(m + 0.12D + 0.11D / m) * d_stat"))
    return flag(out.withColumn("p_value", F.coalesce(exact, limit)).select("n_a", "n_b", "d_stat", "p_value"))
