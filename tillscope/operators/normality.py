"""Normality tests and quantile-quantile points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.functions.order_stats import is_number, ranked_counts
from tillscope.model import ALPHA
from tillscope.operators.sampling import sample_n

SHAPIRO_MAX = 5000
POINTS_PER_TASK = 1_000_000

# --- fixed values: published coefficients of the W approximation --------------
W_LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
W_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)
SMALL_GAMMA = (-2.273, 0.459)
# ------------------------------------------------------------------------------


def shapiro_wilk(df: DataFrame, value: str, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """W and p on a seeded sample of at most 5,000 rows (n ≥ 4).

    Weights come from normal scores of the ranks; the two largest are corrected
    by polynomials in 1/√n. The window runs over the sample only.
    """
    sample = (sample_n(df.where(is_number(F.col(value))), SHAPIRO_MAX, seed, key)
              .select(F.col(value).cast("double").alias("x")))
    scored = (sample.selectExpr("x", "row_number() OVER (ORDER BY x) AS i", "CAST(count(*) OVER () AS DOUBLE) AS n")
              .withColumn("m", F.expr(sp.normal_quantile("(i - 0.375e0) / (n + 0.25e0)")))
              .selectExpr("*", "sum(m * m) OVER () AS mm", "max(m) OVER () AS m1",
                          "max(CASE WHEN i = n - 1 THEN m END) OVER () AS m2", "1e0 / sqrt(n) AS u"))
    weights = (scored
               .withColumn("a1", F.expr(f"{sp.horner(W_LAST, 'u')} + m1 / sqrt(mm)"))
               .withColumn("a2", F.expr(f"{sp.horner(W_SECOND, 'u')} + m2 / sqrt(mm)"))
               .withColumn("fac", F.expr(
                   "sqrt(CASE WHEN n > 5 THEN (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) "
                   "ELSE (mm - 2 * m1 * m1) / (1 - 2 * a1 * a1) END)"))
               .withColumn("a", F.expr(
                   "CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN n > 5 AND i = n - 1 THEN a2 "
                   "WHEN n > 5 AND i = 2 THEN -a2 ELSE m / fac END")))
    w = weights.agg(F.expr("CAST(max(n) AS BIGINT) AS n"),
                    F.expr("power(sum(a * x), 2) / nullif(var_pop(x) * count(*), 0) AS w_stat"))
    ln_n, y = "ln(CAST(n AS DOUBLE))", "ln(1e0 - w_stat)"
    gamma = sp.horner(SMALL_GAMMA, "CAST(n AS DOUBLE)")
    small_z = (f"(-ln({gamma} - {y}) - {sp.horner(SMALL_MEAN, 'CAST(n AS DOUBLE)')}) "
               f"/ exp({sp.horner(SMALL_LOG_SD, 'CAST(n AS DOUBLE)')})")
    large_z = f"({y} - {sp.horner(LARGE_MEAN, ln_n)}) / exp({sp.horner(LARGE_LOG_SD, ln_n)})"
    return (w.where("n >= 4")
            .withColumn("z", F.expr(f"CASE WHEN n > 11 THEN {large_z} WHEN {y} < {gamma} THEN {small_z} END"))
            .withColumn("p_value", F.expr(f"CASE WHEN z IS NULL AND w_stat IS NOT NULL THEN 0D ELSE {sp.normal_upper('z')} END"))
            .select("n", "w_stat", "p_value"))


def skew_z(n: str, g: str) -> str:
    """Normal score of a population skewness (D'Agostino)."""
    y = f"({g} * sqrt(({n} + 1e0) * ({n} + 3e0) / (6e0 * ({n} - 2e0))))"
    beta = (f"(3e0 * ({n} * {n} + 27e0 * {n} - 70e0) * ({n} + 1e0) * ({n} + 3e0) "
            f"/ (({n} - 2e0) * ({n} + 5e0) * ({n} + 7e0) * ({n} + 9e0)))")
    w2 = f"(sqrt(2e0 * ({beta} - 1e0)) - 1e0)"
    t = f"({y} / sqrt(2e0 / ({w2} - 1e0)))"
    return f"(ln({t} + sqrt({t} * {t} + 1e0)) / sqrt(0.5e0 * ln({w2})))"


def kurtosis_z(n: str, g: str) -> str:
    """Normal score of a population excess kurtosis (Anscombe and Glynn)."""
    mean = f"(3e0 * ({n} - 1e0) / ({n} + 1e0))"
    var = (f"(24e0 * {n} * ({n} - 2e0) * ({n} - 3e0) / (({n} + 1e0) * ({n} + 1e0) * ({n} + 3e0) * ({n} + 5e0)))")
    x = f"(({g} + 3e0 - {mean}) / sqrt({var}))"
    b = (f"(6e0 * ({n} * {n} - 5e0 * {n} + 2e0) / (({n} + 7e0) * ({n} + 9e0)) "
         f"* sqrt(6e0 * ({n} + 3e0) * ({n} + 5e0) / ({n} * ({n} - 2e0) * ({n} - 3e0))))")
    a = f"(6e0 + 8e0 / {b} * (2e0 / {b} + sqrt(1e0 + 4e0 / ({b} * {b}))))"
    den = f"(1e0 + {x} * sqrt(2e0 / ({a} - 4e0)))"
    cube = f"(sign({den}) * power((1e0 - 2e0 / {a}) / nullif(abs({den}), 0e0), 1e0 / 3e0))"
    return f"((1e0 - 2e0 / (9e0 * {a}) - {cube}) / sqrt(2e0 / (9e0 * {a})))"


def dagostino_k2(df: DataFrame, value: str) -> DataFrame:
    """K² from skewness and kurtosis of all rows; χ² with two degrees of freedom."""
    rows = df.select(F.col(value).cast("double").alias("x")).where(is_number(F.col("x")))
    sums = rows.agg(F.expr("count(*) AS rows"), F.expr("skewness(x) AS g1"), F.expr("kurtosis(x) AS g2"))
    return (sums.where("rows >= 8").withColumn("n", F.expr("CAST(rows AS DOUBLE)"))
            .withColumn("zs", F.expr(skew_z("n", "g1"))).withColumn("zk", F.expr(kurtosis_z("n", "g2")))
            .selectExpr("rows AS n", "zs * zs + zk * zk AS k2_stat", "exp(-(zs * zs + zk * zk) / 2) AS p_value"))


def normality(df: DataFrame, value: str, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Both tests and the verdict: normality is rejected if either rejects."""
    sw = shapiro_wilk(df, value, seed, key).select(F.struct("w_stat", "p_value")).scalar()
    k2 = dagostino_k2(df, value).select(F.struct("k2_stat", "p_value")).scalar()
    return (df.sparkSession.range(1).select(sw.alias("s"), k2.alias("k"))
            .select(F.col("s.w_stat").alias("w_stat"), F.col("s.p_value").alias("shapiro_p"),
                    F.col("k.k2_stat").alias("k2_stat"), F.col("k.p_value").alias("k2_p"),
                    ((F.col("s.p_value") < ALPHA) | (F.col("k.p_value") < ALPHA)).alias("rejected")))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Every value in order against the normal median of its order statistic.

    ``reference`` is the mean plus the quantile scaled by the population deviation. Ties are
    expanded from their counts in bounded chunks, spread over all tasks.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where(is_number(F.col("v")))
    totals = rows.agg(F.struct(F.count("*").cast("double").alias("n"), F.stddev_pop("v").alias("sd"), F.avg("v").alias("mean"))).scalar()
    ranked = ranked_counts(rows.groupBy("v").agg(F.count("*").alias("n")), ["v"], ["n"])
    chunks = (ranked.selectExpr("v", "through_n - n + 1 AS first", "through_n AS last")
              .selectExpr("v", "last", f"explode(sequence(first, last, {POINTS_PER_TASK}L)) AS start")
              .repartition("v", "start"))
    points = chunks.selectExpr("v", f"explode(sequence(start, least(last, start + {POINTS_PER_TASK - 1}))) AS position")
    median = ("CASE WHEN position = t.n THEN power(0.5e0, 1e0 / t.n) WHEN position = 1 THEN 1e0 - power(0.5e0, 1e0 / t.n) "
              "ELSE (position - 0.3175e0) / (t.n + 0.365e0) END")
    return (points.withColumn("t", totals).withColumn("p", F.expr(median))
            .withColumn("quantile", F.expr(sp.normal_quantile("p")))
            .selectExpr("position", "quantile", "v AS value", "t.mean + quantile * t.sd AS reference"))


def residual_shape(df: DataFrame, value: str) -> DataFrame:
    """Population skewness and excess kurtosis with the verdict on the shape."""
    return (df.agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
            .withColumn("near_normal", F.expr("abs(skewness) < 0.5 AND abs(kurtosis) < 1")))
