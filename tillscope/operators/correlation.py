"""Correlation, least-squares lines and collinearity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions import special as sp
from tillscope.functions.moments import corr, correlation
from tillscope.functions.order_stats import GROUP_BROADCAST_LIMIT, average_rank, is_number, ranked_counts
from tillscope.functions.staging import shuffle_width, stage
from tillscope.operators.group_tests import flag
from tillscope.operators.metrics import stacked

VIF_HIGH, VIF_MODERATE = 10, 5
PAIRS_PER_SCAN = 6


def upper_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (x, y, r) per unordered pair, the diagonal included.

    Pairs are aggregated a few at a time: each correlation keeps six running
    values, and many at once compile to a method too large for the JIT.
    """
    pairs = [(cols[i], cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    parts = []
    for at in range(0, len(pairs), PAIRS_PER_SCAN):
        chunk = pairs[at:at + PAIRS_PER_SCAN]
        wide = df.selectExpr(*[f"struct('{x}' AS x, '{y}' AS y, {correlation(f'`{x}`', f'`{y}`')} AS r) AS p{k}"
                               for k, (x, y) in enumerate(chunk)])
        parts.append(wide.selectExpr(f"inline(array({', '.join(f'p{k}' for k in range(len(chunk)))}))"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row (x, y, r) per ordered pair."""
    return upper_correlations(df, cols).selectExpr(
        "inline(CASE WHEN x = y THEN array(struct(x, y, r)) ELSE array(struct(x, y, r), struct(y AS x, x AS y, r)) END)")


def with_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace every column by the average rank of its present values, and stage the result.

    Ranks are found on the distinct values. Those of a column with few values
    are broadcast to the rows. Cells of the other columns meet the rank of
    their value in one join, and return to rows in one aggregate by id, each
    cell as an id, a column's number and a rank; rows get the id in a staged
    copy, so that it stays the same if a task is run again. A value shared by
    many rows is one row of the rank table, and the side of the cells is split
    by AQE where it is skewed. Rows without any value count in no correlation.
    """
    rows = stage(df.select(F.monotonically_increasing_id().alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols]), "rows")
    counts = stage(stacked(rows, cols).groupBy("column", "value").agg(F.count("*").alias("n")), "value-counts")  # read several times
    ranks = stage(ranked_counts(counts, ["value"], ["n"], ["column"])
                  .select("column", "value", average_rank().alias("rank")), "ranks")
    levels = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    many = [c for c in cols if levels.get(c, 0) > GROUP_BROADCAST_LIMIT]
    few = [c for c in cols if c not in many]
    near = rows
    for i, c in enumerate(few):
        told = ranks.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("rank").alias(f"_r{i}"))
        near = near.join(F.broadcast(told), F.col(f"`{c}`") == F.col("_v"), "left").drop("_v")
    own = [F.col(f"_r{i}").alias(c) for i, c in enumerate(few)]
    if not many:
        return stage(near.select(*own), "ranked-rows")
    number = F.expr("CASE column " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(many)) + " END")
    far = stacked(rows, many, ["_id"]).join(ranks.where(F.col("column").isin(many)), ["column", "value"])
    none = F.lit(None).cast("double")
    cells = (far.select("_id", number.alias("_n"), "rank", *[none.alias(f"_r{i}") for i in range(len(few))])
             .unionByName(near.select("_id", F.lit(-1).alias("_n"), none.alias("rank"), *[f"_r{i}" for i in range(len(few))]))) if few else far.select("_id", number.alias("_n"), "rank")
    # a cell meets no other of its row before the shuffle, so nothing is added up there
    back = cells.repartition(shuffle_width(df.sparkSession), "_id").groupBy("_id").agg(
        *[F.max(F.when(F.col("_n") == i, F.col("rank"))).alias(c) for i, c in enumerate(many)], *[F.max(f"_r{i}").alias(c) for i, c in enumerate(few)])
    return stage(back.select(*cols), "ranked-rows")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Correlation matrix in long form, Pearson or Spearman (average ranks)."""
    if method == "pearson":
        return pair_correlations(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols)
    if method == "spearman":
        return pair_correlations(with_ranks(df, cols), cols)
    raise ValueError(f"unknown method: {method}")


def pearson_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of two columns with its two-sided p-value."""
    rows = df.where(is_number(F.col(x)) & is_number(F.col(y)))
    return flag(rows.agg(F.count("*").alias("n"), corr(x, y).alias("r"))
                .withColumn("p_value", F.expr(sp.r_pvalue("r", "n"))))


def point_biserial(df: DataFrame, binary: str, cols: Sequence[str]) -> DataFrame:
    """Correlation of a 0/1 column with each numeric column, in one pass."""
    wide = df.agg(*[F.expr(f"struct(count(CASE WHEN `{c}` IS NOT NULL THEN `{binary}` END) AS n, "
                           f"{correlation(f'`{binary}`', f'`{c}`')} AS r)").alias(c) for c in cols])
    return flag(wide.unpivot([], list(cols), "variable", "s").select("variable", "s.*")
                .withColumn("p_value", F.expr(sp.r_pvalue("r", "n"))))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x with the range of x."""
    rows = df.where(is_number(F.col(x)) & is_number(F.col(y)))
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                    F.min(F.col(x).cast("double")).alias("x_min"), F.max(F.col(x).cast("double")).alias("x_max"))


def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """The fitted line at evenly spaced x between the extremes."""
    return (line_fit(df, x, y).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("x", F.expr(f"x_min + (x_max - x_min) * point / {points - 1}"))
            .select("point", "x", F.expr("slope * x + intercept").alias("y")))


def residualise(df: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """Add the residual of ``y`` after a line on ``x``."""
    fit = line_fit(df, x, y).select(F.struct("slope", "intercept")).scalar()
    return (df.withColumn("_fit", fit)
            .withColumn(out, F.col(y) - (F.col("_fit.slope") * F.col(x) + F.col("_fit.intercept"))).drop("_fit"))


def partial_corr(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of x and y before and after removing z, from three correlations.

    The p-value of the partial correlation uses n − 2, as for a plain one.
    """
    rows = df.where(is_number(F.col(x)) & is_number(F.col(y)) & is_number(F.col(z)))
    sums = rows.agg(F.count("*").alias("n"), corr(x, y).alias("raw_r"), corr(x, z).alias("xz"), corr(y, z).alias("yz"))
    part = "try_divide(raw_r - xz * yz, sqrt((1 - xz * xz) * (1 - yz * yz)))"
    return (sums.withColumn("partial_r", F.expr(part))
            .withColumn("raw_p", F.expr(sp.r_pvalue("raw_r", "n")))
            .withColumn("partial_p", F.expr(sp.r_pvalue("partial_r", "n")))
            .withColumn("strengthens", F.expr("abs(partial_r) > abs(raw_r)"))
            .select("n", "raw_r", "raw_p", "partial_r", "partial_p", "strengthens"))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation of each column given the others, largest first.

    The correlation matrix is one row of k² numbers; the k small regressions
    are solved on that row. A constant column correlates with nothing.
    """
    row = upper_correlations(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), cols).agg(
        F.collect_list(F.struct("x", "y", "r")).alias("pairs"))

    @F.pandas_udf("array<double>")
    def inflate(pairs: pd.Series) -> pd.Series:
        return pd.Series([inflation(cols, p) for p in pairs])

    names = ", ".join(f"'{c}'" for c in cols)
    return (row.select(F.posexplode(inflate("pairs")).alias("pos", "vif"))
            .select(F.expr(f"get(array({names}), pos)").alias("variable"), "vif")
            .withColumn("flag", F.expr(f"CASE WHEN vif >= {VIF_HIGH} THEN 'High' "
                                       f"WHEN vif >= {VIF_MODERATE} THEN 'Moderate' ELSE 'OK' END"))
            .orderBy(F.desc("vif"), "variable"))


def inflation(cols, pairs) -> list[float]:
    """1 / (1 − R²) of each variable from the correlations of all pairs."""
    k = len(cols)
    at = {c: i for i, c in enumerate(cols)}
    m, varies = np.eye(k), [False] * k
    for p in pairs:
        i, j = at[p["x"]], at[p["y"]]
        usable = p["r"] is not None and np.isfinite(p["r"])
        if i == j:
            varies[i] = usable
        else:
            m[i, j] = m[j, i] = p["r"] if usable else 0.0
    out = []
    for i in range(k):
        rest = [j for j in range(k) if j != i and varies[j]]
        c = m[i, rest]
        r2 = float(c @ np.linalg.pinv(m[np.ix_(rest, rest)], rcond=1e-12, hermitian=True) @ c) if varies[i] and rest else 0.0
        out.append(1 / (1 - r2) if r2 < 1 - 1e-12 else float("inf"))
    return out
