"""Revenue models and the diagnosis of their residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import is_number, quantiles_of
from tillscope.functions.staging import stage
from tillscope.model import REVENUE_FEATURES as FEATURES
from tillscope.operators.forest import DEPTH, TREES, Forest, grow, importances, predicted
from tillscope.operators.group_tests import levene
from tillscope.operators.sampling import key_columns, split

MIN_ROWS = 200


def model_guard(df: DataFrame, label: str | None = None) -> DataFrame:
    """Whether a slice can be modelled: 200 rows and, for a class label, two classes."""
    rows = df.agg(F.count("*")).scalar()
    classes = F.lit(2) if label is None else df.agg(F.count_distinct(label)).scalar()
    return (df.sparkSession.range(1).select(rows.alias("rows_seen"), classes.alias("classes"))
            .withColumn("ok", F.expr(f"rows_seen >= {MIN_ROWS} AND classes >= 2")))


def require(df: DataFrame, label: str | None = None) -> None:
    if not model_guard(df, label).first()["ok"]:
        raise ValueError(f"needs at least {MIN_ROWS} rows" + (" and two classes" if label else ""))


def complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a value in all of the numeric ``cols``: those that a model can use, and that its sizes count."""
    for c in cols:
        df = df.where(is_number(F.col(c).cast("double")))
    return df


def prepared(df: DataFrame, features: Sequence[str], label: str, seed: int, key, staged: bool = False) -> DataFrame:
    """Label, features, both as they are and assembled, key and side of the split of the complete rows.

    All but the assembled features, which repeat others, is staged for repeated passes; ``staged``: ``df`` is, too.
    """
    marked = split(complete(df, [*features, label]), 25, seed, key, staged=staged)
    names = [c for c in (key or key_columns(df)) if c not in features]
    rows = stage(marked.select(*features, *names, F.col(label).cast("double").alias("label"), "is_test"), "model-input")
    return rows.withColumn("features", array_to_vector(F.array(*[F.col(f).cast("double") for f in features])))


def fit_ols(train: DataFrame):
    return LinearRegression(solver="normal", regParam=0.0).fit(train)


def ols_coefficients(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "final_price",
                     seed: int = 42, key=None) -> DataFrame:
    """Coefficients of the linear baseline, the intercept as ``(intercept)``."""
    data = prepared(df, features, label, seed, key)
    model = fit_ols(data.where("NOT is_test"))
    table = [*zip(features, map(float, model.coefficients)), ("(intercept)", float(model.intercept))]
    return df.sparkSession.createDataFrame(table, "feature string, coefficient double")


def ols_predictions(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "final_price",
                    seed: int = 42, key=None) -> DataFrame:
    """Actual, fitted and residual value of every test row."""
    data = prepared(df, features, label, seed, key)
    model = fit_ols(data.where("NOT is_test"))
    return (model.transform(data.where("is_test"))
            .select(F.col("label").alias("actual"), F.col("prediction").alias("fitted"),
                    (F.col("label") - F.col("prediction")).alias("residual")))


def fit_quality(predictions: DataFrame) -> DataFrame:
    """R² and mean absolute error of (actual, fitted) rows."""
    mean = predictions.agg(F.avg("actual")).scalar()
    return predictions.agg(
        (1 - F.sum(F.pow(F.col("actual") - F.col("fitted"), 2)) / F.sum(F.pow(F.col("actual") - mean, 2))).alias("r2"),
        F.avg(F.abs(F.col("actual") - F.col("fitted"))).alias("mae"), F.count("*").alias("n_test"))


def fit_forest(data: DataFrame, features: Sequence[str], seed: int, key, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Bagged regression trees that try every feature at every split, on the train rows of ``prepared``."""
    return grow(data, features, "label", ~F.col("is_test"), seed, key, trees, depth)


def forest_predictions(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "final_price",
                       seed: int = 42, key=None, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Actual, fitted and residual value of every test row, by the forest."""
    key = key or key_columns(df)
    df = stage(df.select(*dict.fromkeys([*key, *features, label])), "rows")
    require(df)
    data = prepared(df, features, label, seed, key, staged=True)
    return _fitted(fit_forest(data, features, seed, key, trees, depth), data)


def _fitted(forest: Forest, data: DataFrame) -> DataFrame:
    return (predicted(forest, data.where("is_test"))
            .select(F.col("label").alias("actual"), "fitted", (F.col("label") - F.col("fitted")).alias("residual")))


def revenue_models(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "final_price",
                   seed: int = 42, key=None, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Linear baseline and random forest: R², MAE, sizes, the gap in R² and the
    forest's feature importances."""
    key = key or key_columns(df)
    df = stage(df.select(*dict.fromkeys([*key, *features, label])), "rows")
    require(df)
    data = prepared(df, features, label, seed, key, staged=True)
    model = fit_ols(data.where("NOT is_test"))
    line = model.transform(data.where("is_test")).select(F.col("label").alias("actual"), F.col("prediction").alias("fitted"))
    forest = fit_forest(data, features, seed, key, trees, depth)
    share = {r["feature"]: r["importance"] for r in importances(forest).collect()}  # one row a feature
    sizes = data.agg(F.struct(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))).scalar()
    line = fit_quality(line).agg(F.struct(F.first("r2").alias("r2"), F.first("mae").alias("mae"))).scalar()
    trees_ = fit_quality(_fitted(forest, data)).select(F.col("r2").alias("rf_r2"), F.col("mae").alias("rf_mae"))
    return (trees_.withColumn("line", line).withColumn("sizes", sizes)
            .select(F.col("line.r2").alias("lr_r2"), F.col("line.mae").alias("lr_mae"), "rf_r2", "rf_mae",
                    (F.col("rf_r2") - F.col("line.r2")).alias("r2_gap"), (F.col("rf_r2") > 0.99).alias("solved"), "sizes.n_train", "sizes.n_test",
                    *[F.lit(float(share.get(i, 0.0))).alias(f"importance_{f}") for i, f in enumerate(features)]))


def forest_importance(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "final_price",
                      seed: int = 42, key=None, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Share of the error reduction per feature, ascending."""
    key = key or key_columns(df)
    df = stage(df.select(*dict.fromkeys([*key, *features, label])), "rows")
    require(df)
    found = importances(fit_forest(prepared(df, features, label, seed, key, staged=True), features, seed, key, trees, depth))
    names = F.array(*[F.lit(f) for f in features])
    all_of = df.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("_i"), F.get(names, F.col("id").cast("int")).alias("name"))
    return (all_of.join(found, F.col("_i") == F.col("feature"), "left")
            .select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance")).orderBy("importance"))


def heteroscedasticity(predictions: DataFrame) -> DataFrame:
    """Residual variance above the median fitted value against below, with Levene's test."""
    middle = quantiles_of(predictions, "fitted", [0.5])
    halves = predictions.withColumn("high", F.col("fitted") > F.get(middle, F.lit(0)))
    ratio = halves.agg(F.expr("try_divide(var_pop(residual) FILTER (WHERE high), var_pop(residual) FILTER (WHERE NOT high))"))
    test = levene(halves.select("high", "residual"), "high", "residual")
    return (test.select("w_stat", "p_value").withColumn("variance_ratio", ratio.scalar())
            .withColumn("constant_variance", F.expr("p_value >= 0.05"))
            .select("variance_ratio", "w_stat", "p_value", "constant_variance"))
