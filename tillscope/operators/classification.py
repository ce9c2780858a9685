"""Return prediction: features, logistic model and the measures of a score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import average_rank, is_number, ranked_counts
from tillscope.functions.staging import spread, stage
from tillscope.model import RETURN_CATEGORICAL as CATEGORICAL
from tillscope.model import RETURN_NUMERIC as NUMERIC
from tillscope.operators.pivots import levels_of
from tillscope.operators.regression import complete, require
from tillscope.operators.sampling import extremes, split

#: Features of a model, rows that are worked on at a time, and the gradient at which a fit ends.
MOST_FEATURES, BLOCK, GRADIENT = 1_000, 4_096, 1e-8


def indicators(df: DataFrame, cats: Sequence[str]) -> dict[str, Column]:
    """Indicator by name for every level but the alphabetically first; a NULL has zeros only."""
    index = StringIndexer(inputCols=list(cats), outputCols=[f"_i_{c}" for c in cats],
                          stringOrderType="alphabetDesc", handleInvalid="keep").fit(df)
    return {f"{c}_{level}": F.col(c).eqNullSafe(F.lit(level)) for c, levels in zip(cats, index.labelsArray) for level in levels[:-1]}


def one_hot_counts(df: DataFrame, cats: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Rows per indicator column."""
    hot = indicators(df, cats)
    sums = df.agg(*[F.count_if(c).alias(f"_{i}") for i, c in enumerate(hot.values())])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_{i}").alias("ones")) for i, n in enumerate(hot)])
    return sums.select(F.inline(cells))


def standardise(df: DataFrame, cols: Sequence[str], is_train: str = "NOT is_test") -> DataFrame:
    """Centre and scale columns by mean and population deviation of the train rows.

    A constant column is centred only.
    """
    fit = df.where(is_train).agg(*[
        F.struct(F.avg(c).alias("m"), F.coalesce(F.expr(f"nullif(stddev_pop(`{c}`), 0D)"), F.lit(1.0)).alias("s")).alias(c)
        for c in cols])
    scaled = df.withColumn("_fit", fit.select(F.struct(*cols)).scalar())
    return scaled.withColumns({c: (F.col(c) - F.col(f"_fit.{c}.m")) / F.col(f"_fit.{c}.s") for c in cols}).drop("_fit")


def encoded(df: DataFrame, num: Sequence[str], cat: Sequence[str], levels: dict[str, list[str]]) -> DataFrame:
    """``num`` as an array of doubles, ``cat`` as an array of level numbers: 0 for the first level and for a NULL."""
    def code(c: str) -> Column:
        numbers = [x for k, level in enumerate(levels[c]) for x in (F.lit(level), F.lit(k))]
        return F.coalesce(F.try_element_at(F.create_map(*numbers), F.col(c)), F.lit(0)) if numbers else F.lit(0)

    codes = F.array(*[code(c) for c in cat]) if cat else F.array().cast("array<int>")
    return df.withColumns({"num": F.array(*[F.col(c).cast("double") for c in num]), "codes": codes})


def design(table: pa.RecordBatch, sizes: Sequence[int], centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rows of the standardised features with a one in front. ``sizes``: levels of each coded column but the first."""
    n = table.num_rows
    parts = [table["num"].flatten().to_numpy().reshape(n, -1)]
    codes = table["codes"].flatten().to_numpy().reshape(n, -1) if sizes else np.zeros((n, 0), int)
    for j, size in enumerate(sizes):
        parts.append((codes[:, j, None] == np.arange(1, size + 1)).astype(np.float64))
    return np.column_stack([np.ones(n), (np.concatenate(parts, axis=1) - centre) / scale])


def newton_sums(train: DataFrame, sizes: Sequence[int], centre: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, its gradient, Xᵀ W X) at ``beta``, one aggregate over the train rows.

    Each task adds up its own rows; its sums travel as one number per entry.
    """
    p = len(beta)
    upper = np.triu_indices(p)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + p + len(upper[0]))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = batch.slice(at, BLOCK)
                x, y = design(block, sizes, centre, scale), block["label"].to_numpy()
                z = x @ beta
                mu = 1 / (1 + np.exp(-np.abs(z)))
                mu = np.where(z >= 0, mu, 1 - mu)
                square = (x * (mu * (1 - mu))[:, None]).T @ x
                total += np.concatenate([[(y * z - np.logaddexp(0, z)).sum()], x.T @ (y - mu), square[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["entry", "value"])

    rows = train.select("num", "codes", "label").mapInArrow(add, "entry bigint, value double").groupBy("entry").agg(F.sum("value").alias("value"))
    total = np.zeros(1 + p + len(upper[0]))
    for r in rows.collect():  # one row an entry: bounded by the square of MOST_FEATURES
        total[r["entry"]] = r["value"]
    square = np.zeros((p, p))
    square[upper] = total[1 + p:]
    return total[0], total[1:1 + p], square + np.triu(square, 1).T


def newton_logistic(train: DataFrame, sizes: Sequence[int], centre: np.ndarray, scale: np.ndarray, max_iter: int = 100) -> np.ndarray:
    """Intercept and coefficients that maximise the log-likelihood less half the squared coefficients.

    Newton steps, halved where they would lower it, until the gradient is below
    ``GRADIENT`` or what rounding leaves of it.
    """
    p = len(centre) + 1
    penalty = np.ones(p)
    penalty[0] = 0
    value = lambda told, b: told[0] - 0.5 * (penalty * b * b).sum()
    beta = np.zeros(p)
    told = newton_sums(train, sizes, centre, scale, beta)
    for _ in range(max_iter):
        slope = told[1] - penalty * beta
        if np.abs(slope).max() < GRADIENT:
            break
        step = np.linalg.solve(told[2] + np.diag(penalty), slope)
        if np.abs(step).max() < 1e-13 * max(1.0, np.abs(beta).max()):
            break
        for _ in range(30):
            after = newton_sums(train, sizes, centre, scale, beta + step)
            if value(after, beta + step) >= value(told, beta) - 1e-12 * abs(value(told, beta)):
                break
            step = step / 2
        beta, told = beta + step, after
    return beta


def fit_returns(df: DataFrame, num: Sequence[str] = NUMERIC, cat: Sequence[str] = CATEGORICAL,
                label: str = "returned", seed: int = 42, key=None, max_iter: int = 100):
    """L2-penalised logistic model on standardised features, on a split stratified by the label.

    Returns the scored test rows (``label``, ``score``), the coefficient table
    and the staged input. The penalty is half the squared coefficients, that of
    C = 1. Rows that lack a number are left out on both sides; a missing level
    has zeros only. More than ``MOST_FEATURES`` features are an error.
    """
    require(df, label)
    marked = split(complete(df, [*num, label]), 25, seed, key, [label])
    # levels are taken from all rows, as indicators are made before the split
    levels = {c: levels_of(marked, c) for c in cat}
    names = [*num, *[f"{c}_{level}" for c in cat for level in levels[c][1:]]]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"{len(names)} features are more than {MOST_FEATURES}")
    data = encoded(marked, num, cat, levels).select("num", "codes", F.col(label).cast("double").alias("label"), "is_test")
    data = stage(spread(data), "return-model")
    train, sizes = data.where("NOT is_test"), [max(0, len(levels[c]) - 1) for c in cat]
    moments = train.agg(F.count("*").alias("n"), *[f(F.col("num")[i]).alias(f"{k}{i}") for i in range(len(num)) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
                        *[F.count_if(F.col("codes")[j] == k).alias(f"c{j}_{k}") for j, size in enumerate(sizes) for k in range(1, size + 1)]).first()
    shares = np.array([moments[f"c{j}_{k}"] / moments["n"] for j, size in enumerate(sizes) for k in range(1, size + 1)])
    centre = np.concatenate([[moments[f"m{i}"] for i in range(len(num))], shares])
    scale = np.concatenate([[moments[f"s{i}"] for i in range(len(num))], np.sqrt(shares * (1 - shares))])
    scale[scale == 0] = 1.0
    beta = newton_logistic(train, sizes, centre, scale, max_iter)
    weight = beta[1:] / scale
    terms = [F.col("num")[i] * float(w) for i, w in enumerate(weight[:len(num)])]
    at = len(num)
    for j, size in enumerate(sizes):
        if size:
            terms.append(F.array(*[F.lit(x) for x in [0.0, *map(float, weight[at:at + size])]])[F.col("codes")[j]])
        at += size
    z = sum(terms, F.lit(float(beta[0] - (weight * centre).sum())))
    scored = data.where("is_test").select(F.col("label").cast("int").alias("label"), (1 / (1 + F.exp(-z))).alias("score"))
    pairs = list(zip(names, map(float, beta[1:])))
    weights = df.sparkSession.createDataFrame(pairs, "feature string, coef double").orderBy("coef")
    return scored, weights, data


def return_model(df: DataFrame, **kwargs) -> DataFrame:
    """All measures of the fitted model in one row."""
    scored, _, data = fit_returns(df, **kwargs)
    scored = stage(scored, "return-scores")
    auc = roc_auc(scored).select("auc").scalar()
    sizes = data.agg(F.struct(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"),
                              F.avg("label").alias("base_rate"))).scalar()
    return (classification_metrics(scored).withColumn("auc", auc).withColumn("s", sizes)
            .select("auc", "accuracy", "precision", "recall", "s.n_train", "s.n_test", "s.base_rate",
                    (F.col("auc") < 0.6).alias("near_chance")))


def coef_extremes(df: DataFrame, k: int = 8, **kwargs) -> DataFrame:
    """The strongest negative and positive weights, each feature once."""
    return extremes(fit_returns(df, **kwargs)[1], "coef", "feature", k)


# --- measures of a score ------------------------------------------------------

def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (df.select(F.col(label).cast("int").alias("y"), F.col(score).cast("double").alias("v"))
            .where(F.col("y").isNotNull() & is_number(F.col("v")))
            .groupBy("v").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"),
                              F.count("*").alias("n")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from the rank sum of the positives."""
    ranked = ranked_counts(score_counts(df, label, score), ["v"], ["n"]).withColumn("rank", average_rank())
    sums = ranked.agg(F.expr("CAST(sum(pos) AS DOUBLE) AS p"), F.expr("CAST(sum(neg) AS DOUBLE) AS q"),
                      F.expr("sum(pos * rank) AS r"))
    return sums.selectExpr("CAST(p AS BIGINT) AS positives", "CAST(q AS BIGINT) AS negatives",
                           "try_divide(r - p * (p + 1) / 2, p * q) AS auc")


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at each threshold, from (0, 0) on.

    A point on the straight line between its neighbours is left out: the next
    lower score then adds the same positives and negatives. That neighbour is
    found by rank, joined on consecutive positions.
    """
    counts = score_counts(df, label, score).withColumns(
        {"one": F.lit(1).cast("long"), "key": -F.col("v")})
    ranked = (ranked_counts(counts, ["key"], ["pos", "neg", "one"])
              .select("v", "pos", "neg", F.col("through_pos").alias("tp"), F.col("through_neg").alias("fp"),
                      F.col("through_one").alias("at")))
    after = ranked.select((F.col("at") - 1).alias("at"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("q"))).scalar()
    kept = (ranked.join(after, "at", "left")
            .where("at = 1 OR next_pos IS NULL OR pos != next_pos OR neg != next_neg")
            .withColumn("t", totals)
            .selectExpr("v AS threshold", "try_divide(fp, t.q) AS fpr", "try_divide(tp, t.p) AS tpr"))
    origin = df.sparkSession.range(1).selectExpr(
        "CAST(NULL AS DOUBLE) AS threshold", "0D AS fpr", "0D AS tpr")
    return origin.unionByName(kept)


def outcomes(df: DataFrame, label: str, score: str, cut: float) -> DataFrame:
    """Counts of the four outcomes at a cut-off."""
    y, hit = F.col(label) == 1, F.col(score) >= cut
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return rows.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
                    F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))


def classification_metrics(df: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall; 0 where undefined."""
    return outcomes(df, label, score, cut).selectExpr(
        "try_divide(tp + tn, tp + tn + fp + fn) AS accuracy",
        "coalesce(try_divide(tp, tp + fp), 0D) AS precision", "coalesce(try_divide(tp, tp + fn), 0D) AS recall")


def confusion_matrix(df: DataFrame, label: str = "label", score: str = "score", cut: float = 0.5) -> DataFrame:
    """All four cells in long form."""
    return outcomes(df, label, score, cut).selectExpr(
        "inline(array(struct(0 AS actual, 0 AS predicted, tn AS n), struct(0 AS actual, 1 AS predicted, fp AS n), "
        "struct(1 AS actual, 0 AS predicted, fn AS n), struct(1 AS actual, 1 AS predicted, tp AS n)))")
