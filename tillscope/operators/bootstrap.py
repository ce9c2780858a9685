"""Bootstrap distributions of effect sizes.

Row resampling is replaced by resampling counts. Cramér's V depends on the cell
counts only, and those of a resample are multinomial. Cells are dealt into
buckets by a hash; the draws of a bucket follow from halving the rows of all
buckets again and again, each half a binomial drawn from a generator keyed by
its place, and within a bucket cells share its draws in the same way. So any
task makes the draws of its own cells, all replicates at once.

For η² each distinct (group, value) pair with c copies is drawn Poisson(c) times, which is what c
independent rows with Poisson(1) weights add up to; the draws follow from a hash
of group, value and replicate by inversion. Neither partitioning nor a rerun
changes either kind of draw.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import all_present, is_number
from tillscope.functions.staging import stage
from tillscope.operators.group_tests import anova, cells_of, chi2_independence

REPLICATES = 200
ROWS_PER_BLOCK = 4096
#: Cells a bucket has on average, up to ``MOST_BUCKETS``, whose sizes are broadcast.
CELLS_PER_BUCKET, MOST_BUCKETS = 2048, 1 << 16
#: Cells of a bucket that are drawn at a time.
CELLS_PER_BLOCK = 1024


def bucket_draws(sizes: np.ndarray, bucket: int, n_boot: int, seed: int) -> np.ndarray:
    """Rows drawn from one bucket in every replicate. ``sizes``: rows of all buckets, a power of two of them.

    From the top, each node gives its left half a binomial share; the generator
    is keyed by the node, so all tasks agree.
    """
    tree = [sizes]
    while len(tree[-1]) > 1:
        tree.append(tree[-1].reshape(-1, 2).sum(1))
    drawn = np.full(n_boot, tree[-1][0])
    for depth in range(len(tree) - 2, -1, -1):
        node = bucket >> (depth + 1)
        left, whole = tree[depth][2 * node], tree[depth + 1][node]
        share = np.random.default_rng([seed, 0, depth, node]).binomial(drawn, left / whole if whole else 0.0)
        drawn = drawn - share if bucket >> depth & 1 else share
    return drawn


def cell_draws(n: np.ndarray, drawn: np.ndarray, seed: int, bucket: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first cell, draws of some cells by replicate) of one bucket, cell after cell a binomial of what is left."""
    rng, left, drawn = np.random.default_rng([seed, 1, bucket]), int(n.sum()), drawn.copy()
    for at in range(0, len(n), CELLS_PER_BLOCK):
        some = n[at:at + CELLS_PER_BLOCK]
        out = np.zeros((len(some), len(drawn)), np.int64)
        for k, size in enumerate(some.tolist()):
            out[k] = rng.binomial(drawn, min(1.0, size / left)) if left else 0
            drawn -= out[k]
            left -= size
        yield at, out


def redrawn(cells: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(a, b, replicate, n): the cells (a, b, n) with the rows that each replicate draws, where there are any. Staged."""
    kind = {c: cells.schema[c].dataType.simpleString() for c in "ab"}
    cells = stage(cells, "cells")
    spread = cells.count() // CELLS_PER_BUCKET
    buckets = min(MOST_BUCKETS, 1 << max(0, int(spread)).bit_length())
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "a", "b"), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in cells.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most MOST_BUCKETS rows
        sizes[r["bucket"]] = r["n"]
    told = cells.sparkSession.sparkContext.broadcast(sizes)

    def draw(key, table):
        bucket, parts = key[0].as_py(), []
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        drawn = bucket_draws(told.value, bucket, n_boot, seed)
        for at, out in cell_draws(table["n"].to_numpy(), drawn, seed, bucket):
            some = table.slice(at, len(out)).combine_chunks()
            cell, replicate = np.nonzero(out)
            parts.append(pa.table({**{c: some[c].take(pa.array(cell)) for c in "ab"}, "replicate": pa.array(replicate, pa.int64()), "n": pa.array(out[cell, replicate], pa.int64())}))
        return pa.concat_tables(parts)

    drawn = cells.select("bucket", "a", "b", "n").groupBy("bucket").applyInArrow(draw, f"a {kind['a']}, b {kind['b']}, replicate bigint, n bigint")
    return stage(drawn, "draws")


def bootstrap_cramers_v(df: DataFrame, a: str, b: str = "return_status", n_boot: int = REPLICATES,
                        seed: int = 42) -> DataFrame:
    """One Cramér's V per replicate.

    With row and column totals r and c, phi² is Σ n² / (r · c) − 1 over the
    cells that drew rows. NULL where a side has one level.
    """
    cells = cells_of(df, a, b)
    drawn = redrawn(cells, n_boot, seed)
    levels = cells.agg(F.least(F.count_distinct("a"), F.count_distinct("b")) - 1).scalar()
    by = {c: drawn.groupBy(F.col(c).alias(f"_{c}"), F.col("replicate").alias(f"_r{c}")).agg(F.sum("n").alias(f"_n{c}")) for c in "ab"}
    rows = drawn
    for c in "ab":
        rows = rows.join(by[c], (F.col(c) == F.col(f"_{c}")) & (F.col("replicate") == F.col(f"_r{c}")))
    phi2 = rows.groupBy("replicate").agg((F.sum(F.expr("CAST(n AS DOUBLE) * n / (CAST(_na AS DOUBLE) * _nb)")) - 1).alias("phi2"))
    return phi2.withColumn("free", levels).selectExpr("replicate", "CASE WHEN free > 0 THEN sqrt(greatest(phi2, 0D) / free) END AS value")


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a published finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=256)
def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """(least count, distribution function from there) of a Poisson law, 12 deviations to both sides of its mean."""
    wide = 12 * int(np.sqrt(mean) + 2)
    low = max(0, mean - wide)
    k = np.arange(low + 1, mean + wide + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log(mean / k))])
    chance = np.exp(logs - logs.max())
    return low, np.cumsum(chance / chance.sum())


def poisson_weights(hashes: np.ndarray, copies: np.ndarray, n_boot: int) -> np.ndarray:
    """Draws (rows × replicates) by inversion: the table of a count serves all rows that have it."""
    step = np.uint64(0x9E3779B97F4A7C15)
    reps = np.arange(1, n_boot + 1, dtype=np.uint64) * step
    out = np.empty((len(hashes), n_boot))
    order = np.argsort(copies, kind="stable")
    counts, first = np.unique(copies[order], return_index=True)
    for c, rows in zip(counts.tolist(), np.split(order, first[1:])):
        u = (mix(hashes[rows, None] + reps[None, :]) >> np.uint64(11)) * 2.0 ** -53
        low, table = poisson_table(int(c))
        out[rows] = low + np.minimum(np.searchsorted(table, u, side="right"), len(table) - 1)
    return out


def bootstrap_eta_squared(df: DataFrame, by: str, value: str = "final_price", n_boot: int = REPLICATES,
                          seed: int = 42) -> DataFrame:
    """One η² per replicate."""
    rows = (df.select(F.col(by).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
            .where(all_present(["g"]) & is_number(F.col("v"))))
    centre = rows.agg(F.avg("v")).scalar()
    counts = (rows.groupBy("g", "v").agg(F.count("*").alias("c"))
              .select("g", (F.col("v") - centre).alias("v"), "c", F.xxhash64(F.lit(seed), "g", "v").alias("h")))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS_PER_BLOCK):
                block = batch.iloc[at:at + ROWS_PER_BLOCK]
                weights = poisson_weights(block["h"].to_numpy().astype(np.uint64), block["c"].to_numpy(), n_boot)
                v = block["v"].to_numpy()
                moments = np.stack([np.ones_like(v), v, v * v])
                labels = block["g"].to_numpy()
                for g in pd.unique(labels):
                    pick = labels == g
                    sums[g] = sums.get(g, 0) + moments[:, pick] @ weights[pick]
        for g, m in sums.items():
            yield pd.DataFrame({"replicate": np.arange(n_boot), "g": g, "w": m[0], "wx": m[1], "wxx": m[2]})

    groups = (counts.mapInPandas(partial, "replicate bigint, g string, w double, wx double, wxx double")
              .groupBy("replicate", "g").agg(F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wxx").alias("wxx")))
    sums = groups.groupBy("replicate").agg(
        F.expr("sum(CASE WHEN w > 0 THEN wx * wx / w END) AS a"), F.expr("sum(wxx) AS xx"),
        F.expr("power(sum(wx), 2) / sum(w) AS mm"))
    return sums.selectExpr("replicate", "CASE WHEN xx - mm > 0 THEN (a - mm) / (xx - mm) ELSE 0D END AS value")


def bootstrap_summary(replicates: DataFrame) -> DataFrame:
    """Median and 95 % percentile interval of the replicates."""
    return replicates.agg(
        F.count("value").alias("replicates"), F.median("value").alias("point"),
        F.percentile("value", F.lit(0.025)).alias("ci_low"), F.percentile("value", F.lit(0.975)).alias("ci_high"))


def bootstrap_effect(df: DataFrame, by: str, kind: str = "cramers_v", n_boot: int = REPLICATES,
                     seed: int = 42) -> DataFrame:
    """Summary of the bootstrap next to the value on the data as they are."""
    if kind == "cramers_v":
        reps = bootstrap_cramers_v(df, by, "return_status", n_boot, seed)
        plug_in = chi2_independence(df, by).select("cramers_v").scalar()
    elif kind == "eta_squared":
        reps = bootstrap_eta_squared(df, by, "final_price", n_boot, seed)
        plug_in = anova(df, by).select("eta_squared").scalar()
    else:
        raise ValueError(f"unknown effect size: {kind}")
    return bootstrap_summary(reps).withColumn("plug_in", plug_in)
