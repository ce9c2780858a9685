"""A regression forest grown level by level with DataFrame aggregates.

Features are cut into bins once, at the midpoints between all values of a
column with few of them, at exact quantiles otherwise. Rows are dealt by cell, a
cell being one combination of bins; where they arrive, each row's copies are drawn
for every tree (Poisson with mean 1, from a hash of the row's key), and copies and
label are summed by tree and cell, so that one row travels and not its draws. Those
sums are all that a tree needs: further passes read cells, whose
number is bounded by the bins, however many rows there are. A level is one
aggregate by (tree, node, feature, bin), running sums along the bins and the
best split of each node. Cells lie by tree, so that they combine before they
travel, and splits go to the cells while they are few. As soon as no node has
more than ``NODE_CELLS`` cells, those of a node travel once more, and the levels
below it grow where they arrive.

Labels are rounded to 2^-24 of their range, so sums are exact integers and a
forest is the same on any partitioning. Nodes are numbered from 1; the children
of n are 2n and 2n + 1. Rows equal in the key columns share their draws. Cells of rows that are not
trained on travel along without weight and so find their leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import exp, factorial, frexp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.order_stats import GROUP_BROADCAST_LIMIT, exact_quantiles, with_range
from tillscope.functions.staging import ship, shuffle_width, stage
from tillscope.operators.sampling import key_columns, row_digest

TREES, DEPTH, MAX_BINS = 150, 14, 256
UNITS = 1 << 24
#: Poisson counts that are told apart; a higher one has a chance below 2^-53.
MOST_COPIES = 17
#: Levels at which cells are added up by bin before running sums.
SHARED_LEVELS = 7
#: Rows of a cell that one task draws for; a cell with more is dealt over several tasks if it has an outsize share of all rows.
CELL_ROWS = 20_000
#: Pieces by cell in which a tree's cells lie.
SLOTS = 4
#: Cells of a node below which one task grows it to its leaves.
NODE_CELLS = 1 << 17


@dataclass
class Forest:
    """``splits``: tree, node, feature, bin, gain, w, s, wl, sl; ``leaves``: the cells (``_bin0``, …) of all rows with ``value``.

    ``w`` and ``s`` are the copies of rows in a node and the sum of their
    labels in units, ``wl`` and ``sl`` those of its left child.
    """

    features: list[str]
    cuts: list[list[float]]
    splits: DataFrame
    leaves: DataFrame


def candidates(df: DataFrame, feature: str, max_bins: int = MAX_BINS) -> list[float]:
    """Cuts of a feature, at most ``max_bins`` − 1: values below a cut go left."""
    few = [r[0] for r in df.select(F.col(feature).cast("double")).distinct().limit(max_bins + 1).collect()]
    if len(few) <= max_bins:
        few.sort()
        return [(a + b) / 2 for a, b in zip(few, few[1:])]
    probs = [i / max_bins for i in range(1, max_bins)]
    return sorted(set(exact_quantiles(df, feature, probs).first()["q"]))


def binned(df: DataFrame, features: Sequence[str], cuts: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``_bin0``, ``_bin1``, …: how many cuts of each feature are at or below its value."""
    for i, (f, own) in enumerate(zip(features, cuts)):
        splits = F.array(*[F.lit(float(c)) for c in own]) if own else F.array().cast("array<double>")
        df = with_range(df, f"CAST(`{f}` AS DOUBLE)", splits).withColumnRenamed("_b", f"_bin{i}")
    return df


def copies(u: str) -> str:
    """SQL for the Poisson(1) count whose distribution function reaches ``u``."""
    total, arms = 0.0, []
    for k in range(MOST_COPIES):
        total += exp(-1) / factorial(k)
        arms.append(f"WHEN {u} < {total!r}D THEN {k}")
    return f"CASE {' '.join(arms)} ELSE {MOST_COPIES} END"


def scale_of(df: DataFrame, label: str) -> tuple[float, float]:
    """(centre, unit) of a label: its range is ``UNITS`` units or fewer; a power of two, so the same on any partitioning."""
    low, high = df.agg(F.min(label), F.max(label)).first()
    if low is None or low == high:
        return float(low or 0.0), 1.0
    return float(low + (high - low) / 2), 2.0 ** frexp(high - low)[1] / UNITS


def _best_splits(cells: DataFrame, n_features: int, level: int) -> DataFrame:
    """The split of each node that lowers the squared error most; ties go to the first feature, then the lowest bin."""
    choices = ", ".join(f"struct({i} AS feature, _bin{i} AS bin)" for i in range(n_features))
    own = cells.where("w > 0")
    if level >= SHARED_LEVELS:
        own = own.repartition("tree", "node")
    by_bin = own.selectExpr("tree", "node", "w", "s", f"inline(array({choices}))")
    if level < SHARED_LEVELS:  # many cells of a node share a bin; further down the running sums take in the few that do
        by_bin = by_bin.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).repartition("tree", "node")
    along = Window.partitionBy("tree", "node", "feature").orderBy("bin").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("tree", "node", "feature")
    sums = by_bin.select("tree", "node", "feature", "bin", F.sum("w").over(along).alias("wl"), F.sum("s").over(along).alias("sl"),
                         F.sum("w").over(whole).alias("w"), F.sum("s").over(whole).alias("s"))
    # equal partitions of a node have equal differences up to the sign, so equal gains
    gains = sums.where("wl < w").withColumn("d", F.expr("CAST(sl AS DOUBLE) * w - CAST(s AS DOUBLE) * wl"))
    gains = gains.withColumn("gain", F.expr("d * d / (CAST(w AS DOUBLE) * (CAST(wl AS DOUBLE) * (w - wl)))")).where("d != 0")
    best = gains.groupBy("tree", "node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "feature", "bin", "wl", "sl", "w", "s")).alias("x"))
    return best.select("tree", "node", "x.feature", "x.bin", (-F.col("x.loss")).alias("gain"), "x.w", "x.s", "x.wl", "x.sl")


def _dealt(marked: DataFrame, bins: Sequence[str]) -> DataFrame:
    """``marked`` with the rows of a cell in one task, those of an outsize cell in several; ``part`` numbers them."""
    tasks = shuffle_width(marked.sparkSession)
    sizes = stage(marked.groupBy(*bins).agg(F.count("*").alias("n")), "cell-sizes")
    most = max(CELL_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // (4 * tasks))
    # at most four a task, so few enough to broadcast
    large = sizes.where(F.col("n") > most).select(*[F.col(b).alias(f"_{b}") for b in bins], F.ceil(F.col("n") / most).alias("_parts"))
    on = reduce(Column.__and__, [F.col(b) == F.col(f"_{b}") for b in bins])
    part = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("_parts")), F.lit(0))
    found = marked.join(F.broadcast(large), on, "left").withColumn("part", part)
    return found.select(*marked.columns, "part").repartition(tasks, *bins, "part")


def _drawn(marked: DataFrame, bins: Sequence[str], trees: int) -> DataFrame:
    """Copies ``w``, their labels' sum ``s`` and whether a row is not trained on (``asked``), by tree and cell.

    The copies are drawn after the rows have been dealt, so the sums by tree
    need no shuffle of their own; only those sums travel on, to lie by tree.
    Of rows that are not trained on, one for each cell travels.
    """
    own = marked.where("train").withColumn("digest", F.unhex("digest"))
    asked = marked.where("NOT train").select(*bins).distinct().select(*bins, F.lit(False).alias("train"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("binary").alias("digest"))
    dealt = _dealt(own.select(*bins, "train", "q", "digest").union(asked), bins).withColumn("digest", F.lower(F.hex("digest")))
    drawn = dealt.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("u", F.shiftrightunsigned(F.xxhash64("digest", "tree"), 11) * F.lit(2.0 ** -53))
    drawn = drawn.withColumn("w", F.when(F.col("train"), F.expr(copies("u"))).otherwise(0).cast("long")).where("w > 0 OR NOT train")
    sums = (drawn.groupBy("tree", *bins, "part").agg(F.sum("w").alias("w"), F.sum(F.when(F.col("train"), F.col("w") * F.col("q")).otherwise(0)).alias("s"),
                                                     F.max(~F.col("train")).alias("asked")))
    lying = sums.withColumn("slot", F.pmod(F.xxhash64(*bins), F.lit(SLOTS))).repartition(shuffle_width(marked.sparkSession), "tree", "slot")
    return lying.groupBy("tree", "slot", *bins).agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.max("asked").alias("asked")).drop("slot")


def _splits_in(node: np.ndarray, bins: list[np.ndarray], w: np.ndarray, s: np.ndarray) -> dict[str, np.ndarray]:
    """What ``_best_splits`` finds for the nodes of some cells with copies, in ascending order of nodes."""
    found = []
    for f, own in enumerate(bins):
        order = np.lexsort((own, node))
        n, b, cw, cs = node[order], own[order], np.cumsum(w[order]), np.cumsum(s[order])
        last = np.append(n[1:] != n[:-1], True)
        ends = np.flatnonzero(last | np.append(b[1:] != b[:-1], True))  # of the cells of a node and bin
        stop = np.flatnonzero(last)
        at = np.searchsorted(stop, ends)
        before = np.concatenate([[-1], stop[:-1]])[at]
        from_w, from_s = np.where(before >= 0, cw[before], 0), np.where(before >= 0, cs[before], 0)
        wl, sl, all_w, all_s = cw[ends] - from_w, cs[ends] - from_s, cw[stop][at] - from_w, cs[stop][at] - from_s
        d = sl.astype(np.float64) * all_w - all_s.astype(np.float64) * wl
        ok = (wl < all_w) & (d != 0)
        gain = d[ok] * d[ok] / (all_w[ok].astype(np.float64) * (wl[ok].astype(np.float64) * (all_w - wl)[ok]))
        found.append((n[ends][ok], np.full(ok.sum(), f), b[ends][ok], gain, all_w[ok], all_s[ok], wl[ok], sl[ok]))
    names = ("node", "feature", "bin", "gain", "w", "s", "wl", "sl")
    out = dict(zip(names, map(np.concatenate, zip(*found))))
    order = np.lexsort((out["bin"], out["feature"], -out["gain"], out["node"]))
    order = order[np.diff(out["node"][order], prepend=-1) != 0]
    return {k: v[order] for k, v in out.items()}


def _grown(bins: Sequence[str], level: int, depth: int, types: pa.Schema):
    """Function that grows a node at ``level`` to its leaves: the splits below it, and its asked cells with ``w`` and ``s`` of their leaf."""

    def grown(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cells = [table[b].to_numpy() for b in bins]
        w, s, asked = (table[c].to_numpy() for c in ("w", "s", "asked"))
        node = np.full(len(w), key[1].as_py(), np.int64)
        held, active = w > 0, np.ones(len(w), bool)
        leaf_w, leaf_s = np.full(len(w), w.sum()), np.full(len(w), s[held].sum())
        parts = []
        for _ in range(level, depth):
            own = np.flatnonzero(held & active)
            best = _splits_in(node[own], [c[own] for c in cells], w[own], s[own]) if len(own) else {"node": own}
            if not len(best["node"]):
                break
            parts.append({k: pa.array(v) for k, v in best.items()})
            at = np.minimum(np.searchsorted(best["node"], node), len(best["node"]) - 1)
            active &= best["node"][at] == node
            at = at[active]
            right = np.choose(best["feature"][at], [c[active] for c in cells]) > best["bin"][at]
            node[active] = 2 * node[active] + right
            for total, x, left in ((leaf_w, "w", "wl"), (leaf_s, "s", "sl")):
                total[active] = np.where(right, best[x][at] - best[left][at], best[left][at])
        parts.append({b: pa.array(c[asked]) for b, c in zip(bins, cells)} | {"node": pa.array(node[asked]), "w": pa.array(leaf_w[asked]), "s": pa.array(leaf_s[asked])})
        sizes = [len(p["node"]) for p in parts]
        columns = {f.name: pa.concat_arrays([p[f.name].cast(f.type) if f.name in p else pa.nulls(n, f.type) for p, n in zip(parts, sizes)]) for f in types}
        columns["tree"] = pa.array(np.full(sum(sizes), key[0].as_py()), types.field("tree").type)
        return pa.Table.from_pydict(columns, types)

    return grown


def _below(cells: DataFrame, bins: Sequence[str], level: int, depth: int) -> DataFrame:
    """Splits (``feature`` is given) and asked cells with their leaf's ``w`` and ``s`` of all nodes at ``level``, grown node by node."""
    ship(cells.sparkSession)
    ints, longs = ("tree", "node", "feature", "bin", *bins), ("w", "s", "wl", "sl")
    types = pa.schema([(c, pa.int32()) for c in ints] + [(c, pa.int64()) for c in longs] + [("gain", pa.float64())])
    schema = ", ".join([f"{c} int" for c in ints] + [f"{c} bigint" for c in longs] + ["gain double"])
    own = cells.select("tree", "node", *bins, "w", "s", "asked")
    return stage(own.groupBy("tree", "node").applyInArrow(_grown(list(bins), level, depth, types), schema), "grown")


def grow(rows: DataFrame, features: Sequence[str], label: str, train: Column, seed: int = 42, key: Sequence[str] | None = None,
         trees: int = TREES, depth: int = DEPTH, max_bins: int = MAX_BINS) -> Forest:
    """Fit on the rows where ``train`` holds. ``rows`` is read several times and should be staged; no value may be missing."""
    features = list(features)
    own = rows.where(train)
    cuts = [candidates(own, f, max_bins) for f in features]
    centre, unit = scale_of(own, label)
    bins = [f"_bin{i}" for i in range(len(features))]
    digest = row_digest(key or key_columns(rows), seed)
    marked = (binned(rows, features, cuts)
              .select(*bins, train.alias("train"), F.round((F.col(label).cast("double") - centre) / unit).cast("long").alias("q"), digest.alias("digest")))
    cells = stage(_drawn(marked, bins, trees).withColumn("node", F.lit(1)), "cells")
    root = cells.groupBy("tree").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).select("tree", F.lit(1).alias("node"), "w", "s")

    levels, finished, below = [], [], None
    for level in range(depth):
        if (cells.groupBy("tree", "node").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= NODE_CELLS:
            below = _below(cells, bins, level, depth)
            cells = cells.limit(0)
            break
        best = stage(_best_splits(cells, len(features), level), "splits")
        found = best.count()
        if not found:
            break
        levels.append(best)
        here = best.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "feature", "bin")
        at = F.expr("CASE feature " + " ".join(f"WHEN {i} THEN _bin{i}" for i in range(len(features))) + " END")
        here = F.broadcast(here) if found <= GROUP_BROADCAST_LIMIT else here.hint("shuffle_hash")
        moved = cells.join(here, (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")), "left").where("feature IS NOT NULL OR asked")
        inner = F.col("feature").isNotNull()
        moved = stage(moved.select("tree", *bins, "w", "s", "asked", inner.alias("inner"), F.when(inner, 2 * F.col("node") + (at > F.col("bin")).cast("int")).otherwise(F.col("node")).alias("node")), "cells")
        finished.append(moved.where("NOT inner"))
        cells = moved.where("inner")
    finished.append(cells.where("asked"))
    splits = reduce(DataFrame.union, levels) if levels else _best_splits(cells, len(features), 0).limit(0)
    mean = F.lit(centre) + unit * F.col("s") / F.col("w")
    left = splits.selectExpr("tree", "2 * node AS node", "wl AS w", "sl AS s")
    right = splits.selectExpr("tree", "2 * node + 1 AS node", "w - wl AS w", "s - sl AS s")
    splits = splits if below is None else splits.union(below.where("feature IS NOT NULL").select(*splits.columns))
    means = root.union(left).union(right).select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), mean.alias("value"))
    ends = reduce(DataFrame.union, [x.select("tree", "node", *bins) for x in finished])
    found = ends.join(means.hint("shuffle_hash"), (F.col("tree") == F.col("_tree")) & (F.col("node") == F.col("_node")))
    found = found.select(*bins, "value")
    if below is not None:
        told = below.where("feature IS NULL").select(*bins, mean.alias("value"))
        found = found.union(told) if levels else told
    # the sum is of whole units, so the same in any order
    leaves = stage(found.groupBy(*bins).agg(F.avg("value").alias("value")), "leaves")
    return Forest(features, cuts, splits, leaves)


def predicted(forest: Forest, rows: DataFrame) -> DataFrame:
    """Add ``fitted``, the mean over trees, to rows whose cells the forest was asked for."""
    bins = [f"_bin{i}" for i in range(len(forest.features))]
    told = forest.leaves.select(*[F.col(b).alias(f"_{b}") for b in bins], F.col("value").alias("fitted"))
    on = reduce(Column.__and__, [F.col(b) == F.col(f"_{b}") for b in bins])
    return binned(rows, forest.features, forest.cuts).join(told, on).drop(*bins, *[f"_{b}" for b in bins])


def importances(forest: Forest) -> DataFrame:
    """Mean over the trees with a split of each feature's share in the gain: ``feature`` (its place) and ``importance``."""
    by = forest.splits.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    share = by.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree")))
    grown = forest.splits.agg(F.count_distinct("tree")).scalar()
    return share.groupBy("feature").agg((F.sum("share") / grown).alias("importance"))
