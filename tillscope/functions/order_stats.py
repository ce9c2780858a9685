"""Exact order statistics without a global sort.

``exact_quantiles`` narrows in on the wanted ranks: it counts rows per value
rounded to 10 significant bits, keeps only the rows that share a rounded value
with a wanted rank, counts those at 31 bits, and last by exact value. Every
pass combines map-side and no pass leaves more than about two million counters
per wanted rank, whatever the number or the spread of the rows; a value held by
a third of all rows is one counter. Rounding to fewer bits never reverses the
order of two values, so the result is exact.

``ranked_counts`` gives ranks to *all* distinct values. It splits the value range
at a fixed-size sample (the values with the smallest hashes, hence the same at
every evaluation), sums within ranges by window and adds the totals of the
ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_BROADCAST_LIMIT = 50_000
SPLITS = 1024


def rounded_bits(v: str, bits: int) -> str:
    """SQL for column ``v`` rounded to ``bits`` significant bits (Veltkamp's splitting)."""
    scaled = f"{v} * {2 ** (53 - bits) + 1}D"
    return f"CASE WHEN abs({v}) < {float(2 ** 930)!r}D THEN {scaled} - ({scaled} - {v}) ELSE {v} END"


def is_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def all_present(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def few_groups(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether ``by`` has few enough levels for a per-level table to broadcast.

    Reads the key columns only and stops counting at the limit.
    """
    if not by:
        return True
    levels = df.select(*by).distinct().limit(GROUP_BROADCAST_LIMIT + 1).count()
    return levels <= GROUP_BROADCAST_LIMIT


def per_group(table: DataFrame, small: bool) -> DataFrame:
    """Broadcast a per-level table once its size was checked, else let AQE decide."""
    return F.broadcast(table) if small else table


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    by: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """Linearly interpolated quantiles: columns ``by``, ``n`` and ``q`` (array).

    Rows with a missing value or key are left out. ``small`` passes on the
    result of an earlier ``few_groups`` check.
    """
    by = list(by)
    if small is None:
        small = few_groups(df, by)
    rows = (df.select(*by, F.col(value).cast("double").alias("_v"))
            .where(is_number(F.col("_v")) & all_present(by)))
    keys = [f"`{c}`" for c in by]

    # pass 1: where the wanted positions fall among the coarse values
    wanted = ", ".join(f"{float(p)!r}D" for p in probs)
    positions = f"""flatten(transform(array({wanted}), (p, i) -> array(
        struct(i AS i, 0 AS side, floor((n - 1) * p) AS pos, (n - 1) * p - floor((n - 1) * p) AS frac),
        struct(i AS i, 1 AS side, ceil((n - 1) * p) AS pos, 0D AS frac))))"""
    found = (rows.groupBy(*by, F.expr(rounded_bits("_v", 10)).alias("_k")).agg(F.count("*").alias("_c"))
             .selectExpr("*", f"sum(_c) OVER ({partition(keys)} ORDER BY _k ROWS UNBOUNDED PRECEDING) AS _hi",
                         f"sum(_c) OVER ({partition(keys)}) AS n")
             .selectExpr(*keys, "n", "_k", "_hi - _c AS _lo", "_hi", f"explode({positions}) AS _t")
             .where("_t.pos >= _lo AND _t.pos < _hi")
             .selectExpr(*keys, "n", "_k", "_t.i AS _i", "_t.side AS _side", "_t.frac AS _frac",
                         "_t.pos - _lo AS _pos"))

    # passes 2 and 3: the same among the rows of the buckets found
    tags = [*keys, "_i", "_side"]
    for outer_bits, key in ((10, rounded_bits("_v", 31)), (31, "_v")):
        hits = (rows.withColumn("_k", F.expr(rounded_bits("_v", outer_bits)))
                .join(per_group(found, small), [*by, "_k"]))
        counts = (hits.groupBy(*by, "_i", "_side", "n", "_frac", "_pos", F.expr(key).alias("_f"))
                  .agg(F.count("*").alias("_c")))
        found = (counts
                 .selectExpr("*", f"sum(_c) OVER ({partition(tags)} ORDER BY _f ROWS UNBOUNDED PRECEDING) AS _hi")
                 .where("_pos >= _hi - _c AND _pos < _hi")
                 .selectExpr(*tags, "n", "_frac", "_f AS _k", "_pos - (_hi - _c) AS _pos"))

    ends = (found.groupBy(*by, "_i")
            .agg(F.expr("max(n) AS n"), F.expr("max(_frac) AS _frac"),
                 F.expr("max(_k) FILTER (WHERE _side = 0) AS _a"), F.expr("max(_k) FILTER (WHERE _side = 1) AS _b")))
    return ends.groupBy(*by).agg(
        F.expr("max(n) AS n"),
        F.expr("transform(array_sort(collect_list(struct(_i, _a + (_b - _a) * _frac AS q))), x -> x.q) AS q"))


def partition(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}" if keys else ""


def quantiles_of(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    """Quantiles of a whole column as an array-valued scalar subquery."""
    return exact_quantiles(df, value, probs).select("q").scalar()


def with_range(df: DataFrame, key: str, splits: Column) -> DataFrame:
    """Add ``_b``: how many of the sorted ``splits`` are at or below ``key``.

    A binary search written out as one projection per step, which compiles into
    the surrounding stage; the array is referred to, never copied into a row.
    """
    out = df.withColumns({"_s": splits, "_key": F.expr(key), "_b": F.lit(0)})
    step = SPLITS
    while step:
        out = out.withColumn("_b", F.expr(f"_b + IF(get(_s, _b + {step - 1}) <= _key, {step}, 0)"))
        step //= 2
    return out.drop("_s", "_key")


def ranked_counts(counts: DataFrame, order: Sequence[str], weights: Sequence[str],
                  within: Sequence[str] = ()) -> DataFrame:
    """Add running totals of ``weights`` along ``order``, peers included.

    For each weight ``w``: ``through_w`` is the total over all rows up to and
    including the row's peers (rows equal in ``order``) and ``peers_w`` the total
    over the peers. ``counts`` should be one row per value or key (pre-aggregated),
    so that no key repeats without bound. ``within`` restarts the totals. The
    sample is of distinct keys: a key that many rows share is one split.
    """
    within = list(within)
    keys = [f"`{c}`" for c in [*within, *order]]
    key = f"struct({', '.join(keys)})"
    sample = (counts.selectExpr(f"{key} AS k").distinct().orderBy(F.xxhash64("k"), "k").limit(SPLITS)
              .agg(F.expr("sort_array(collect_list(k)) AS s")))
    tagged = with_range(counts, key, sample.scalar())

    groups = keys[:len(within)]
    totals = tagged.groupBy(*within, "_b").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    offsets = totals.selectExpr(*groups, "_b", *[
        f"""coalesce(sum(_t_{w}) OVER ({partition(groups)} ORDER BY _b
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _o_{w}""" for w in weights])

    order_keys = ", ".join(keys[len(within):])
    part = partition([*groups, "_b"])
    ranked = tagged.selectExpr(
        "*", *[f"sum({w}) OVER ({part} ORDER BY {order_keys} RANGE UNBOUNDED PRECEDING) AS _u_{w}" for w in weights],
        *[f"sum({w}) OVER ({part}, {order_keys}) AS peers_{w}" for w in weights])
    return (ranked.join(offsets, [*within, "_b"])
            .selectExpr(*[f"`{c}`" for c in counts.columns],
                        *[f"_o_{w} + _u_{w} AS through_{w}" for w in weights],
                        *[f"peers_{w}" for w in weights]))


def average_rank(weight: str = "n") -> Column:
    """Mid-rank of each row's peers, from the columns of ``ranked_counts``."""
    return F.col(f"through_{weight}") - (F.col(f"peers_{weight}") - 1) / 2.0
