"""Seeded sampling, extremes and deterministic splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.order_stats import few_groups, per_group
from tillscope.functions.staging import stage


def row_digest(cols: Sequence[str], seed: int) -> Column:
    """Digest of a row's key columns and a seed, the same on any partitioning."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def key_columns(df: DataFrame) -> list[str]:
    """Columns that print the same everywhere: all but floating and nested ones."""
    plain = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.DateType, T.BooleanType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, plain)]


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows without replacement: those with the smallest digests.

    Each task keeps its best ``n`` rows, so only those travel.
    """
    rest = [c for c in df.columns]
    return (df.withColumn("_d", row_digest(key or key_columns(df), seed))
            .orderBy("_d", *rest).limit(n).drop("_d"))


def quotas(df: DataFrame, by: Sequence[str], test_pct: int) -> DataFrame:
    """Rows ``_n`` and test rows ``_want`` of each class: ceil(n · pct / 100) in all, each class within one row of its share.

    Classes get their share rounded down, those with the largest remainders one more.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    total = sizes.agg(F.struct(F.sum("_n").alias("n"), F.ceil(F.sum("_n") * test_pct / 100).alias("t"))).scalar()
    named = sizes.withColumn("_t", total).withColumn("_whole", F.expr("CAST(_n * _t.t DIV _t.n AS BIGINT)")).withColumn("_rest", F.expr("_n * _t.t % _t.n"))
    missing = named.agg(F.max("_t.t") - F.sum("_whole")).scalar()
    # one row a class
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), *[F.col(c).asc_nulls_first() for c in by]))
    return named.withColumn("_want", F.col("_whole") + (place <= missing).cast("long")).select(*by, "_n", "_want")


def _same(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return cond


def split(df: DataFrame, test_pct: int = 25, seed: int = 42, key: Sequence[str] | None = None,
          by: Sequence[str] = (), staged: bool = False) -> DataFrame:
    """Mark exactly ceil(n · pct / 100) rows ``is_test``: those with the smallest digests, in each class of ``by``.

    The last digest taken is found by counting prefixes of digests: 4 digits of
    all rows, 8 of those that share the first 4 with it, then whole digests; no
    rows are sorted. A digest is of the key columns and, behind that, of all
    columns, so only rows equal in all of them tie. Of tied rows as many as are
    wanted are taken, counted by input partition first. ``df`` is staged, unless
    it is ``staged`` already; digests, longer than most rows, are made anew where they are read.
    """
    by = list(by)
    every = F.lpad(F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), 16, "0")
    rows = (df if staged else stage(df, "rows")).withColumn("_d", F.concat(row_digest(key or key_columns(df), seed), F.lower(every)))
    small = few_groups(rows, by)
    keys = [f"_k_{c}" for c in by]
    cut = quotas(rows, by, test_pct).select(*[F.col(c).alias(f"_k_{c}") for c in by], "_want", F.lit("").alias("_last"))
    for length in (4, 8, 48):
        near = rows.select(*by, "_d").join(per_group(cut.where("_want > 0"), small), _same(by) & F.col("_d").startswith(F.col("_last")))
        counts = near.groupBy(*keys, "_want", F.substring("_d", 1, length).alias("_last")).agg(F.count("*").alias("_ties"))
        along = Window.partitionBy(*keys).orderBy("_last").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.withColumn("_through", F.sum("_ties").over(along)).where("_through >= _want AND _through - _ties < _want")
        cut = stage(found.select(*keys, (F.col("_want") - F.col("_through") + F.col("_ties")).alias("_want"), "_last", "_ties"), "cuts")
    marked = rows.join(per_group(cut, small), _same(by), "left").drop(*keys)
    below, tied = F.coalesce(F.col("_d") < F.col("_last"), F.lit(False)), F.col("_d") == F.col("_last")
    extra = ["_d", "_want", "_last", "_ties"]
    if cut.where("_want < _ties").isEmpty():  # no row shares a last digest with one that is not wanted
        return marked.withColumn("is_test", below | F.coalesce(tied, F.lit(False))).drop(*extra)
    equal = rows.withColumn("_part", F.spark_partition_id()).join(per_group(cut, small), _same(by) & tied).drop(*keys)
    sizes = equal.groupBy("_last", *by, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_last", *by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_last").alias("_l"), F.col("_part").alias("_p"), "_before")
    turn = F.row_number().over(Window.partitionBy("_last", *by, "_part").orderBy("_d"))
    chosen = (equal.withColumn("_turn", turn).join(sizes, _same(by) & (F.col("_last") == F.col("_l")) & (F.col("_part") == F.col("_p")))
              .withColumn("is_test", F.col("_before") + F.col("_turn") <= F.col("_want")))
    others = marked.where(~F.coalesce(tied, F.lit(False))).withColumn("is_test", below)
    return others.drop(*extra).unionByName(chosen.select(*df.columns, "is_test"))


def split_sizes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row counts of the two sides, per class if ``by`` is given."""
    return (df.groupBy(*by)
            .agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test")))


def extremes(df: DataFrame, value: str, name: str, k: int = 8) -> DataFrame:
    """The ``k`` lowest and ``k`` highest rows, each value once, in ascending order; of equal values the first name stays."""
    low = df.orderBy(value, name).limit(k)
    high = df.orderBy(F.desc(value), F.desc(name)).limit(k)
    both = low.unionByName(high)
    rest = [c for c in df.columns if c not in (value, name)]
    first = both.groupBy(value).agg(F.min(F.struct(name, *rest)).alias("_x")) if rest else both.groupBy(value).agg(F.min(name).alias(name))
    return (first.select(value, "_x.*") if rest else first).select(*df.columns).orderBy(value, name)
