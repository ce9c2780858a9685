"""Data-quality reports on the raw table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.model import NUM_COLS, present
from tillscope.operators.metrics import missing, value_table
from tillscope.operators.pivots import agg_transpose


def duplicate_rows(df: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """Rows that repeat an earlier row, counted exactly.

    Only row hashes (``_h``; ``hashes``: those of all rows, if at hand) are
    shuffled at first; whole rows are read again and compared just for the
    hashes that occur more than once, if any. Copies combine before each shuffle.
    """
    cols = df.columns
    hashed = df.withColumn("_h", F.xxhash64(*cols))
    seen = hashed.select("_h") if hashes is None else hashes
    repeated = stage(seen.groupBy("_h").count().where("count > 1").select("_h"), "repeated")
    if repeated.isEmpty():
        return df.sparkSession.range(1).select(F.lit(0).cast("long").alias("duplicates"))
    kinds = (hashed.join(repeated, "_h", "left_semi").groupBy("_h", *cols)
             .agg(F.count("*").alias("_c")))
    return kinds.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates"))


def dq_overview(raw: DataFrame) -> DataFrame:
    """Size, duplicates, missing cells, complete rows and date span.

    ``raw`` is read once, into a hash and a number of missing cells a row.
    """
    width = len(raw.columns)
    gaps = [missing(raw, c).cast("int") for c in raw.columns]
    brief = stage(raw.select(F.xxhash64(*raw.columns).alias("_h"), sum(gaps[1:], gaps[0]).alias("_gaps"), "order_date"), "row-hashes")
    base = brief.agg(F.count("*").alias("rows"), F.sum(F.col("_gaps").cast("long")).alias("missing_cells"),
                     F.count_if(F.col("_gaps") == 0).alias("complete_rows"),
                     F.datediff(F.max("order_date"), F.min("order_date")).alias("span_days"))
    rows = F.col("rows")
    return (base.withColumn("duplicates", duplicate_rows(raw, brief.select("_h")).scalar())
            .select("rows", F.lit(width).alias("columns"), "duplicates",
                    (F.try_divide("duplicates", rows) * 100).alias("duplicate_pct"), "missing_cells",
                    (F.try_divide("missing_cells", rows * width) * 100).alias("missing_pct"),
                    "complete_rows", "span_days"))


def dq_missing(raw: DataFrame) -> DataFrame:
    """Columns with missing values: count and percentage."""
    counts = raw.agg(F.count("*").alias("_n"), *[F.count_if(missing(raw, c)).alias(c) for c in raw.columns])
    return (counts.unpivot(["_n"], raw.columns, "column", "missing").where("missing > 0")
            .select("column", "missing", (F.col("missing") * 100 / F.col("_n")).alias("missing_pct")))


def dq_profile(raw: DataFrame) -> DataFrame:
    """Type, distinct values and missing values per column."""
    types = F.create_map(*[F.lit(x) for pair in raw.dtypes for x in pair])
    return (value_table(raw, raw.columns).groupBy("column")
            .agg(F.count("value").alias("distinct"),
                 F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
            .select("column", types[F.col("column")].alias("dtype"), "distinct", "missing"))


def dq_ranges(raw: DataFrame) -> DataFrame:
    """Range, mean and deviation of the numeric columns that are present."""
    return agg_transpose(raw, present(raw, NUM_COLS))


def dq_sanity(raw: DataFrame) -> DataFrame:
    """Negative prices and discounts outside 0–100; 0 for an absent column."""
    def flag(c, cond):
        return F.count_if(cond) if c in raw.columns else F.lit(0).cast("long")

    d = F.col("discount_percentage")
    return raw.agg(flag("final_price", F.col("final_price") < 0).alias("negative_price"),
                   flag("discount_percentage", (d < 0) | (d > 100)).alias("bad_discount"))


def dq_columns(raw: DataFrame, names: Sequence[str]) -> DataFrame:
    """Which of the expected columns the table has, with their values and, of those, distinct ones.

    One aggregate over the columns that are there; absent ones have zeros.
    """
    have = present(raw, names)
    counts = raw.agg(*[F.struct(F.count(c).alias("values"), F.count_distinct(c).alias("levels")).alias(c) for c in have])
    none = F.struct(F.lit(0).cast("long").alias("values"), F.lit(0).cast("long").alias("levels"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in have).alias("present"), (F.col(f"`{c}`") if c in have else none).alias("s")) for c in names])
    return counts.select(F.explode(cells).alias("x")).select("x.column", "x.present", "x.s.values", "x.s.levels")
