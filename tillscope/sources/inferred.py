"""CSV files with inferred types, and a side table of the rows that don't fit them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.staging import stage

#: Types from narrow to wide; text holds anything.
TYPES = (T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType())
CORRUPT = "_corrupt_record"
#: Share of the rows that rule out types before all rows are counted.
FIRST_ROWS = 1 / 16


@dataclass
class Inferred:
    """``rows``: typed; ``quarantine``: the text of the columns of other rows with ``bad_columns``; ``bad``: (column, type, bad values)."""

    rows: DataFrame
    quarantine: DataFrame
    bad: DataFrame


def _parsed(name: str, kind: T.DataType) -> Column:
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, T.DateType):  # not any text that begins like one
        return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast(kind))
    if isinstance(kind, T.TimestampType):
        return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), text.try_cast(kind))
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text).isin("true", "false"), text.try_cast(kind))
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast(kind))
    return text.try_cast(kind)


def _allowed(n: int, bad_share: float) -> int:
    """How many of ``n`` values may not fit a column's type."""
    return max(1, int(n * bad_share)) if n > 2 and bad_share else 0


def _fits(rows: DataFrame, kinds: dict[str, list[int]]) -> dict[str, tuple[int, dict[int, int]]]:
    """Values of each column, and how many of them fit each of its types (places in ``TYPES``)."""
    counts = rows.agg(*[F.struct(F.count(F.col(f"`{n}`")).alias("n"), *[F.count(_parsed(n, TYPES[k])).alias(f"t{k}") for k in own]).alias(f"c{i}")
                        for i, (n, own) in enumerate(kinds.items())]).first()
    return {n: (counts[f"c{i}"]["n"], {k: counts[f"c{i}"][f"t{k}"] for k in own}) for i, (n, own) in enumerate(kinds.items())}


def _possible(rows: DataFrame, names: Sequence[str], bad_share: float) -> dict[str, list[int]]:
    """Types that a column can still get, by some of the rows.

    A type is out if more values misfit among those rows than may in all, so
    this changes no result: fewer values fit it than any type that is taken.
    """
    every = {n: list(range(len(TYPES))) for n in names}
    part = max(FIRST_ROWS, 4 * bad_share)
    if part > 0.5:
        return every
    most = max(1, _allowed(rows.count(), bad_share))
    seen = _fits(rows.sample(part, seed=1), every)
    return {n: [k for k in own if seen[n][0] - seen[n][1][k] <= most] for n, own in every.items()}


def read_inferred(spark: SparkSession, path: str, bad_share: float = 0.01, sep: str = ",") -> Inferred:
    """Read CSV files with a header, their types inferred from all rows.

    A column gets the narrowest type that all but ``bad_share`` of its values
    fit, at most one value of few; text if there is none. Some of the rows tell
    which types are out of the question, all rows are counted for the others. Rows with a value that does not fit, or
    with more or fewer fields than the header, are set apart. A file without a
    header is an error; empty values are NULL and fit any type.
    """
    if not 0 <= bad_share < 0.5:
        raise ValueError("bad_share has to be below one half")
    options = {"header": True, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    names = spark.read.options(**options).csv(path).columns
    if not names:
        raise ValueError(f"no header in {path}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    text = stage(spark.read.schema(schema).options(**options).csv(path), "csv-text", "zstd")
    whole = text.where(F.col(CORRUPT).isNull())
    counts = _fits(whole, _possible(whole, names, bad_share))
    kinds: dict[str, T.DataType] = {}
    for name, (n, fits) in counts.items():
        kinds[name] = next((TYPES[k] for k, c in fits.items() if n and n - c <= _allowed(n, bad_share) and c == max(fits.values())), T.StringType())
    value = {n: F.col(f"`{n}`") if isinstance(t, T.StringType) else _parsed(n, t) for n, t in kinds.items()}
    misfit = F.filter(F.array(*[F.when(F.col(f"`{n}`").isNotNull() & value[n].isNull(), F.lit(n)) for n in names]), lambda c: c.isNotNull())
    marked = text.withColumn("bad_columns", F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit(CORRUPT))).otherwise(misfit))
    rows = marked.where("size(bad_columns) = 0").select(*[value[n].alias(n) for n in names])
    quarantine = marked.where("size(bad_columns) > 0")
    told = spark.createDataFrame([(n, t.simpleString()) for n, t in kinds.items()] + [(CORRUPT, "")], "column string, type string")
    found = quarantine.select(F.explode("bad_columns").alias("_c")).groupBy("_c").agg(F.count("*").alias("_n"))
    bad = told.join(found, F.col("column") == F.col("_c"), "left").select("column", "type", F.coalesce("_n", F.lit(0)).alias("bad"))
    return Inferred(rows, quarantine, bad)
