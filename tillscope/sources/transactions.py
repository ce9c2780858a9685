"""Reading and writing transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.model import RAW_SCHEMA


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv",
                      schema: T.StructType | None = None) -> DataFrame:
    """Scan a transaction table with a declared schema; NaN is read as NULL.

    CSV columns are matched by header position, so the schema must list the
    file's columns in file order. Parquet carries its own schema.
    """
    if fmt == "csv":
        df = (spark.read.schema(schema or RAW_SCHEMA)
              .option("header", True).option("enforceSchema", False).csv(path))
    elif fmt == "parquet":
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column."""
    floats = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def export_slice(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Write ``df`` as CSV with a header, one file per partition; gzip at its fastest level."""
    df.write.mode(mode).option("header", True).option("zlib.compress.level", "BEST_SPEED").csv(path, compression=compression)
