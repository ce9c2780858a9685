"""How a registered query is declared.

A query is a name, the list of its output columns, a function from the
transaction table to a DataFrame, and the SQL for the same rows. Both sides get
the same final projection, built from the column list: ``x`` passes ``x`` on,
``x:2`` rounds it to two places, ``x:l`` and ``x:i`` cast it to a long or an
int, ``x:b`` to a boolean.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.operators.enrich import enrich
from tillscope.sources.star import star_transactions

SPARK_TYPES = {"l": "bigint", "i": "int", "b": "boolean", "d": "date"}
SQL_TYPES = {"l": "BIGINT", "i": "INTEGER", "b": "BOOLEAN", "d": "DATE"}


class Inputs:
    """The transaction table of one scale-factor folder, raw and enriched."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @cached_property
    def raw(self) -> DataFrame:
        return star_transactions(self.spark, self.folder)

    @cached_property
    def df(self) -> DataFrame:
        """Enriched, without the two columns that need whole-table thresholds."""
        return enrich(self.raw, thresholds=False)

    @cached_property
    def full(self) -> DataFrame:
        """Enriched with all twelve columns."""
        return enrich(self.raw, thresholds_from=stage(self.raw.select("final_price", "product_price"), "prices"))

    def flat(self, *cols: str) -> DataFrame:
        """The given columns as a flat table, for operators that scan several times."""
        source = self.full if {"high_value", "price_bucket"} & set(cols) else self.df
        return stage(source.select(*cols), "flat")


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    run: Callable[[Inputs], DataFrame]
    body: str | None

    def fields(self):
        for item in self.columns.split():
            name, _, kind = item.partition(":")
            yield name, kind

    def frame(self, spark: SparkSession, folder: str) -> DataFrame:
        out = []
        for name, kind in self.fields():
            c = F.col(f"`{name}`")
            if kind.isdigit():
                c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
            elif kind:
                c = c.cast(SPARK_TYPES[kind])
            out.append(c.alias(name))
        return self.run(Inputs(spark, folder)).select(*out)

    def sql(self) -> str | None:
        if self.body is None:
            return None
        out = []
        for name, kind in self.fields():
            c = f'"{name}"'
            if kind.isdigit():
                c = f"round(CAST({c} AS DOUBLE), {kind}) + 0.0"
            elif kind:
                c = f"CAST({c} AS {SQL_TYPES[kind]})"
            out.append(f'{c} AS "{name}"')
        ctes, main = split_ctes(self.body)
        extra = f",\n{ctes}" if ctes else ""
        return f"WITH RECURSIVE {BASE_CTES}{extra}\nSELECT {', '.join(out)} FROM (\n{main}\n) AS _result"


def split_ctes(body: str) -> tuple[str, str]:
    """A body may start with its own CTEs, ended by a line with ``---``."""
    head, sep, main = body.partition("\n---\n")
    return (head.strip(), main.strip()) if sep else ("", body.strip())


BASE_CTES = """tx AS (
  SELECT l_orderkey || '-' || l_linenumber AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CAST(18 + (c_custkey * 7) % 48 AS INTEGER) AS age,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
         c_mktsegment AS customer_segment,
         p_type AS product_category,
         p_brand AS product_subcategory,
         l_extendedprice / l_quantity AS product_price,
         CAST(l_quantity AS INTEGER) AS quantity,
         round(l_discount * 300) AS discount_percentage,
         l_extendedprice * (1 - round(l_discount * 300) / 100) AS final_price,
         o_orderpriority AS payment_method,
         l_linestatus AS shipping_type,
         CAST(1 + abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) % 10 AS DOUBLE) AS delivery_days,
         CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS return_status,
         r_name AS state,
         n_name AS city
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN part ON l_partkey = p_partkey
), en AS (
  SELECT *,
         CASE WHEN return_status = 'Yes' THEN 1 ELSE 0 END AS returned,
         CASE WHEN age > 17 AND age <= 30 THEN '18–30' WHEN age > 30 AND age <= 45 THEN '30–45'
              WHEN age > 45 AND age <= 65 THEN '45–65' END AS age_group,
         CASE WHEN discount_percentage > -1 AND discount_percentage <= 10 THEN 'Low (0–10%)'
              WHEN discount_percentage > 10 AND discount_percentage <= 20 THEN 'Mid (11–20%)'
              WHEN discount_percentage > 20 AND discount_percentage <= 30 THEN 'High (21–30%)' END AS disc_bucket,
         strftime(order_date, '%Y-%m') AS order_month,
         year(order_date) || 'Q' || quarter(order_date) AS order_quarter,
         year(order_date) AS order_year,
         dayname(order_date) AS order_dow,
         day(order_date) AS order_dom,
         CASE WHEN final_price > (SELECT quantile_cont(final_price, 0.9) FROM tx) THEN 1 ELSE 0 END AS high_value,
         final_price / nullif(quantity, 0) AS revenue_per_unit,
         product_price * quantity - final_price AS discount_impact,
         CASE WHEN product_price <= (SELECT quantile_cont(product_price, 0.25) FROM tx) THEN 'Low'
              WHEN product_price <= (SELECT quantile_cont(product_price, 0.5) FROM tx) THEN 'Mid'
              WHEN product_price <= (SELECT quantile_cont(product_price, 0.75) FROM tx) THEN 'High'
              WHEN product_price IS NOT NULL THEN 'Premium' END AS price_bucket
  FROM tx
)"""
