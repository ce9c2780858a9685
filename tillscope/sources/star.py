"""The transaction table as a view over an order star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_brand string, p_type string",
}

TRANSACTION_COLUMNS = {
    "order_id": "concat_ws('-', l_orderkey, l_linenumber)",
    "customer_id": "cast(o_custkey AS string)",
    "order_date": "cast(o_orderdate AS date)",
    "age": "cast(18 + (c_custkey * 7) % 48 AS int)",
    "gender": "if(c_custkey % 2 = 0, 'F', 'M')",
    "customer_segment": "c_mktsegment",
    "product_category": "p_type",
    "product_subcategory": "p_brand",
    "product_price": "l_extendedprice / l_quantity",
    "quantity": "cast(l_quantity AS int)",
    "discount_percentage": "round(l_discount * 300)",
    "final_price": "l_extendedprice * (1 - round(l_discount * 300) / 100)",
    "payment_method": "o_orderpriority",
    "shipping_type": "l_linestatus",
    "delivery_days": "cast(1 + abs(datediff(cast(l_shipdate AS date), cast(o_orderdate AS date))) % 10 AS double)",
    "return_status": "if(l_returnflag = 'R', 'Yes', 'No')",
    "state": "r_name",
    "city": "n_name",
}


#: Order lines that are joined at a time where a table is written part by part.
LINES = 1 << 25


def star_parts(spark: SparkSession, folder: str) -> list[DataFrame]:
    """``star_transactions`` in parts of about ``LINES`` rows, by a hash of the order, so that the shuffles of one part go before the next."""
    n = max(1, -(-spark.read.parquet(f"{folder}/lineitem.parquet").count() // LINES))
    return [star_transactions(spark, folder, (k, n)) for k in range(n)]


def star_transactions(spark: SparkSession, folder: str, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """One transaction per order line, with the columns of ``RAW_SCHEMA``.

    Five inner equi-joins; the join strategy is left to Catalyst and AQE, so
    small dimensions broadcast and large ones sort-merge. part: (k, n) for the
    k-th of n parts of the orders.
    """
    def table(name, key=None):
        df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
        return df.where(F.pmod(F.xxhash64(key), F.lit(part[1])) == part[0]) if key and part[1] > 1 else df

    joined = (table("lineitem", "l_orderkey").join(table("orders", "o_orderkey"), F.expr("l_orderkey = o_orderkey"))
              .join(table("customer"), F.expr("o_custkey = c_custkey"))
              .join(table("nation"), F.expr("c_nationkey = n_nationkey"))
              .join(table("region"), F.expr("n_regionkey = r_regionkey"))
              .join(table("part"), F.expr("l_partkey = p_partkey")))

    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in TRANSACTION_COLUMNS.items()])
