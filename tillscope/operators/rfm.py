"""Recency, frequency and monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.functions.order_stats import exact_quantiles, ranked_counts
from tillscope.functions.staging import stage
from tillscope.model import RFM_TIERS, customer_columns

BINS = 5


def rfm_gate(df: DataFrame) -> DataFrame:
    """Whether customers can be followed: an id column with repeat orders."""
    ids = customer_columns(df)
    if not ids:
        return df.sparkSession.range(1).select(
            F.lit(False).alias("has_id"), F.lit(0).cast("long").alias("customers"),
            F.lit(0).cast("long").alias("max_orders"), F.lit(False).alias("rfm_possible"))
    per_customer = df.where(F.col(ids[0]).isNotNull()).groupBy(ids[0]).count()
    return (per_customer.agg(F.count("*").alias("customers"), F.coalesce(F.max("count"), F.lit(0)).alias("max_orders"))
            .select(F.lit(True).alias("has_id"), "customers", "max_orders",
                    (F.col("max_orders") > 1).alias("rfm_possible")))


def rfm_base(df: DataFrame, customer: str = "customer_id", gate_on: DataFrame | None = None) -> DataFrame:
    """Days since the last order, number of orders and spend per customer.

    Days count to the day after the last order in ``df``. Without repeat
    customers in ``gate_on`` (the full table) no rows come out.
    """
    gate_ok = rfm_gate(gate_on if gate_on is not None else df).select("rfm_possible").scalar()
    snapshot = df.agg(F.date_add(F.max(F.to_date("order_date")), 1)).scalar()
    return (df.where(F.col(customer).isNotNull())
            .groupBy(F.col(customer).alias("customer"))
            .agg(F.max(F.to_date("order_date")).alias("_last"), F.count("order_id").alias("frequency"),
                 F.sum("final_price").alias("monetary"))
            .where(gate_ok)
            .select("customer", F.datediff(snapshot, F.col("_last")).alias("recency"), "frequency", "monetary"))


def value_bin(v: Column, edges: Column, descending: bool = False) -> Column:
    """Quintile 1…5 (or 5…1) of a value between inner edges, lowest bin open."""
    out = F.lit(1 if descending else BINS)
    for i in range(BINS - 2, -1, -1):
        out = F.when(v <= F.get(edges, F.lit(i)), BINS - i if descending else i + 1).otherwise(out)
    return out


def rfm_scores(df: DataFrame, customer: str = "customer_id", gate_on: DataFrame | None = None) -> DataFrame:
    """Quintile scores and their sum per customer.

    Frequency is ranked first (ties by customer id) and cut by rank; recency
    and spend are cut at their value quintiles.
    """
    base = stage(rfm_base(df, customer, gate_on), "rfm-base")  # read by ten passes below
    probs = [i / BINS for i in range(1, BINS)]
    ranked = ranked_counts(base.withColumn("one", F.lit(1).cast("long")), ["frequency", "customer"], ["one"])
    n = base.agg(F.count("*")).scalar()
    place = F.col("through_one")
    by_rank = F.greatest(F.lit(1), F.ceil((place - 1) * BINS / F.greatest(n - 1, F.lit(1)))).cast("int")
    r_edges = exact_quantiles(base, "recency", probs).select("q").scalar()
    m_edges = exact_quantiles(base, "monetary", probs).select("q").scalar()
    return (ranked
            .withColumn("r_score", value_bin(F.col("recency"), r_edges, descending=True))
            .withColumn("f_score", by_rank)
            .withColumn("m_score", value_bin(F.col("monetary"), m_edges))
            .withColumn("rfm_score", F.col("r_score") + F.col("f_score") + F.col("m_score"))
            .withColumn("tier", rfm_tier(F.col("rfm_score")))
            .select("customer", "recency", "frequency", "monetary", "r_score", "f_score", "m_score",
                    "rfm_score", "tier"))


def rfm_tier(score: Column) -> Column:
    out = F.lit(RFM_TIERS[-1][1])
    for low, name in reversed(RFM_TIERS[:-1]):
        out = F.when(score >= low, name).otherwise(out)
    return out


def rfm_tiers(df: DataFrame, customer: str = "customer_id", gate_on: DataFrame | None = None) -> DataFrame:
    return (rfm_scores(df, customer, gate_on).groupBy("tier").agg(F.count("*").alias("customers"))
            .orderBy(F.desc("customers"), "tier"))


def rfm_top20(df: DataFrame, customer: str = "customer_id", gate_on: DataFrame | None = None) -> DataFrame:
    return rfm_scores(df, customer, gate_on).orderBy(F.desc("rfm_score"), "customer").limit(20)
