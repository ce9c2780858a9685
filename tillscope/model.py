"""Column roles, schema and the fixed values of the retail transaction model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: names and labels that results have to carry unchanged ----
NUM_COLS = ("age", "product_price", "quantity", "discount_percentage",
            "final_price", "delivery_days", "revenue_per_unit", "discount_impact")
CAT_COLS = ("gender", "customer_segment", "product_category", "payment_method",
            "shipping_type", "price_bucket", "return_status")
GEO_COLS = ("state", "city")
FILTER_COLS = ("customer_segment", "product_category", "payment_method",
               "shipping_type", "gender")
CUSTOMER_ID_NAMES = ("customer_id", "cust_id", "customerid", "client_id")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
AGE_BANDS = ((17, 30, "18–30"), (30, 45, "30–45"), (45, 65, "45–65"))
DISCOUNT_BANDS = ((-1, 10, "Low (0–10%)"), (10, 20, "Mid (11–20%)"), (20, 30, "High (21–30%)"))
PRICE_LABELS = ("Low", "Mid", "High", "Premium")
VALUE_LABELS = {0: "Regular (bottom 90%)", 1: "High-Value (top 10%)"}
RFM_TIERS = ((12, "Champions"), (9, "Loyal"), (6, "At Risk"), (None, "Lost"))
FENCE_WIDTHS = (1.0, 1.5, 2.0, 2.5, 3.0)
TEST_DIMS = ("gender", "customer_segment", "product_category", "payment_method", "shipping_type", "price_bucket",
             "state", "city", "product_subcategory")
REVENUE_FEATURES = ("product_price", "quantity", "discount_percentage")
RETURN_NUMERIC = ("age", "product_price", "quantity", "discount_percentage", "final_price", "delivery_days")
RETURN_CATEGORICAL = ("gender", "customer_segment", "product_category", "payment_method", "shipping_type")
ALPHA = 0.05
HIGH_VALUE_QUANTILE = 0.9
# ----------------------------------------------------------------------------

RAW_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_date", T.TimestampType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("product_category", T.StringType()),
    T.StructField("product_subcategory", T.StringType()),
    T.StructField("product_price", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("discount_percentage", T.DoubleType()),
    T.StructField("final_price", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("shipping_type", T.StringType()),
    T.StructField("delivery_days", T.DoubleType()),
    T.StructField("return_status", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("city", T.StringType()),
])


def present(df, names):
    """The given columns that ``df`` has, in the given order."""
    have = set(df.columns)
    return [c for c in names if c in have]


def customer_columns(df):
    """Columns of ``df`` that look like a customer id, whatever their case."""
    return [c for c in df.columns if c.lower() in CUSTOMER_ID_NAMES]
