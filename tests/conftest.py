import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COLUMNS = ("order_id string, customer_id string, order_date date, age int, gender string, customer_segment string, "
           "product_category string, product_subcategory string, product_price double, quantity int, "
           "discount_percentage double, final_price double, payment_method string, shipping_type string, "
           "delivery_days double, return_status string, state string, city string")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tillscope-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.conf.set("spark.sql.maxMetadataStringLength", "2000")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tx(spark):
    """Builds transactions from partial rows; other columns get plain defaults."""
    import datetime as dt

    base = dict(order_id="o", customer_id="c", order_date=dt.date(2024, 1, 1), age=30, gender="F",
                customer_segment="New", product_category="A", product_subcategory="A1", product_price=10.0, quantity=1,
                discount_percentage=0.0, final_price=10.0, payment_method="Card", shipping_type="Express",
                delivery_days=2.0, return_status="No", state="S", city="T")

    def make(*rows):
        full = [tuple({**base, **r}[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make
