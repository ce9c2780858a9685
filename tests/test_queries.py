import re

import pytest

import __spark_entry__ as driver
from tillscope.sources.star import star_transactions
from tillscope.operators import metrics, rank_tests, slices
from tillscope.operators.enrich import enrich
from tillscope.functions.order_stats import exact_quantiles
from tools.check import difference, oracle

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("transactions", "enrich_price_bucket", "kpi_delta", "monthly_revenue", "group_spend_by_customer_segment",
           "geo_artifact", "whale_share_by_category", "segment_mix", "seasonal_decompose", "fdr_battery", "trend_test_by_state",
           "mann_whitney_final_price", "ks_2samp_quantity", "outlier_sensitivity", "dq_overview", "rfm_scores", "roc_auc")


@pytest.fixture(scope="module")
def con():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, con, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(driver.oracle_sql()[name]).df()) == ""


def test_every_sql_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert len(driver.queries()) > 190


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["order_month", "revenue", "orders"] and df.count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "flat")
    star_transactions(spark, FOLDER).write.parquet(path)
    flat = enrich(spark.read.parquet(path))
    text = plan(metrics.monthly_revenue(slices.slice_rows(flat, ("1996-01-01", "1996-12-31"), choices={"gender": ["F"]})))
    scan = text[text.rindex("FileScan"):]
    assert "GreaterThanOrEqual(order_date,1996-01-01)" in scan and "EqualTo(gender,F)" in scan
    read = re.search(r"ReadSchema: struct<(.*?)>", scan).group(1).split(",")
    # age because the default range drops rows without one, order_id for the count of orders
    assert {c.split(":")[0] for c in read} == {"order_id", "order_date", "age", "gender", "final_price"}
    assert "Subquery" not in text[text.index("Physical Plan"):]  # unused thresholds are not computed


def test_fact_sized_steps_avoid_single_partitions_and_cross_joins(spark):
    facts = star_transactions(spark, FOLDER)
    for df in (rank_tests.value_counts(facts, "product_category", "final_price"),
               exact_quantiles(facts, "final_price", [0.5], ["product_category"], small=True),
               metrics.monthly_revenue(enrich(facts))):
        text = plan(df)
        text = text[text.index("Physical Plan"):]
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "Exchange SinglePartition" not in text
