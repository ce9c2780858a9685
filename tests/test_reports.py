import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillscope.operators import metrics, outliers, pivots, quality, rfm, sampling, series, slices
from tillscope.operators.enrich import enrich
from tillscope.functions.staging import shared_path
from tillscope.sources.transactions import export_slice, read_transactions


def day(n, month=1):
    return dt.date(2024, month, n)


def test_bins_are_right_closed(tx):
    edges = [(17, -1.0), (18, 0.0), (30, 10.0), (31, 10.5), (65, 20.0), (66, 30.0), (66, 31.0)]
    out = enrich(tx(*[dict(age=a, discount_percentage=d) for a, d in edges]), thresholds=False)
    rows = out.select("age_group", "disc_bucket").collect()
    assert [r.age_group for r in rows] == [None, "18–30", "18–30", "30–45", "45–65", None, None]
    assert [r.disc_bucket for r in rows] == [None, "Low (0–10%)", "Low (0–10%)", "Mid (11–20%)", "Mid (11–20%)",
                                             "High (21–30%)", None]


def test_thresholds_come_from_the_whole_table(tx):
    raw = tx(*[dict(final_price=float(i), product_price=float(i)) for i in range(1, 11)])
    rows = enrich(raw).where("final_price >= 5").orderBy("final_price").collect()
    assert [r.high_value for r in rows] == [0, 0, 0, 0, 0, 1]
    assert [r.price_bucket for r in rows] == ["Mid", "High", "High", "Premium", "Premium", "Premium"]


def test_revenue_per_unit_of_zero_quantity_is_null(tx):
    row = enrich(tx(dict(quantity=0)), thresholds=False).first()
    assert row.revenue_per_unit is None and row.order_quarter == "2024Q1" and row.order_dow == "Monday"


def test_empty_choice_and_inclusive_last_day(spark, tx):
    df = tx(dict(order_date=day(1)), dict(order_date=day(2)))
    assert slices.slice_rows(df, choices={"gender": []}).count() == 0
    late = df.withColumn("order_date", F.to_timestamp(F.lit("2024-01-31 23:59:00")))
    assert slices.slice_rows(late, ("2024-01-01", "2024-01-31")).count() == 2


def test_kpi_delta_without_and_with_an_earlier_period(tx):
    empty = slices.kpi_delta(enrich(tx(dict(order_date=day(20))), False), "2024-01-20", "2024-01-21").first()
    assert empty.revenue == 10.0 and empty.revenue_delta is None and empty.return_rate_delta is None
    df = enrich(tx(dict(order_date=day(20), final_price=30.0), dict(order_date=day(19), final_price=20.0),
                   dict(order_date=day(18), final_price=0.0, return_status="Yes")), False)
    both = slices.kpi_delta(df, "2024-01-20", "2024-01-21").first()
    assert both.revenue_delta == pytest.approx(50) and both.return_rate_delta == pytest.approx(-50)
    zero = slices.kpi_delta(df, "2024-01-19", "2024-01-19").first()
    assert zero.revenue_delta is None and zero.orders_delta == 0


def test_single_row_group_has_no_deviation(tx):
    row = metrics.mean_ci(tx(dict(state="X")), "state").first()
    assert row.sd is None and row.ci95 == 0


def test_missing_weekday_stays_on_the_spine(tx):
    rows = metrics.dow_revenue(enrich(tx(dict(order_date=day(1))), False)).collect()
    assert [r.revenue for r in rows] == [10.0] + [None] * 6


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 9, 20)], "x double")
    row = metrics.numeric_summary(df, ["x"]).first()
    assert row.skewness == pytest.approx(1.49012, abs=1e-5) and row.kurtosis == pytest.approx(1.89543, abs=1e-5)
    assert row.median == 4


def test_geography_artifact(tx):
    df = tx(dict(state="S", city="a"), dict(state="S", city="b"), dict(state="R", city="c"))
    row = metrics.geo_artifact(df).first()
    assert row.top_state == "S" and row.top_cities == 2 and row.artifact and row.city_list == "a, b"
    assert row.city_spread == pytest.approx(0)


def test_crosstab_fills_empty_cells(tx):
    df = tx(dict(product_category="A"), dict(product_category="B", return_status="Yes"))
    assert [tuple(r) for r in pivots.crosstab(df, "product_category", "return_status").collect()] == [("A", 1, 0), ("B", 0, 1)]


def test_rolling_mean_with_even_width(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(14)], "i int, x double")
    rows = series.rolling_centered(df, "i", "x", 12, 6).orderBy("i").collect()
    assert rows[0].rolling == 2.5 and rows[-1].rolling == 10.0


def test_decomposition_needs_thirteen_months(tx):
    months = [dict(order_date=dt.date(2023 + m // 12, m % 12 + 1, 1), final_price=float(m % 12)) for m in range(13)]
    assert series.seasonal_decompose(tx(*months[:12])).count() == 0
    assert series.seasonal_decompose(tx(*months)).count() == 13
    assert series.seasonal_strength(tx(*months[:12])).count() == 0
    assert 0 <= series.seasonal_strength(tx(*months)).first()[0] <= 1


def test_outlier_fences(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 12), 100]], "x double")
    row = outliers.outliers(df, "x").first()
    assert row.outliers == 1 and row.outlier_pct == pytest.approx(100 / 12)
    widths = outliers.outlier_sensitivity(df, "x").collect()
    assert [w.width for w in widths] == [1, 1.5, 2, 2.5, 3] and {w.outliers for w in widths} == {1}
    assert outliers.outlier_rows(df, "x", ["x"]).collect()[0].x == 100


def test_quality_of_a_dirty_table(tx):
    df = tx({}, {}, {}, dict(final_price=-1.0, discount_percentage=120.0), dict(city=None, age=None))
    row = quality.dq_overview(df).first()
    assert (row.rows, row.columns, row.duplicates, row.missing_cells, row.complete_rows) == (5, 18, 2, 2, 4)
    assert {r.column: r.missing for r in quality.dq_missing(df).collect()} == {"city": 1, "age": 1}
    assert tuple(quality.dq_sanity(df).first()) == (1, 1)
    profile = {r.column: (r.dtype, r.distinct, r.missing) for r in quality.dq_profile(df).collect()}
    assert profile["age"] == ("int", 1, 1) and profile["final_price"] == ("double", 2, 0)


def test_rfm_scores_and_gate(tx):
    once = tx(*[dict(customer_id=str(i)) for i in range(5)])
    assert not rfm.rfm_gate(once).first().rfm_possible and rfm.rfm_scores(once).count() == 0
    assert not rfm.rfm_gate(once.drop("customer_id")).first().has_id
    rows = [dict(customer_id=f"c{i:02d}", order_date=day(i + 1), final_price=float(i)) for i in range(10) for _ in range(i + 1)]
    got = {r.customer: r for r in rfm.rfm_scores(tx(*rows)).collect()}
    assert (got["c00"].r_score, got["c00"].f_score, got["c00"].m_score, got["c00"].tier) == (1, 1, 1, "Lost")
    assert got["c09"].rfm_score == 15 and got["c09"].recency == 1 and got["c09"].tier == "Champions"
    assert sorted(r.f_score for r in got.values()) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_repeated_quantile_edges_take_the_first_label(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 1, 1, 1, 1, 2)], "x double")
    edges = F.array(*[F.lit(1.0)] * 4)
    assert [r[0] for r in df.select(rfm.value_bin(F.col("x"), edges)).collect()] == [1, 1, 1, 1, 1, 5]


def test_samples_and_splits_do_not_depend_on_partitions(tx):
    df = tx(*[dict(order_id=str(i), final_price=float(i)) for i in range(200)])
    a = sampling.sample_n(df, 20, 42).collect()
    assert a == sampling.sample_n(df.repartition(7), 20, 42).collect() and len(set(a)) == 20
    assert a != sampling.sample_n(df, 20, 7).collect()
    sizes = sampling.split_sizes(sampling.split(df)).first()
    assert sizes.n_train + sizes.n_test == 200 and 25 <= sizes.n_test <= 75


def test_extremes_list_each_row_once(spark):
    df = spark.createDataFrame([(f"f{i}", float(i)) for i in range(10)], "name string, w double")
    assert [r.w for r in sampling.extremes(df, "w", "name", 8).collect()] == [float(i) for i in range(10)]


def test_csv_round_trip(spark, tx):
    df = enrich(tx(dict(city=None), dict(order_id='quoted "x", y')), False)
    path = shared_path(spark, "slice")
    export_slice(df, path)
    back = read_transactions(spark, path, "csv", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_overview_reads_rows_once_where_none_repeats(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    plain = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i), None if i == 2 else 1.5) for i in range(9)], "id int, order_date date, v double")
    row = quality.dq_overview(plain.mapInArrow(counted, plain.schema)).first()
    assert (row["rows"], row["duplicates"], row["missing_cells"], row["complete_rows"], row["span_days"]) == (9, 0, 1, 8, 8)
    assert reads.value == 9
    twice = quality.dq_overview(plain.union(plain.where("id < 3"))).first()
    assert (twice["rows"], twice["duplicates"]) == (12, 3)


def test_inferred_csv_is_packed_and_written_part_by_part(spark, tmp_path, monkeypatch):
    from tillscope.plans import reports
    from tillscope.plans.catalog import Inputs
    from tillscope.sources import star

    day, rows = dt.datetime(2024, 1, 1), range(40)
    tables = {
        "lineitem": [(i % 15, i % 6 if i % 9 else None, i, 1.0 + i, 10.5 * i + 1, 0.05, "R", "O", day) for i in [*rows, 3]],
        "orders": [(i, i % 4, day + dt.timedelta(i), f"{i % 3}-HIGH") for i in range(14)], "customer": [(i, i % 2, "BUILDING") for i in range(4)],
        "nation": [(0, "A", 0), (1, "B", 0)], "region": [(0, "ASIA")], "part": [(i, f"b{i}", "t") for i in range(5)]}
    for name, own in tables.items():
        spark.createDataFrame(own, star.SCHEMAS[name].replace("timestamp_ntz", "timestamp")).selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]})" for c in star.SCHEMAS[name].split(", "))).write.parquet(str(tmp_path / f"{name}.parquet"))
    paths = []
    monkeypatch.setattr(star, "LINES", 10)
    monkeypatch.setattr(reports, "shared_path", lambda *a: paths.append(shared_path(*a)) or paths[-1])
    want = star.star_transactions(spark, str(tmp_path))
    parts = star.star_parts(spark, str(tmp_path))
    assert len(parts) == 5 and sorted(r for p in parts for r in map(str, p.collect())) == sorted(map(str, want.collect()))
    got = reports.inferred_round_trip(Inputs(spark, str(tmp_path)))
    key = ["order_id", "order_date", "product_price", "product_subcategory"]
    assert want.count() > 20 and sorted(got.select(key).collect()) == sorted(want.select(key).collect())
    files = [p for p in (tmp_path.__class__(paths[0].removeprefix("file:"))).iterdir() if p.name.startswith("part-")]
    assert len(files) >= 3 and all(p.name.endswith(".csv.gz") for p in files)


def test_shuffle_files_go_when_the_table_is_written(spark, tmp_path):
    from tillscope.functions.staging import shuffles_dropped

    def kept():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    set_before, before = spark.conf.get(key, None), kept()
    with shuffles_dropped(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "x"))
    assert not kept() - before and spark.conf.get(key, None) == set_before
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1000
