"""Sketches, memoised results and CSV files with inferred types."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillscope.functions import sketches
from tillscope.functions.memo import key_of, memoised
from tillscope.operators import metrics, outliers
from tillscope.sources.inferred import read_inferred

N = 60_000
SHAPES = {"sorted": lambda i, rng: i.astype(float), "tied": lambda i, rng: (i % 7).astype(float), "heavy": lambda i, rng: np.exp(rng.standard_cauchy(len(i)).clip(-300, 300)),
          "one hot value": lambda i, rng: np.where(i % 3 == 0, 5.0, rng.normal(size=len(i)))}


@pytest.mark.parametrize("shape", SHAPES)
def test_rank_error_of_merged_sketches(spark, shape):
    i = np.arange(N)
    v = SHAPES[shape](i, np.random.default_rng(1))
    df = spark.createDataFrame(list(zip((i * 12 // N).tolist(), v.tolist())), "month int, v double").repartition(5)
    parts = sketches.quantile_sketches(df, "v", ["month"])
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    for months in (range(12), (2, 3, 4)):
        row = sketches.merged_quantiles(parts.where(F.col("month").isin(*months)), probs).first()
        own = np.sort(v[np.isin(i * 12 // N, list(months))])
        assert row["n"] == len(own)
        for p, q in zip(probs, row["q"]):
            low, high = np.searchsorted(own, q, "left") / len(own), np.searchsorted(own, q, "right") / len(own)
            assert low - 2 * sketches.RANK_ERROR <= p <= high + 2 * sketches.RANK_ERROR
    assert sketches.merged_quantiles(parts.where("month > 50"), probs).count() == 0


def test_operators_take_sketches(spark, tx):
    rng = np.random.default_rng(2)
    price = np.concatenate([rng.normal(100, 10, 3000), [900.0, 950.0]])
    df = tx(*[dict(final_price=float(p), product_category="AB"[k % 2]) for k, p in enumerate(price)])
    exact, near = metrics.group_spend(df, "product_category").collect(), metrics.group_spend(df, "product_category", approx=True).collect()
    for a, b in zip(exact, near):
        assert a["mean"] == b["mean"] and a["median"] == pytest.approx(b["median"], abs=0.5)
    a, b = metrics.box_stats(df, "final_price").first(), metrics.box_stats(df, "final_price", approx=True).first()
    assert [a["q1"], a["q3"], a["mean"]] == pytest.approx([b["q1"], b["q3"], b["mean"]], abs=0.5)
    assert outliers.outliers(df, "final_price", approx=True).first()["outliers"] >= 2


def test_distinct_sketches_unite_over_slices(spark):
    # one value holds a third of the rows, and months share values
    rows = spark.range(90_000).selectExpr("cast(id % 12 as int) as month", "if(id % 3 = 0, 7, id % 20000) as a", "cast(id % 5 as double) as b", "cast(null as string) as c")
    parts = sketches.distinct_sketches(rows, ["a", "b", "c"], ["month"])
    for months in (range(12), (1, 5)):
        own = rows.where(F.col("month").isin(*months))
        got = {r["column"]: r["distinct"] for r in sketches.merged_distinct(parts.where(F.col("month").isin(*months))).collect()}
        want = own.agg(F.count_distinct("a"), F.count_distinct("b")).first()
        assert got["a"] == pytest.approx(want[0], rel=5 * sketches.DISTINCT_ERROR) and got["b"] == want[1] and got["c"] == 0
    assert {r["column"]: r["distinct"] for r in metrics.distinct_counts(rows, ["b", "c"], approx=True).collect()} == {"b": 5, "c": 0}


def test_memoised_results_are_not_made_again(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(1000).selectExpr("id", "id % 7 as g").write.parquet(path)
    made = []

    def build(df, least):
        made.append(least)
        return df.where(F.col("id") >= least).groupBy("g").count()

    read = lambda: spark.read.parquet(path).where("id < 900")
    one, two = memoised(read(), "groups", build, least=10), memoised(read(), "groups", build, least=10)
    assert made == [10] and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert path not in two._jdf.queryExecution().toString() and not any(path in f for f in two.inputFiles())  # no scan of the facts
    memoised(read(), "groups", build, least=20)
    memoised(read().where("g > 1"), "groups", build, least=10)
    assert made == [10, 20, 10]
    before = key_of(read(), "groups", {"least": 10})
    spark.range(5).selectExpr("id", "id % 7 as g").write.mode("append").parquet(path)
    assert key_of(read(), "groups", {"least": 10}) != before
    memoised(read(), "groups", build, least=10)
    assert made == [10, 20, 10, 10]
    with pytest.raises(ZeroDivisionError):
        memoised(read(), "broken", lambda df: 1 / 0)


def test_inferred_types_and_quarantine(spark, tmp_path):
    lines = [f"o{k},{2000 + k},{k}.5,2024-01-{k % 28 + 1:02d},{'true' if k % 2 else 'false'},2024-01-01 10:{k % 60:02d}:00,t{k}" for k in range(300)]
    lines[17] = "o17,not a number,1.5,2024-01-02,true,2024-01-01 10:00:00,x"
    lines[40] = "o40,2040,1.5"
    lines[41] = "o41,,,,,,"
    lines[42] = "o42,2042,4.5,2024-13-77,false,2024-01-01 10:00:00,x"
    lines[43] = "o43,2043,4.5,2024-01-01,false,2024-01-01 10:00:00,x,too,many"
    (tmp_path / "x.csv").write_text("\n".join(["id,n,price,day,flag,at,note", *lines]) + "\n")
    got = read_inferred(spark, str(tmp_path / "x.csv"))
    assert [f.dataType.simpleString() for f in got.rows.schema] == ["string", "int", "double", "date", "boolean", "timestamp", "string"]
    assert got.rows.count() == 296 and got.rows.where("id = 'o3'").first()["day"] == dt.date(2024, 1, 4)
    empty = got.rows.where("id = 'o41'").first()
    assert empty["n"] is None and empty["flag"] is None
    bad = {r["id"]: r["bad_columns"] for r in got.quarantine.collect()}
    assert bad == {"o17": ["n"], "o40": ["_corrupt_record"], "o42": ["day"], "o43": ["_corrupt_record"]}
    assert {r["column"]: r["bad"] for r in got.bad.collect() if r["bad"]} == {"n": 1, "day": 1, "_corrupt_record": 2}


def test_one_broken_row_is_set_apart_and_text_stays_text(spark, tmp_path):
    (tmp_path / "y.csv").write_text("a,b,c\n1,x,9999999999\n2,7,3\n3,y,4\nzz,z,5\n")
    got = read_inferred(spark, str(tmp_path / "y.csv"))
    assert [f.dataType.simpleString() for f in got.rows.schema] == ["int", "string", "bigint"] and got.rows.count() == 3
    assert [r["a"] for r in got.quarantine.collect()] == ["zz"]
    strict = read_inferred(spark, str(tmp_path / "y.csv"), bad_share=0)
    assert strict.rows.count() == 4 and strict.quarantine.count() == 0
    (tmp_path / "z.csv").write_text("a,b\n")
    none = read_inferred(spark, str(tmp_path / "z.csv"))
    assert none.rows.count() == 0 and none.rows.columns == ["a", "b"]


def test_some_rows_rule_out_types_and_all_rows_decide(spark):
    from tillscope.sources.inferred import TYPES, _fits, _possible

    df = spark.range(20_000).selectExpr("'t' || id AS text", "CAST(id AS STRING) AS whole", "IF(id % 250 = 0, 'x', CAST(id AS STRING)) AS most",
                                        "IF(id % 90 = 0, 'x', CAST(id AS STRING)) AS less", "CAST(NULL AS STRING) AS none", "date'2024-01-01' || '' AS day")
    kinds = {n: [TYPES[k].simpleString() for k in own] for n, own in _possible(df, df.columns, 0.01).items()}
    assert kinds["text"] == [] and kinds["day"] == ["date", "timestamp"] and len(kinds["none"]) == len(TYPES)
    assert kinds["whole"] == kinds["most"] == ["int", "bigint", "double"]
    assert _fits(df, {"most": [1], "less": [1, 3]}) == {"most": (20_000, {1: 19_920}), "less": (20_000, {1: 19_777, 3: 19_777})}
    assert all(len(own) == len(TYPES) for own in _possible(df, df.columns, 0.2).values())


def test_types_are_those_of_all_rows(spark, tmp_path):
    spark.range(5_000).selectExpr("IF(id % 90 = 0, 'x', CAST(id AS STRING)) AS less", "IF(id % 110 = 0, 'x', CAST(id AS STRING)) AS most", "id / 4 AS price").write.option("header", True).csv(str(tmp_path / "many"))
    got = read_inferred(spark, str(tmp_path / "many"))
    assert [f.dataType.simpleString() for f in got.rows.schema] == ["string", "int", "double"]
    assert got.quarantine.count() == 46 and got.rows.count() == 4_954
