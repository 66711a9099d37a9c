import datetime as dt

from pyspark.sql import functions as F

from tidepanel.functions import scalars as S


def test_period_from_text(spark):
    rows = [("2016",), ("2016-01",), ("2016-12-31",), ("abc",), ("",), (None,),
            ("2016-01-05 10:00:00",)]
    df = spark.createDataFrame(rows, "ref_date string")
    out = df.select(S.period_expr(df, "ref_date", "year").alias("y"),
                    S.period_expr(df, "ref_date", "month").alias("m")).collect()
    assert [r.y for r in out] == [2016, 2016, 2016, None, None, None, 2016]
    assert [r.m for r in out] == [None, 2016 * 12, 2016 * 12 + 11, None, None, None, 2016 * 12]


def test_period_from_timestamp(spark):
    df = spark.createDataFrame([(dt.datetime(1998, 3, 4, 5, 6),)], "ts timestamp_ntz")
    r = df.select(S.period_expr(df, "ts", "year").alias("y"),
                  S.period_expr(df, "ts", "month").alias("m"),
                  S.period_expr(df, "ts", "day").alias("d")).first()
    assert (r.y, r.m) == (1998, 1998 * 12 + 2)
    assert r.d == (dt.date(1998, 3, 4) - dt.date(1970, 1, 1)).days


def test_range_bound_reaches_scan(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    o = S.add_period(o, "o_orderdate", "year", "year")
    plan = S.filter_period_range(o, "year", 1996, 1997, raw="o_orderdate") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan.split("PushedFilters")[1][:400]


def test_to_double_suppressed(spark):
    df = spark.createDataFrame([("1.5",), ("..",), ("x",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(S.to_double("v")).collect()] == [1.5, None, None, None, None]


def test_canonical_category_first_hit_wins(spark):
    rules = [("construction", "construction"), ("manufacturing", "manufacturing"),
             ("retail trade", "retail_trade"), ("retail", "retail_trade")]
    df = spark.createDataFrame([("Construction manufacturing",), ("Retail",), ("Mining",)], "n string")
    assert [r[0] for r in df.select(S.canonical_category("n", rules)).collect()] == \
        ["construction", "retail_trade", None]


def test_keyword_any_loose_and_whole_word(spark):
    df = spark.createDataFrame([("transport",), ("port",), ("broadway",)], "a string")
    loose = [r[0] for r in df.select(S.keyword_any("a", ["port", "road"])).collect()]
    word = [r[0] for r in df.select(S.keyword_any("a", ["port", "road"], whole_word=True)).collect()]
    assert loose == [True, True, True]
    assert word == [False, True, False]


def test_finite_and_safe_ops(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(S.finite_or_null("x")).collect()] == [None, None, None, 1.0, None]
    d2 = spark.createDataFrame([(1.0, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in d2.select(S.safe_div("a", "b")).collect()] == [None, None, 1.5]
    assert [r[0] for r in d2.select(S.horizontal_sum(["a", "b"])).collect()] == [1.0, 1.0, 5.0]


def test_dummies_monotone(spark):
    df = spark.range(1990, 2010).withColumnRenamed("id", "p")
    vals = [r[0] for r in df.orderBy("p").select(S.step_dummy("p", 2000)).collect()]
    assert vals == sorted(vals) and sum(vals) == 10
    pul = [r[0] for r in df.orderBy("p").select(S.pulse_dummy("p", [2000, 2001])).collect()]
    assert sum(pul) == 2
