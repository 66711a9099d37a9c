import pytest
from pyspark.sql import functions as F

from tidepanel.operators.aggregate import best_by, focal_share, focal_split_join, pivot_measures

FOCAL_ROWS = [
    (2000, "US", 10.0), (2000, "CN", 5.0), (2000, "ALL", 100.0),
    (2001, "CN", 7.0),                       # focal missing
    (2002, "US", 3.0),                       # rest missing
    (2003, "US", 2.0), (2003, "CN", -2.0),   # zero total
    (2004, None, 9.0),                       # null partner only
]


def test_focal_share_edges(spark):
    df = spark.createDataFrame(FOCAL_ROWS, "p int, partner string, v double")
    out = {r.p: r for r in focal_share(df, "p", "partner", "v", "US", exclude=["ALL"]).collect()}
    assert set(out) == {2000, 2001, 2002, 2003}
    assert (out[2000].exports_us, out[2000].exports_total) == (10.0, 15.0)
    assert abs(out[2000].us_export_share - 10 / 15) < 1e-12
    assert out[2001].exports_us is None and out[2001].exports_total is None
    assert out[2002].exports_total is None and out[2002].us_export_share is None
    assert out[2003].exports_total == 0.0 and out[2003].us_export_share is None


def test_focal_total_equals_join_form(spark):
    df = spark.createDataFrame(FOCAL_ROWS, "p int, partner string, v double")
    a = {r.p: r.exports_total for r in focal_share(df, "p", "partner", "v", "US").collect()}
    j = {r.p: (None if r.focal_value is None or r.rest_value is None else r.focal_value + r.rest_value)
         for r in focal_split_join(df, "p", "partner", "v", "US").collect()}
    assert a == j


def test_pivot_missing_duplicate_unexpected(spark):
    rows = [(1, "k", "A", 1.0), (1, "k", "A", 3.0), (1, "k", "Z", 9.0), (2, "k", "B", 4.0)]
    df = spark.createDataFrame(rows, "p int, k string, m string, v double")
    out = pivot_measures(df, ["p", "k"], "m", "v", {"A": "a", "B": "b", "C": "c"}, "avg")
    assert out.columns == ["p", "k", "a", "b", "c"]
    got = {r.p: (r.a, r.b, r.c) for r in out.collect()}
    assert got == {1: (2.0, None, None), 2: (None, 4.0, None)}
    assert dict(out.dtypes)["c"] == "double"


def test_best_by_ties_and_nulls(spark):
    rows = [("a", 0, 5.0), ("a", 1, 5.0), ("a", 2, 7.0), ("b", 0, None), ("b", 1, 3.0),
            ("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, pos int, aic double")
    got = {r.k: r.pos for r in best_by(df, ["k"], "aic", ["pos"], ["pos"]).collect()}
    assert got == {"a": 0, "b": 1}


def test_sums_keep_every_digit_or_raise(spark):
    from tidepanel.operators.aggregate import exact_sum
    from tidepanel.sources.standins import units_sum, units_to_decimal
    df = spark.createDataFrame([(0.125,), (0.125,), (0.004,), (None,)], "v double")
    assert df.agg(exact_sum("v", 3).alias("s")).first().s == 0.254
    out = df.agg(units_sum("v", 3).alias("u")).select(units_to_decimal("u", 3).alias("s")).first()
    assert float(out.s) == 0.254
    for agg in (exact_sum("v"), units_sum("v")):
        with pytest.raises(Exception, match="more than 2 decimals"):
            df.agg(agg).collect()
