import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.clean import (assert_finite, clean_drivers, exact_median, exact_medians,
                                       locf, missing_report)
from tidepanel.operators.windows import lag

GAPS = [("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, float("inf")), ("a", 5, 4.0),
        ("b", 1, None), ("b", 2, None),
        ("c", 1, 2.0), ("c", 2, float("nan")), ("c", 3, -float("inf")),
        ("d", 7, 5.0)]


def test_missing_report(spark):
    df = spark.createDataFrame(GAPS, "k string, p int, x double")
    r = missing_report(df, ["x"]).first()
    assert (r.n_nan, r.n_inf) == (5, 2)


def test_clean_drivers(spark):
    df = spark.createDataFrame(GAPS, "k string, p int, x double")
    out = {(r.k, r.p): r.x for r in clean_drivers(df, ["x"], "k", "p").collect()}
    # a: ffill then bfill; inf treated as missing
    assert [out[("a", i)] for i in range(1, 6)] == [1.0, 1.0, 1.0, 1.0, 4.0]
    # c: NaN and -inf become null then are filled from the previous value
    assert [out[("c", i)] for i in range(1, 4)] == [2.0, 2.0, 2.0]
    # b has no values at all: global median of the filled column
    filled = [1.0, 1.0, 1.0, 1.0, 4.0, 2.0, 2.0, 2.0, 5.0]
    assert out[("b", 1)] == out[("b", 2)] == float(np.median(filled))
    assert_finite(clean_drivers(df, ["x"], "k", "p"), ["x"])
    with pytest.raises(ValueError):
        assert_finite(df, ["x"])


def test_ffill_idempotent(spark):
    df = spark.createDataFrame(GAPS, "k string, p int, x double")
    once = locf(df, ["x"], "k", "p", backfill=False)
    twice = locf(once, ["x"], "k", "p", backfill=False)
    key = lambda rows: sorted((r.k, r.p, r.x if r.x == r.x else "nan") for r in rows)
    assert key(once.collect()) == key(twice.collect())


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 1001])
def test_exact_median_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(size=n), 3)   # many ties
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,), (float("nan"),)], "x double")
    assert exact_median(df, "x", accuracy=50) == pytest.approx(float(np.median(vals)))


def test_strict_lag_skips_gaps(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 4, 4.0)], "k string, p int, x double")
    out = df.select("p", lag("x", "k", "p").alias("pos"), lag("x", "k", "p", strict=True).alias("cal"))
    got = {r.p: (r.pos, r.cal) for r in out.collect()}
    assert got == {1: (None, None), 2: (1.0, 1.0), 4: (2.0, None)}


def test_exact_median_heavy_duplicates(spark):
    vals = [5.0] * 300 + [6.0] * 300 + [1.0, 9.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert exact_median(df, "x", accuracy=50) == pytest.approx(float(np.median(vals)))
    vals2 = [5.0] * 300 + [6.0] * 301
    df2 = spark.createDataFrame([(v,) for v in vals2], "x double")
    assert exact_median(df2, "x", accuracy=50) == 6.0


def test_exact_median_of_many_distinct_values(spark):
    """More distinct values than any cap, two columns at once, one empty."""
    df = spark.range(250_001).selectExpr("cast((id * 7919) % 250001 AS double) AS x",
                                         "cast(id AS double) / 2 AS y", "cast(NULL AS double) AS z")
    assert exact_medians(df, ["x", "y", "z"]) == {"x": 125_000.0, "y": 62_500.0, "z": None}


def test_median_without_groups_is_distributed(spark):
    from tidepanel.operators.aggregate import median_by
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 7.0)], "x double, y double")
    out = median_by(df, [], ["x", "y"])
    assert tuple(out.first()) == (2.0, 6.0)
    assert "median" not in out._jdf.queryExecution().executedPlan().toString()


def _operators(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_median_has_no_window_over_a_column(spark):
    import re

    from tidepanel.operators.clean import median_row
    df = spark.range(1000).selectExpr("cast(id AS double) AS x", "cast(id % 7 AS double) AS y")
    windows = re.findall(r"Window \[.*", _operators(median_row(df, ["x", "y"])))
    assert windows and all("__part" in w for w in windows)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_median_over_any_number_of_partitions(spark, partitions):
    """Ranks at the ends of partitions, all columns side by side."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(partitions)
        cols = {f"c{n}": rng.normal(size=n) for n in (1, 2, 9, 10, 199, 200)}
        cols["same"] = np.full(150, 3.5)
        cols["inf"] = np.array([-np.inf, 1.0, np.inf, 2.0])
        rows = [tuple(float(v[i]) if i < len(v) else None for v in cols.values())
                for i in range(200)]
        df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
        got = exact_medians(df, list(cols), accuracy=20)
        assert got == {c: pytest.approx(float(np.median(v)), abs=0) for c, v in cols.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
