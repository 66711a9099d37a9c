"""Plan-shape regression tests: the scale properties the design relies on."""

import re

import pytest

import __spark_entry__ as E


def _plan(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    df = E.queries()[name](spark, sf)
    return df._jdf.queryExecution().executedPlan().toString()


HEADLINE = ["gold_panel", "features", "clean_drivers", "gram_matrix", "rolling_backtest",
            "arma_fit", "holdout_accuracy", "within_slope", "panel_star_join"]


@pytest.mark.parametrize("name", HEADLINE)
def test_no_cartesian_and_single_fact_scans(spark, sf, name):
    plan = _plan(spark, sf, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for table in ("lineitem", "orders"):
        assert len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan)) <= 1, table


def test_date_bound_reaches_scan(spark, sf):
    plan = _plan(spark, sf, "filter_scope")
    scan = re.search(r"FileScan parquet [^\n]*/orders\.parquet[^\n]*", plan).group(0)
    assert "GreaterThanOrEqual(o_orderdate" in scan and "LessThan(o_orderdate" in scan


def test_rolling_backtest_shape(spark, sf):
    plan = _plan(spark, sf, "rolling_backtest")
    # one shuffle to months, one to series; no row is copied per origin
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortMergeJoin" not in plan and "Generate" not in plan


def test_backtest_reads_running_moments(spark):
    """Two hundred origins cost what four cost: no Generate over the rows."""
    from tidepanel.operators import arx
    df = spark.range(500).selectExpr("'a' AS k", "cast(id AS int) AS p",
                                     "cast(hash(id) % 100 AS double) AS y",
                                     "cast(hash(id, 3) % 10 AS double) AS x")
    seen = []
    keep = arx.materialize
    arx.materialize = lambda t: (seen.append(_text(t)), keep(t))[1]
    try:
        out = arx.backtest(df, ["k"], "p", "y", ["x"], list(range(100, 300)))
    finally:
        arx.materialize = keep
    assert len(seen) == 1 and "Generate" not in seen[0] and seen[0].count("Exchange") == 1
    assert out.count() == 200 and out.filter("status = 'ok'").count() == 200


def test_pivot_is_one_aggregate(spark, sf):
    plan = _plan(spark, sf, "optional_columns")
    assert plan.count("Exchange hashpartitioning") == 1


def _text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cube,table,columns,date", [
    ("orders_cube", "orders", {"o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                               "o_orderpriority"}, "o_orderdate"),
    ("lineitem_cube", "lineitem", {"l_partkey", "l_quantity", "l_extendedprice", "l_returnflag",
                                   "l_shipdate"}, "l_shipdate"),
    ("rate_cube", "lineitem", {"l_discount", "l_shipdate"}, "l_shipdate")])
def test_cubes_scan_once_pruned_and_bounded(spark, sf, cube, table, columns, date):
    """The inputs of the gold layer, before anything is written: one scan of
    the fact table, only the needed columns, the period range pushed down, a
    partial aggregate before the shuffle."""
    from tidepanel.plans.gold import GoldConfig
    from tidepanel.sources import standins
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = _text(getattr(standins, cube)(spark, sf, GoldConfig()))
    scans = re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet[^\n]*", plan)
    assert len(scans) == 1
    read = re.search(r"ReadSchema: struct<([^>]*)>", scans[0]).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == columns
    assert f"GreaterThanOrEqual({date}" in scans[0] and f"LessThan({date}" in scans[0]
    assert "partial_sum" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("series", ["segment_month", "nation_segment_month", "customer_month"])
def test_series_scan_once(spark, sf, series):
    from tidepanel.plans import series as s
    plan = _text(getattr(s, series)(spark, sf))
    assert len(re.findall(r"FileScan parquet [^\n]*/orders\.parquet", plan)) == 1
    assert "partial_sum" in plan


def test_lag_orders_share_one_aggregate(spark, sf):
    """Three lag orders of 125 series: one scan, one pass of co-moments."""
    from tidepanel.operators.arx import fit_orders
    from tidepanel.plans.series import nation_segment_month
    plan = _text(fit_orders(nation_segment_month(spark, sf), ["k"], "p", "y", ["x1"],
                            [(0, 0, 0), (1, 0, 0), (2, 0, 0)]))
    assert plan.count("MapInPandas") == 1 and plan.count("partial_covar_pop") > 0
    assert len(re.findall(r"FileScan parquet [^\n]*/orders\.parquet", plan)) == 1
