from pyspark.sql import functions as F

from tidepanel.operators.joins import (MAX_BROADCAST_BYTES, broadcast_bounded, full_outer_merge,
                                       left_attach, star_join)


def _sides(spark):
    a = spark.createDataFrame([(2000, 1.0), (2001, 2.0)], "year int, a double")
    b = spark.createDataFrame([(2001, 10.0), (2002, 20.0)], "year int, b double")
    c = spark.createDataFrame([(2003, 7.0)], "year int, c double")
    return a, b, c


def test_full_outer_merge_disjoint(spark):
    a, b, c = _sides(spark)
    got = {r.year: (r.a, r.b, r.c) for r in full_outer_merge([a, b, c], "year").collect()}
    assert got == {2000: (1.0, None, None), 2001: (2.0, 10.0, None), 2002: (None, 20.0, None),
                   2003: (None, None, 7.0)}


def test_left_attach_and_star(spark):
    a, b, c = _sides(spark)
    got = {r.year: r.b for r in left_attach(a, b, "year", right_bound=2).collect()}
    assert got == {2000: None, 2001: 10.0}          # 2002 only on the right: lost
    fact = spark.createDataFrame([(2001, "x"), (2001, "y"), (2003, "x")], "year int, k string")
    s = star_join(fact, [b, c], "year", dim_bound=4)
    assert sorted((r.year, r.k, r.b, r.c) for r in s.collect()) == [
        (2001, "x", 10.0, None), (2001, "y", 10.0, None), (2003, "x", None, 7.0)]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_broadcast_only_with_bound(spark):
    a, _, _ = _sides(spark)
    assert "broadcast" in broadcast_bounded(a, 2)._jdf.queryExecution().logical().toString().lower()
    unbounded = broadcast_bounded(a, None)._jdf.queryExecution().logical().toString().lower()
    too_big = broadcast_bounded(a, MAX_BROADCAST_BYTES + 1)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in unbounded and "broadcast" not in too_big
    wide = broadcast_bounded(a.withColumns({f"s{i}": F.lit("x") for i in range(20)}), 100_000)
    assert "broadcast" not in wide._jdf.queryExecution().logical().toString().lower()
