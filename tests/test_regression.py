import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.design import cross_products, design_matrix
from tidepanel.operators.regression import fit_ols


def _design_frame(spark, seed=3):
    """Panel with an industry-level and a period-only regressor (rank
    deficient with period effects) and a level seen once."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in ["a", "b", "c"]:
        for t in range(2000, 2008):
            x1 = float(rng.normal())
            x2 = float(t - 2000) * 0.01            # depends on period only
            y = 1.0 + 0.5 * x1 + (0.2 if k == "b" else 0.0) + float(rng.normal() * 0.1)
            rows.append((k, t, y, x1, x2))
    rows.append(("z", 2003, 2.0, 0.3, 0.03))        # level z seen once -> h = 1
    return spark.createDataFrame(rows, "k string, t int, y double, x1 double, x2 double")


def _numpy_fit(pdf, names):
    x = pdf[names].to_numpy(float)
    y = pdf["y"].to_numpy(float)
    xp = np.linalg.pinv(x, rcond=1e-12)
    b = xp @ y
    e = y - x @ b
    h = np.einsum("ij,ji->i", x, xp)
    return x, y, b, e, h, xp


def test_min_norm_solution_and_rank(spark):
    df = _design_frame(spark)
    dm, names = design_matrix(df, ["x1", "x2"], ["k", "t"])
    res = fit_ols(dm, "y", names, cov_type="HC3")
    pdf = dm.toPandas()
    x, y, b, e, h, xp = _numpy_fit(pdf, names)
    assert res.rank == np.linalg.matrix_rank(x)
    np.testing.assert_allclose(res.coef, b, rtol=1e-6, atol=1e-8)
    assert res.ssr == pytest.approx(float(e @ e), rel=1e-9)
    # x2 lies in the span of the period dummies: not identified
    assert not res.identified[names.index("x2")]
    assert res.identified[names.index("x1")]


def test_hc3_matches_numpy(spark):
    df = _design_frame(spark).filter("k != 'z'")
    dm, names = design_matrix(df, ["x1"], ["k", "t"])
    res = fit_ols(dm, "y", names, cov_type="HC3")
    x, y, b, e, h, xp = _numpy_fit(dm.toPandas(), names)
    cov = xp @ np.diag(e ** 2 / (1 - h) ** 2) @ xp.T
    for i, se in enumerate(res.std_error):
        assert se == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6)
    assert res.r_squared == pytest.approx(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())))


def test_level_seen_once_gives_null_se(spark):
    df = _design_frame(spark)
    dm, names = design_matrix(df, ["x1"], ["k", "t"])
    res = fit_ols(dm, "y", names, cov_type="HC3")
    assert res.std_error[names.index("k_z")] is None


def test_exact_decimal_gram_is_order_free(spark):
    df = spark.createDataFrame([(0.1, 0.2), (0.3, 0.7), (1e-8, 3.0)], "a double, b double")
    r1 = cross_products(df, ["a", "b"], decimal_scale=8).first()
    r2 = cross_products(df.repartition(3), ["a", "b"], decimal_scale=8).first()
    assert r1 == r2 and r1["a__b"] == pytest.approx(0.1 * 0.2 + 0.3 * 0.7 + 1e-8 * 3.0)


def test_within_matches_dummies_unbalanced(spark):
    from tidepanel.operators.within import fe_within_ols
    rng = np.random.default_rng(11)
    rows = []
    for e in range(12):
        for t in range(9):
            if rng.random() < 0.3:          # unbalanced: ~30 % of cells missing
                continue
            x1, x2 = float(rng.normal()), float(rng.normal())
            y = 0.7 * x1 - 0.4 * x2 + 0.3 * e + 0.1 * t + float(rng.normal() * 0.2)
            rows.append((f"e{e:02d}", t, y, x1, x2))
    df = spark.createDataFrame(rows, "k string, t int, y double, x1 double, x2 double")
    dm, names = design_matrix(df, ["x1", "x2"], ["k", "t"])
    full = fit_ols(dm, "y", names, cov_type="HC1")
    within, rounds = fe_within_ols(df, "y", ["x1", "x2"], "k", "t", cov_type="HC1")
    assert rounds > 1
    for i, c in enumerate(["x1", "x2"]):
        j = names.index(c)
        assert within.coef[i] == pytest.approx(full.coef[j], rel=1e-7)
        assert within.std_error[i] == pytest.approx(full.std_error[j], rel=1e-6)
    assert within.ssr == pytest.approx(full.ssr, rel=1e-7)
    nonrob, _ = fe_within_ols(df, "y", ["x1", "x2"], "k", "t", cov_type="nonrobust")
    full_nr = fit_ols(dm, "y", names, cov_type="nonrobust")
    assert nonrob.std_error[0] == pytest.approx(full_nr.std_error[names.index("x1")], rel=1e-6)


def test_predictions_do_not_depend_on_dropped_level(spark):
    from tidepanel.operators.design import treatment_dummies
    from tidepanel.operators.regression import predict
    df = _design_frame(spark).filter("k != 'z'")
    levels = ["a", "b", "c"]
    first = df.withColumns(treatment_dummies("k", levels)).withColumn("const", F.lit(1))
    last = df.withColumns(treatment_dummies("k", levels[::-1])).withColumn("const", F.lit(1))
    n1 = ["const", "x1", "k_b", "k_c"]
    n2 = ["const", "x1", "k_b", "k_a"]
    r1, r2 = fit_ols(first, "y", n1, "nonrobust"), fit_ols(last, "y", n2, "nonrobust")
    p1 = [r[0] for r in first.orderBy("k", "t").select(predict(n1, r1.coef)).collect()]
    p2 = [r[0] for r in last.orderBy("k", "t").select(predict(n2, r2.coef)).collect()]
    np.testing.assert_allclose(p1, p2, rtol=1e-9)
    assert r1.coef[1] == pytest.approx(r2.coef[1], rel=1e-9)


@pytest.mark.parametrize("cov", ["HC3", "HC1", "HC0", "nonrobust"])
def test_factors_equal_dummy_columns(spark, cov):
    df = _design_frame(spark)
    dm, names = design_matrix(df, ["x1", "x2"], ["k", "t"])
    wide = fit_ols(dm, "y", names, cov_type=cov)
    lean = fit_ols(df.repartition(3), "y", ["const", "x1", "x2"], cov_type=cov, factors=["k", "t"])
    assert lean.names == names and (lean.rank, lean.n) == (wide.rank, wide.n)
    np.testing.assert_allclose(lean.coef, wide.coef, rtol=1e-7, atol=1e-9)
    for a, b in zip(lean.std_error, wide.std_error):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6))
    assert lean.ssr == pytest.approx(wide.ssr) and lean.sst == pytest.approx(wide.sst)


def test_two_thousand_levels(spark):
    """No cap on levels, and no dummy columns."""
    df = spark.range(12_000).selectExpr(
        "id % 2000 AS k", "id div 2000 AS t", "cast(hash(id) % 1000 AS double) / 500 AS x",
        "(id % 2000) / 100.0 + 3 * cast(hash(id) % 1000 AS double) / 500 "
        "+ cast(hash(id, 7) % 100 AS double) / 1e4 AS y")
    res = fit_ols(df, "y", ["const", "x"], cov_type="HC3", factors=["k", "t"])
    assert len(res.names) == 2 + 1999 + 5 and res.rank == len(res.names)
    assert res.coef[1] == pytest.approx(3.0, abs=1e-3) and 0 < res.std_error[1] < 1e-2


def test_unconverged_projection_raises(spark):
    from tidepanel.operators.within import alternating_demean
    rows = [("a", 1, 1.0), ("a", 2, 5.0), ("b", 2, 2.0), ("b", 3, 9.0), ("c", 3, 4.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        alternating_demean(df, ["y"], "k", "t", max_iter=1)


def test_within_of_a_disconnected_panel(spark):
    """Three parts that share no period: the dummy regression's degrees of
    freedom, errors and rank."""
    from tidepanel.operators.components import count_parts
    from tidepanel.operators.within import fe_within_ols
    rng = np.random.default_rng(2)
    rows = [(f"{part}{e}", 10 * part + t, float(rng.normal()), float(rng.normal()))
            for part in range(3) for e in range(5) for t in range(6) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, t int, y double, x double")
    assert count_parts(df, "k", "t") == 3
    want = fit_ols(df, "y", ["const", "x"], cov_type="HC1", factors=["k", "t"])
    got, _ = fe_within_ols(df, "y", ["x"], "k", "t", cov_type="HC1")
    assert got.std_error[0] == pytest.approx(want.std_error[want.names.index("x")], rel=1e-6)


def test_parts_of_a_long_chain(spark):
    """Each entity links two periods: one part with a path of 600 steps, and
    a second one; the number of rounds stays small."""
    from tidepanel.operators.components import panel_parts
    rows = [(f"a{i}", i + d) for i in range(300) for d in (0, 1)] + [("z", 5000), ("z", 5001),
                                                                     (None, 1), ("q", None)]
    df = spark.createDataFrame(rows, "e string, t int")
    got = {r.t: r.part for r in panel_parts(df, "e", "t", max_rounds=14).collect()}
    assert got == {**{t: 0 for t in range(301)}, 5000: 5000, 5001: 5000}
