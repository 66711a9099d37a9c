"""Block elimination against the dummy regression."""

import math

import numpy as np
import pytest

from tidepanel.operators.absorb import fit_absorbed
from tidepanel.operators.regression import fit_ols


def _panel(spark, seed=4, missing=0.3, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(14):
        for t in range(9):
            if rng.random() < missing:
                continue
            x1, x2 = float(rng.normal() + e), float(rng.normal() + 100.0)
            rows.append((f"e{e:02d}", t, f"s{e % 3}{t % 2}",
                         0.7 * x1 - 0.4 * x2 + 0.3 * e + 0.1 * t + float(rng.normal()), x1, x2))
    for _ in range(hot):
        rows.append(("e03", int(rng.integers(0, 9)), "s01", float(rng.normal()),
                     float(rng.normal()), float(rng.normal())))
    rows.append(("e01", 2, "s00", None, 1.0, 1.0))
    return spark.createDataFrame(
        rows, "k string, t int, s string, y double, x1 double, x2 double").repartition(5)


def _same(fit, want, absorb, x):
    """All coefficients, errors and statistics of the dummy regression."""
    res = fit.result
    assert (res.n, res.rank) == (want.n, want.rank)
    assert res.ssr == pytest.approx(want.ssr, rel=1e-8) and res.sst == pytest.approx(want.sst)
    assert (res.aic, res.bic) == (pytest.approx(want.aic), pytest.approx(want.bic))
    by = {n: (want.coef[i], want.std_error[i], want.identified[i])
          for i, n in enumerate(want.names)}
    got = {n: (res.coef[i], res.std_error[i], res.identified[i]) for i, n in enumerate(res.names)}
    levels = sorted(fit.effects.collect(), key=lambda r: r[0])
    assert levels[0].effect == 0.0
    got |= {f"{absorb}_{r[0]}": (r.effect, r.std_error, r.identified) for r in levels[1:]}
    assert set(got) == set(by)
    for name, (b, se, known) in by.items():
        assert got[name][2] == known, name
        if known:
            assert got[name][0] == pytest.approx(b, rel=1e-6, abs=1e-8), name
            assert (got[name][1] is None) == (se is None), name
            if se is not None:
                assert got[name][1] == pytest.approx(se, rel=1e-5), name


@pytest.mark.parametrize("cov", ["HC3", "HC1", "HC0", "nonrobust"])
def test_equals_the_dummy_regression(spark, cov):
    df = _panel(spark)
    want = fit_ols(df, "y", ["const", "x1", "x2"], cov_type=cov, factors=["t", "k"])
    _same(fit_absorbed(df, "y", ["x1", "x2"], "k", cov, factors=["t"]), want, "k", ["x1", "x2"])


def test_two_small_factors_and_a_hot_level(spark):
    df = _panel(spark, hot=400)
    want = fit_ols(df, "y", ["const", "x1"], cov_type="HC3", factors=["t", "s", "k"])
    _same(fit_absorbed(df, "y", ["x1"], "k", "HC3", factors=["t", "s"]), want, "k", ["x1"])


def test_regressors_contained_in_the_effects(spark):
    """A regressor that is constant within levels, and one within the small
    factor's: not identified, as in the dummy regression."""
    df = _panel(spark).selectExpr("*", "CAST(substr(k, 2) AS DOUBLE) AS of_k", "t * 2.0 AS of_t")
    x = ["x1", "of_k", "of_t"]
    want = fit_ols(df, "y", ["const", *x], cov_type="HC1", factors=["t", "k"])
    fit = fit_absorbed(df, "y", x, "k", "HC1", factors=["t"])
    _same(fit, want, "k", x)
    assert fit.result.identified[1:4] == [True, False, False]


def test_levels_seen_once(spark):
    df = _panel(spark).unionByName(spark.createDataFrame(
        [("z1", 3, "s00", 5.0, 0.4, 99.0), ("z2", 4, "s00", -1.0, 0.1, 98.0)],
        "k string, t int, s string, y double, x1 double, x2 double"))
    fit = fit_absorbed(df, "y", ["x1", "x2"], "k", "HC3", factors=["t"])
    without = fit_absorbed(df.filter("k < 'z'"), "y", ["x1", "x2"], "k", "HC3", factors=["t"])
    # they say nothing about the slopes and have no error of their own
    assert np.allclose(fit.result.coef[1:3], without.result.coef[1:3])
    assert np.allclose(fit.result.std_error[1:3], without.result.std_error[1:3])
    level = {r.k: r for r in fit.effects.collect()}
    assert level["z1"].std_error is None and level["z1"].n_obs == 1
    assert level["e05"].std_error > 0


def test_disconnected_panel_has_the_dummy_regressions_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{part}{e}", 10 * part + t, float(rng.normal()), float(rng.normal()))
            for part in range(3) for e in range(4) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, y double, x double")
    want = fit_ols(df, "y", ["const", "x"], cov_type="HC1", factors=["t", "k"])
    fit = fit_absorbed(df, "y", ["x"], "k", "HC1", factors=["t"])
    assert fit.result.rank == want.rank == 1 + 12 + 15 - 3
    assert fit.result.std_error[1] == pytest.approx(want.std_error[want.names.index("x")], rel=1e-6)


def test_a_million_levels(spark):
    """No k x k array over the levels: the small block is 6 x 6."""
    df = spark.range(2_500_000).selectExpr(
        "id % 1000000 AS k", "id div 1000000 AS t", "cast(hash(id) % 1000 AS double) / 500 AS x",
        "(id % 1000000) / 1e5 + 3 * cast(hash(id) % 1000 AS double) / 500 "
        "+ cast(hash(id, 7) % 100 AS double) / 1e4 AS y")
    fit = fit_absorbed(df, "y", ["x"], "k", "HC3", factors=["t"])
    assert fit.result.rank == 1_000_000 + 3 and fit.result.n == 2_500_000
    assert fit.result.coef[1] == pytest.approx(3.0, abs=1e-4)
    assert 0 < fit.result.std_error[1] < 1e-4
    assert fit.effects.count() == 1_000_000
    assert len(fit.result.names) == 4 and math.isfinite(fit.result.aic)


def test_refuses_nothing_to_fit(spark):
    df = _panel(spark)
    with pytest.raises(ValueError, match="no regressor"):
        fit_absorbed(df, "y", [], "k")
    with pytest.raises(ValueError, match="no complete rows"):
        fit_absorbed(df.filter("false"), "y", ["x1"], "k")
