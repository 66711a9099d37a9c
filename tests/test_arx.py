import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators.arx import (backtest, fit_orders, fit_params, scenario_forecasts,
                                     select_order, sweep)
from tidepanel.operators.clean import flag_non_finite
from tidepanel.operators.scenario import apply_scenarios


def _panel(spark, n=120):
    rng = np.random.default_rng(3)
    rows = []
    for k, phi in (("ar", 0.8), ("white", 0.0)):
        u = 0.0
        for t in range(n):
            x = float(rng.normal())
            u = phi * u + float(rng.normal())
            rows.append((k, t, 5.0 + 2.0 * x + u, x))
    return spark.createDataFrame(rows, "k string, p int, y double, x double")


def _ols(rows, lags, start):
    y = np.array([r.y for r in rows])
    x = np.array([r.x for r in rows])
    z = np.stack([np.ones(len(y))] + [np.concatenate([[np.nan] * j, y[:-j]])
                                      for j in range(1, lags + 1)] + [x], axis=1)[start:]
    b, *_ = np.linalg.lstsq(z, y[start:], rcond=None)
    e = y[start:] - z @ b
    return b, (e @ e) / len(e)


def test_sweep_solves_and_inverts():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(50, 4))
    z[:, 2] = z[:, 0] - 2 * z[:, 1]              # redundant third column
    s = np.stack([z.T @ z, np.eye(4)])
    g = s[0].copy()
    assert sweep(s, 3).tolist() == [2, 3]
    b = np.linalg.solve(g[:2, :2], g[:2, 3])
    assert np.allclose(s[0, :3, 3], [*b, 0]) and np.allclose(-s[0, :2, :2], np.linalg.inv(g[:2, :2]))
    assert s[0, 3, 3] == pytest.approx(g[3, 3] - g[:2, 3] @ b)


def test_fits_equal_numpy_on_common_rows(spark):
    df = _panel(spark)
    fits = fit_orders(df, ["k"], "p", "y", ["x"], [(0, 0, 0), (1, 0, 0), (2, 0, 0)])
    for k in ("ar", "white"):
        rows = df.filter(F.col("k") == k).orderBy("p").collect()
        for r in fits.filter(F.col("k") == k).collect():
            b, s2 = _ols(rows, r.ar, 2)
            assert np.allclose([r.intercept, *r.phi, *r.beta], b) and r.sigma2 == pytest.approx(s2)
            assert r.n_obs == 118 and r.status == "ok"
    best = {r.k: r.ord for r in select_order(fits, ["k"]).collect()}
    assert best["ar"] in ("(1, 0, 0)", "(2, 0, 0)")


def test_differenced_order(spark):
    df = _panel(spark).filter("k = 'ar'")
    r = fit_orders(df, ["k"], "p", "y", ["x"], [(0, 1, 0)]).first()
    pdf = df.orderBy("p").toPandas()
    dy, dx = np.diff(pdf.y), np.diff(pdf.x)
    b, *_ = np.linalg.lstsq(np.stack([np.ones(len(dy)), dx], axis=1), dy, rcond=None)
    assert np.allclose([r.intercept, *r.beta], b)
    with pytest.raises(ValueError, match="moving-average"):
        backtest(df, ["k"], "p", "y", ["x"], [50], (0, 0, 1))


def test_every_series_has_a_status(spark):
    rows = [("short", t, 1.0 + t, 0.0) for t in range(3)]
    rows += [("exact", t, 2.0 * t, float(t)) for t in range(12)]
    rows += [("empty", t, None, 1.0) for t in range(5)]
    df = spark.createDataFrame(rows, "k string, p int, y double, x double")
    fits = fit_orders(df, ["k"], "p", "y", ["x"], [(1, 0, 0), (0, 0, 0)])
    best = {r.k: r for r in select_order(fits, ["k"]).collect()}
    assert {k: r.status for k, r in best.items()} == {
        "short": "too_short", "exact": "perfect_fit", "empty": "too_short"}
    params = fit_params(fits.filter("ar = 1"), ["k"], ["x"], 9).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in params} == {"short": 1, "exact": 4, "empty": 1}
    fut = df.select("k", (F.col("p") + 20).alias("p"), "x", F.lit("s").alias("scenario"))
    out = scenario_forecasts(df, fits.filter("ar = 0"), fut, ["k"], "p", "y", ["x"])
    assert {r.status for r in out.filter("k = 'exact'").collect()} == {"perfect_fit"}
    assert {r.status for r in out.filter("k <> 'exact'").collect()} <= {"too_short"}


@pytest.mark.parametrize("order", [(0, 0, 0), (1, 0, 0), (2, 0, 0), (1, 1, 0), (2, 1, 0)])
def test_forecasts_follow_the_recursion(spark, order):
    df = _panel(spark).filter("k = 'ar'")
    train = df.filter("p < 100")
    fut = df.filter("p >= 100").select("k", "p", "x", F.lit("s").alias("scenario"))
    fits = fit_orders(train, ["k"], "p", "y", ["x"], [order])
    f = fits.first()
    got = {r.p: r for r in scenario_forecasts(train, fits, fut, ["k"], "p", "y", ["x"]).collect()}
    pdf = df.orderBy("p").toPandas()
    y, x = list(pdf.y[:100]), list(pdf.x)
    phi = [*f.phi, 0.0, 0.0][:2]
    psi, level = [], []
    for h, t in enumerate(range(100, 120)):
        if order[1]:
            d = [y[-1] - y[-2], y[-2] - y[-3]]
            y.append(y[-1] + f.intercept + f.beta[0] * (x[t] - x[t - 1])
                     + phi[0] * d[0] + phi[1] * d[1])
        else:
            y.append(f.intercept + f.beta[0] * x[t] + phi[0] * y[-1] + phi[1] * y[-2])
        psi.append(1.0 if h == 0 else sum(p * psi[h - 1 - j] for j, p in enumerate(phi) if h > j))
        level.append(sum(psi) if order[1] else psi[-1])
        half = 1.959963984540054 * np.sqrt(f.sigma2 * sum(v * v for v in level))
        assert got[t].predicted == pytest.approx(y[-1])
        assert got[t].ci_upper - got[t].predicted == pytest.approx(half)


def test_gap_in_future_drivers(spark):
    df = _panel(spark).filter("k = 'ar'")
    train = df.filter("p < 100")
    fut = df.filter("p >= 100 AND p <> 105").select("k", "p", "x", F.lit("s").alias("scenario"))
    fits = fit_orders(train, ["k"], "p", "y", ["x"], [(1, 0, 0)])
    out = {r.p: (r.status, r.predicted is None)
           for r in scenario_forecasts(train, fits, fut, ["k"], "p", "y", ["x"]).collect()}
    assert all(out[t] == ("ok", False) for t in range(100, 105))
    assert all(out[t] == ("missing_driver", True) for t in range(106, 120))


def test_backtest_uses_training_rows_only(spark):
    df = _panel(spark, 60).filter("k = 'ar'")
    out = {r.train_end: r for r in backtest(df, ["k"], "p", "y", ["x"], [40, 50, 80]).collect()}
    rows = df.filter("p <= 40").orderBy("p").collect()
    b, s2 = _ols(rows, 1, 1)
    nxt = df.filter("p = 41").first()
    assert out[40].predicted == pytest.approx(b[0] + b[1] * rows[-1].y + b[2] * nxt.x)
    assert out[40].actual == nxt.y and out[40].status == out[50].status == "ok"
    assert out[80].status == "missing_period" and out[80].predicted is None


def test_backtest_keeps_the_actual_after_an_absent_origin(spark):
    df = _panel(spark, 60).filter("k = 'ar' AND p <> 40")
    nxt = df.filter("p = 41").first()
    out = {r.train_end: r for r in backtest(df, ["k"], "p", "y", ["x"], [39, 40, 59]).collect()}
    assert out[40].status == "missing_period" and out[40].actual == nxt.y
    assert out[40].predicted is None and out[40].error is None
    assert out[39].status == "missing_period" and out[39].actual is None


def test_scenarios_chain_edits_and_keep_a_baseline(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "p int, x double")
    assert apply_scenarios(df, {}).collect() == [(1, 2.0, "baseline"), (2, 3.0, "baseline")]
    out = apply_scenarios(df, {"s": [("x", "set", 1.0), ("x", "add", 5.0)],
                               "t": [("x", "add", 1.0), ("x", "add", 1.0)]}).collect()
    assert {(r.scenario, r.p): r.x for r in out} == {
        ("s", 1): 6.0, ("s", 2): 6.0, ("t", 1): 4.0, ("t", 2): 5.0}


def test_in_plan_finite_check(spark):
    ok = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert ok.select(flag_non_finite(ok, ["x"]).alias("f")).count() == 2
    bad = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(Exception, match="non-finite"):
        bad.select(flag_non_finite(bad, ["x"]).alias("f")).collect()


def _lagged(v, n):
    return np.concatenate([[np.nan] * n, v[:len(v) - n]])


def _least_squares(y, columns):
    z = np.stack([np.ones(len(y)), *columns], axis=1)
    ok = np.isfinite(z).all(axis=1) & np.isfinite(y)
    b, *_ = np.linalg.lstsq(z[ok], y[ok], rcond=None)
    return b, y - z @ b, ok


def _arma(n=400, phi=0.6, theta=0.5):
    rng = np.random.default_rng(7)
    e, x = rng.normal(size=n), rng.normal(size=n)
    u = np.zeros(n)
    for t in range(1, n):
        u[t] = phi * u[t - 1] + e[t] + theta * e[t - 1]
    return 2.0 + 1.5 * x + u, x


def test_moving_average_by_two_regressions(spark):
    """Both stages against numpy, on rows in any order and partitioning."""
    y, x = _arma()
    df = spark.createDataFrame([("a", t, float(y[t]), float(x[t])) for t in range(len(y))],
                               "k string, p int, y double, x double").repartition(7)
    grid = [(1, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 0), (0, 0, 2), (2, 0, 1), (1, 0, 2)]
    fits = {(r.ar, r.ma): r for r in fit_orders(df, ["k"], "p", "y", ["x"], grid).collect()}
    assert len(fits) == 7
    e = _least_squares(y, [_lagged(y, n) for n in range(1, 5)] + [x])[1]
    ok = np.isfinite(_lagged(e, 2))
    hide = np.where(ok, y, np.nan)
    for (p, q), r in fits.items():
        b, res, used = _least_squares(hide, [_lagged(y, n) for n in range(1, p + 1)]
                                      + [_lagged(e, n) for n in range(1, q + 1)] + [x])
        assert np.allclose([r.intercept, *r.phi, *r.theta, *r.beta], b)
        assert r.n_obs == used.sum() == 394 and r.sigma2 == pytest.approx(np.mean(res[used] ** 2))
        assert np.allclose(r.shocks, e[::-1][:2])
    # the terms are near the ones that made the series
    assert abs(fits[0, 1].theta[0]) > 0.5
    params = {r.param_name for r in fit_params(
        fit_orders(df, ["k"], "p", "y", ["x"], [(1, 0, 2)]), ["k"], ["x"], 9).collect()}
    assert params == {"intercept", "x", "ar.L1", "ma.L1", "ma.L2", "sigma2"}


def test_moving_average_of_odd_series(spark):
    """Too short for the long autoregression, exact, empty: a row for every
    order; the orders without moving-average terms still fit."""
    rng = np.random.default_rng(2)
    rows = [("short", t, float(rng.normal()), float(rng.normal())) for t in range(8)]
    rows += [("exact", t, 2.0 * t, float(t % 3)) for t in range(30)]
    rows += [("empty", t, None, 1.0) for t in range(5)]
    rows += [(None, t, float(rng.normal()), float(rng.normal())) for t in range(40)]
    df = spark.createDataFrame(rows, "k string, p int, y double, x double")
    fits = fit_orders(df, ["k"], "p", "y", ["x"], [(1, 0, 0), (1, 0, 1), (0, 0, 1)])
    got = {(r.k, r.ord): r for r in fits.collect()}
    assert len(got) == 12
    assert {k: [got[k, f"{o}"].status for o in ("(1, 0, 0)", "(1, 0, 1)", "(0, 0, 1)")]
            for k in ("short", "exact", "empty", None)} == {
        "short": ["ok", "too_short", "too_short"],
        "exact": ["perfect_fit", "perfect_fit", "ok"],
        "empty": ["too_short"] * 3, None: ["ok"] * 3}
    assert got["short", "(1, 0, 1)"].theta is None


def _by_hand(y, x, future, p, d, q, fit):
    """The recursion on the differenced scale, summed up again."""
    dy, both = np.array(y, float), np.concatenate([x, future])
    tops = []
    for _ in range(d):
        tops.append(dy[-1])
        dy, both = np.diff(dy), np.diff(both)
    hist, shocks, out = list(dy), list(fit.shocks or []), []
    moved = both[len(both) - len(future):]
    for h, xt in enumerate(moved, 1):
        v = fit.intercept + fit.beta[0] * xt
        v += sum(c * hist[-1 - i] for i, c in enumerate(fit.phi))
        v += sum(c * shocks[j - h + 1] for j, c in enumerate(fit.theta) if j >= h - 1)
        hist.append(v)
        for i in range(d - 1, -1, -1):
            tops[i] += v
            v = tops[i]
        out.append(v)
    return out


@pytest.mark.parametrize("order", [(3, 0, 0), (0, 2, 0), (1, 2, 1), (4, 1, 2), (0, 0, 3),
                                   (2, 3, 0), (1, 0, 2)])
def test_forecasts_of_any_order(spark, order):
    y, x = _arma(120)
    y = y + 0.01 * np.arange(120) ** 2
    df = spark.createDataFrame([("a", t, float(y[t]), float(x[t])) for t in range(120)],
                               "k string, p int, y double, x double")
    future = np.linspace(-1, 1, 6)
    fut = spark.createDataFrame([("a", 120 + i, float(v), "s") for i, v in enumerate(future)],
                                "k string, p int, x double, scenario string")
    fits = fit_orders(df, ["k"], "p", "y", ["x"], [order])
    got = scenario_forecasts(df, fits, fut, ["k"], "p", "y", ["x"]).orderBy("p").collect()
    fit = fits.first()
    assert np.allclose([r.predicted for r in got], _by_hand(y, x, future, *order, fit))
    # psi weights: the response of the recursion to one unit shock
    p, d, q = order
    ar = np.array([1.0, *[-c for c in fit.phi]])
    for _ in range(d):
        ar = np.convolve(ar, [1.0, -1.0])
    psi = []
    for h in range(6):
        v = 1.0 if h == 0 else (fit.theta[h - 1] if h <= q else 0.0)
        v -= sum(ar[i] * psi[h - i] for i in range(1, min(h, len(ar) - 1) + 1))
        psi.append(v)
    half = 1.959963984540054 * np.sqrt(fit.sigma2 * np.cumsum(np.square(psi)))
    assert np.allclose([(r.ci_upper - r.ci_lower) / 2 for r in got], half, rtol=1e-6)


def test_an_order_beyond_the_history_raises(spark):
    df = _panel(spark)
    fits = fit_orders(df, ["k"], "p", "y", ["x"], [(3, 0, 0)])
    fut = df.select("k", (F.col("p") + 120).alias("p"), "x", F.lit("s").alias("scenario"))
    with pytest.raises(Exception, match="more lags than history"):
        scenario_forecasts(df, fits, fut, ["k"], "p", "y", ["x"], history=2).collect()


def test_hold_out_keeps_series_without_test_rows(spark):
    from tidepanel.operators.aggregate import rmse_mae
    from tidepanel.operators.arx import with_accuracy
    best = spark.createDataFrame([("a", 1.0, "ok"), ("b", 1.0, "ok"), ("c", None, "too_short")],
                                 "k string, intercept double, status string")
    err = spark.createDataFrame([("a", 3.0), ("a", -4.0)], "k string, error double")
    got = {r.k: (r.n_forecasts, r.status) for r in with_accuracy(
        best, rmse_mae(err, ["k"]), ["k"], ["status"]).collect()}
    assert got == {"a": (2, "ok"), "b": (0, "no_forecast"), "c": (0, "too_short")}
