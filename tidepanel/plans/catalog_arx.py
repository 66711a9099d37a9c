"""Queries for the per-series autoregressions with drivers (build step 8)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import step_dummy
from ..operators.aggregate import rmse_mae
from ..operators.arx import (backtest, fit_orders, fit_params, scenario_forecasts, select_order,
                             with_accuracy)
from ..operators.folds import standardize_by_fold
from ..operators.forecast import Z95
from ..operators.scenario import apply_scenarios
from .catalog_models import ORIGINS, SCENARIOS, TEST, TRAIN_END
from .registry import materialize, query
from .series import (NATION_SEGMENT_MONTH_SQL, SEGMENT_MONTH_SQL, month_index,
                     nation_segment_month, segment_month)
from .sql_ols import arx_ctes, best_ctes, forecast_ctes, rounded_list

EXOG = ["ev_2000", "x1"]
E2000 = month_index(2000, 1)

# Lag orders, with and without differencing.
ORDERS_LAGS = [(1, 0, 0), (2, 0, 0), (0, 0, 0)]
ORDERS_DIFF = [(1, 1, 0), (2, 1, 0), (0, 1, 0)]
# The candidate grids of the forecasting designs.
ORDERS_ARMA = [(1, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 0), (0, 0, 2), (2, 0, 1), (1, 0, 2)]
ORDERS_ARIMA = [(1, 1, 0), (0, 1, 1), (1, 1, 1)]

FIT = ["loglik", "aic", "bic", "sigma2", "intercept"]
FIT_SQL = (f"ar, diff, ma, ord, status, n_obs, {rounded_list(FIT[:3], 4)}, "
           f"{rounded_list(FIT[3:])}, "
           "CASE WHEN ar > 0 THEN round(phi_1, 6) + 0.0 END AS phi_1")


COARSE = ("loglik", "aic", "bic")  # sums of logarithms over all rows: four places


def places(df, n: int = 6):
    """Doubles rounded, with one sign for zero."""
    return df.select(*[(F.round(f.name, 4 if f.name in COARSE else n) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def _with_event(df):
    return df.withColumn("ev_2000", step_dummy("p", E2000).cast("double"))


SME_SQL = f"""{SEGMENT_MONTH_SQL},
  sme AS (SELECT *, CAST(CAST(p >= {E2000} AS INTEGER) AS DOUBLE) AS ev_2000 FROM sm)"""


def _fits(fits, *more):
    return places(fits.select("k", "ar", "diff", "ma", "ord", "status", "n_obs", *FIT,
                              F.get("phi", F.lit(0)).alias("phi_1"), *more))


@query("arma_fit", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], [(1, 0, 0)])}
SELECT k, {FIT_SQL} FROM fits
""")
def q_arma_fit(spark, d):
    """One lag, intercept and one driver, per nation x segment."""
    return _fits(fit_orders(nation_segment_month(spark, d), ["k"], "p", "y", ["x1"], [(1, 0, 0)]))


@query("order_select", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], ORDERS_LAGS)},
  {best_ctes("fits", ["k"])}
SELECT k, {FIT_SQL}, pos FROM best
""")
def q_order_select(spark, d):
    """Lag orders 0-2 per series on common rows, best AIC (ties to
    grid order)."""
    s = nation_segment_month(spark, d)
    fits = fit_orders(s, ["k"], "p", "y", ["x1"], ORDERS_LAGS)
    return _fits(select_order(fits, ["k"]), "pos")


@query("order_select_differenced", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], ORDERS_DIFF)},
  {best_ctes("fits", ["k"])}
SELECT k, {FIT_SQL}, pos FROM best
""")
def q_order_select_differenced(spark, d):
    """M8: lag orders 0-2 on first differences, best AIC."""
    s = nation_segment_month(spark, d)
    fits = fit_orders(s, ["k"], "p", "y", ["x1"], ORDERS_DIFF)
    return _fits(select_order(fits, ["k"]), "pos")


THETA_SQL = ("CASE WHEN ma > 0 THEN round(theta_1, 6) + 0.0 END AS theta_1, "
             "CASE WHEN ma > 1 THEN round(theta_2, 6) + 0.0 END AS theta_2")


def _thetas():
    return [F.get("theta", F.lit(i)).alias(f"theta_{i + 1}") for i in range(2)]


@query("order_grid_fits", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], ORDERS_ARMA)}
SELECT k, {FIT_SQL}, {THETA_SQL} FROM fits
""")
def q_order_grid_fits(spark, d):
    """M6/M7: every order of the seven-order grid for every series, moving
    averages by the two regressions of Hannan and Rissanen."""
    return _fits(fit_orders(nation_segment_month(spark, d), ["k"], "p", "y", ["x1"], ORDERS_ARMA),
                 *_thetas())


@query("order_select_arma", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], ORDERS_ARMA)},
  {best_ctes("fits", ["k"])}
SELECT k, {FIT_SQL}, {THETA_SQL}, pos FROM best
""")
def q_order_select_arma(spark, d):
    """Best of the seven orders per series by AIC on common rows."""
    fits = fit_orders(nation_segment_month(spark, d), ["k"], "p", "y", ["x1"], ORDERS_ARMA)
    return _fits(select_order(fits, ["k"]), *_thetas(), "pos")


@query("order_select_arima", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL}, {arx_ctes("sm", ["k"], "p", "y", ["x1"], ORDERS_ARIMA)},
  {best_ctes("fits", ["k"])}
SELECT k, {FIT_SQL}, {THETA_SQL}, pos FROM best
""")
def q_order_select_arima(spark, d):
    """Best of the three orders on first differences."""
    fits = fit_orders(nation_segment_month(spark, d), ["k"], "p", "y", ["x1"], ORDERS_ARIMA)
    return _fits(select_order(fits, ["k"]), *_thetas(), "pos")


@query("arma000_fit", step=8, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL},
  m AS (SELECT k, CAST(regr_count(y, x1) AS INTEGER) AS n_obs, regr_syy(y, x1) AS syy,
          regr_sxx(y, x1) AS sxx, regr_sxy(y, x1) AS sxy, avg(y) FILTER (x1 IS NOT NULL) AS my,
          avg(x1) FILTER (y IS NOT NULL) AS mx FROM sm GROUP BY k),
  f AS (SELECT k, n_obs, syy, sxx > 0 AS moves, n_obs >= 3 + CAST(moves AS INTEGER) AS fit,
          CASE WHEN moves THEN sxy / sxx ELSE 0 END AS b,
          CASE WHEN fit THEN my - b * mx END AS intercept,
          CASE WHEN fit THEN greatest(syy - b * sxy, 0) / n_obs END AS sigma2 FROM m),
  l AS (SELECT *, 2 + CAST(moves AS INTEGER) AS par,
          CASE WHEN NOT fit OR fit IS NULL THEN 'too_short'
               WHEN sigma2 * n_obs <= 1e-12 * syy THEN 'perfect_fit' ELSE 'ok' END AS status,
          CASE WHEN status = 'ok' THEN -0.5 * n_obs * (ln(2 * pi()) + ln(sigma2) + 1) END AS loglik
        FROM f)
SELECT k, status, n_obs, round(intercept, 4) + 0.0 AS intercept, round(sigma2, 5) + 0.0 AS sigma2,
  round(loglik, 3) + 0.0 AS loglik, round(-2 * loglik + 2 * par, 3) + 0.0 AS aic,
  round(-2 * loglik + ln(n_obs) * par, 3) + 0.0 AS bic
FROM l
""")
def q_arma000_fit(spark, d):
    """M6/M9 without lags: per series the regression on one driver, against
    SQL's regr_* aggregates; every series has a row with its status."""
    fits = fit_orders(nation_segment_month(spark, d), ["k"], "p", "y", ["x1"], [(0, 0, 0)])
    return fits.select("k", "status", "n_obs", *[(F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (
        ("intercept", 4), ("sigma2", 5), ("loglik", 3), ("aic", 3), ("bic", 3))])


TEST_SQL = ", ".join(map(str, TEST))
_EDITS = f"""CROSS JOIN (VALUES ('baseline', NULL, 0), ('high_event', 1.0, 0),
    ('high_x1', NULL, {math.log1p(0.20)!r}), ('high_event_high_x1', 1.0, {math.log1p(0.20)!r}))
    AS v(scenario, ev, dx)"""


@query("scenario_forecast", step=8, sql=f"""
WITH RECURSIVE {SME_SQL}, train AS (SELECT * FROM sme WHERE p <= {TRAIN_END}),
  fut AS (SELECT k, p, scenario, coalesce(ev, ev_2000) AS ev_2000, x1 + dx AS x1
          FROM sme {_EDITS} WHERE p IN ({TEST_SQL})),
  {arx_ctes("train", ["k"], "p", "y", EXOG, [(1, 0, 0)])},
  {forecast_ctes("train", "fits", "fut", ["k"], "p", "y", EXOG, Z95)}
SELECT k, scenario, p, status, {rounded_list(["predicted", "ci_lower", "ci_upper"])} FROM fc
""")
def q_scenario_forecast(spark, d):
    """M14 + J8 + P23: fit on the training months, forecast the test months
    under four driver scenarios."""
    s = _with_event(segment_month(spark, d))
    train = s.filter(F.col("p") <= TRAIN_END)
    future = apply_scenarios(s.filter(F.col("p").isin(TEST)).select("k", "p", *EXOG), SCENARIOS)
    fits = fit_orders(train, ["k"], "p", "y", EXOG, [(1, 0, 0)])
    return places(scenario_forecasts(train, fits, future, ["k"], "p", "y", EXOG))


@query("scenario_forecast_arma", step=8, sql=f"""
WITH RECURSIVE {SME_SQL}, train AS (SELECT * FROM sme WHERE p <= {TRAIN_END}),
  fut AS (SELECT k, p, scenario, coalesce(ev, ev_2000) AS ev_2000, x1 + dx AS x1
          FROM sme {_EDITS} WHERE p IN ({TEST_SQL})),
  {arx_ctes("train", ["k"], "p", "y", EXOG, ORDERS_ARMA)},
  one AS (SELECT * FROM fits WHERE ord = '(1, 0, 2)'),
  {forecast_ctes("train", "one", "fut", ["k"], "p", "y", EXOG, Z95)}
SELECT k, scenario, p, status, {rounded_list(["predicted", "ci_lower", "ci_upper"])} FROM fc
""")
def q_scenario_forecast_arma(spark, d):
    """M14 with M6: an order with one lag and two moving-average terms, fitted
    on the training months, forecasts the test months under four scenarios."""
    s = _with_event(segment_month(spark, d))
    train = s.filter(F.col("p") <= TRAIN_END)
    future = apply_scenarios(s.filter(F.col("p").isin(TEST)).select("k", "p", *EXOG), SCENARIOS)
    fits = fit_orders(train, ["k"], "p", "y", EXOG, ORDERS_ARMA).filter("ord = '(1, 0, 2)'")
    return places(scenario_forecasts(train, fits, future, ["k"], "p", "y", EXOG))


def _scaled(cols, by, flag, src):
    return f"""SELECT * REPLACE ({", ".join(
        f"({c} - avg(CASE WHEN {flag} THEN {c} END) OVER w) / CASE WHEN "
        f"stddev_pop(CASE WHEN {flag} THEN {c} END) OVER w = 0 THEN 1 ELSE "
        f"stddev_pop(CASE WHEN {flag} THEN {c} END) OVER w END AS {c}" for c in cols)})
    FROM {src} WINDOW w AS (PARTITION BY {by})"""


# large values (a variance in squared money) to the hundred, others to six places
PARAM_SQL = ("CASE WHEN abs(param_value) >= 1e6 THEN round(param_value, -2) "
             "ELSE round(param_value, 6) END + 0.0")


def _params(df):
    v = F.col("param_value")
    shown = F.when(F.abs(v) >= 1e6, F.round(v, -2)).otherwise(F.round(v, 6)) + F.lit(0.0)
    return places(df.withColumn("param_value", shown))


def _params_sql(exog, key, train_end):
    rows = [("intercept", "intercept"), *[(c, f"beta_{c}") for c in exog], ("ar.L1", "phi_1"),
            ("sigma2", "sigma2")]
    parts = " UNION ALL ".join(
        f"SELECT {key}, ord, status, '{n}' AS param_name, {c} AS param_value, aic, bic FROM fits "
        "WHERE fit" for n, c in rows)
    return f"""SELECT {key}, {train_end} AS train_end, ord, status, param_name,
  {PARAM_SQL} AS param_value, {rounded_list(["aic", "bic"], 4)}, '{",".join(exog)}' AS exog_cols,
  TRUE AS standardized_exog
FROM ({parts} UNION ALL SELECT {key}, ord, status, NULL, NULL, aic, bic FROM fits WHERE NOT fit)"""


@query("model_params", step=8, sql=f"""
WITH {SME_SQL}, train AS ({_scaled(EXOG, "k", "TRUE", f"(SELECT * FROM sme WHERE p <= {TRAIN_END})")}),
  {arx_ctes("train", ["k"], "p", "y", EXOG, [(1, 0, 0)])}
{_params_sql(EXOG, "k", TRAIN_END)}
""")
def q_model_params(spark, d):
    """Long-form parameters of the final model, drivers standardised
    with training-row statistics."""
    s = _with_event(segment_month(spark, d)).filter(F.col("p") <= TRAIN_END)
    s = standardize_by_fold(s.withColumn("fold", F.lit(TRAIN_END))
                             .withColumn("is_train", F.lit(True)), "k", "fold", EXOG, suffix="")
    fits = fit_orders(s, ["k"], "p", "y", EXOG, [(1, 0, 0)])
    return _params(fit_params(fits, ["k"], EXOG, TRAIN_END, standardized=True))


def backtest_sql(src, key, period, y, exog, origins, min_train):
    """The one-step backtest of order (1,0,0) over the CTE ``src``."""
    o = ", ".join(f"({t})" for t in origins)
    k = 1 + len(exog)
    mean = " + ".join(["g.intercept", "g.phi_1 * x.lag1"] + [f"g.beta_{c} * x.{c}" for c in exog])
    xs = ["lag1", *exog]
    icpt = " - ".join([f"m_{k}"] + [f"s_{i}_{k} * m_{i}" for i in range(k)])
    from .sql_ols import sweep_ctes
    return f"""
  lagged AS (SELECT {key}, {period}, {y}, {", ".join(exog)},
      lag({y}) OVER (PARTITION BY {key} ORDER BY {period}) AS lag1 FROM {src}),
  folds0 AS (SELECT l.*, te FROM lagged l JOIN (VALUES {o}) AS t(te) ON l.{period} <= te + 1),
  folds AS ({_scaled(exog, f"{key}, te", f"{period} <= te", "folds0")}),
  tr AS (SELECT * FROM folds WHERE {period} <= te),
  {sweep_ctes("o", "tr", [key, "te"], xs, y)},
  g0 AS (SELECT {key}, te, n AS n_obs, rank, n >= rank + 3 AS fit, CASE WHEN n < rank + 3
      THEN 'too_short' WHEN greatest(s_{k}_{k}, 0) <= 1e-12 * d_{k} THEN 'perfect_fit'
      ELSE 'ok' END AS status, greatest(s_{k}_{k}, 0) / n AS sigma2, {icpt} AS intercept,
      s_0_{k} AS phi_1, {", ".join(f"s_{i + 1}_{k} AS beta_{c}" for i, c in enumerate(exog))}
      FROM o_{k}),
  g AS (SELECT *, CASE WHEN status = 'ok' THEN -0.5 * n_obs * (ln(2 * pi()) + ln(sigma2) + 1) END
      AS ll FROM g0),
  facts AS (SELECT {key}, te, count(CASE WHEN {period} <= te THEN 1 END) AS n_train,
      bool_or({period} = te) AND bool_or({period} = te + 1) AS here,
      max(CASE WHEN {period} = te + 1 THEN {y} END) AS actual FROM folds GROUP BY ALL),
  res AS (SELECT f.{key}, f.te AS train_end, f.te + 1 AS test_period, '(1, 0, 0)' AS ord,
      f.here AND f.n_train >= {min_train} AND coalesce(g.fit, FALSE) AS okay,
      CASE WHEN NOT f.here THEN 'missing_period' WHEN NOT okay THEN 'too_short'
        WHEN {mean} IS NULL THEN 'missing_driver' ELSE g.status END AS status, f.actual,
      CASE WHEN okay THEN {mean} END AS predicted, {Z95!r} * sqrt(g.sigma2) AS half,
      CASE WHEN okay THEN -2 * ll + 2 * (rank + 2) END AS aic,
      CASE WHEN okay THEN -2 * ll + ln(n_obs) * (rank + 2) END AS bic
    FROM facts f LEFT JOIN g ON f.{key} = g.{key} AND f.te = g.te
    LEFT JOIN folds x ON x.{key} = f.{key} AND x.te = f.te AND x.{period} = f.te + 1)
SELECT {key}, train_end, test_period, ord, status, round(actual, 6) + 0.0 AS actual,
  round(predicted, 6) + 0.0 AS predicted, round(actual - predicted, 6) + 0.0 AS error,
  round(abs(actual - predicted), 6) + 0.0 AS abs_error,
  round(predicted - half, 6) + 0.0 AS ci_lower, round(predicted + half, 6) + 0.0 AS ci_upper,
  {rounded_list(["aic", "bic"], 4)} FROM res"""


@query("arimax_backtest", step=8, sql=f"""
WITH {SME_SQL}, {backtest_sql("sme", "k", "p", "y", EXOG, ORIGINS, 0)}
""")
def q_arimax_backtest(spark, d):
    """M13 with M6: per (series, origin) standardise drivers on the training
    rows, fit one lag and drivers, forecast one step."""
    return places(backtest(_with_event(segment_month(spark, d)), ["k"], "p", "y", EXOG, ORIGINS))


def _errors_sql(key, y, period, extra="ord, aic"):
    return f"""
  errs AS (SELECT fc.{key}, a.{y} - fc.predicted AS e FROM fc
           JOIN test a ON a.{key} = fc.{key} AND a.{period} = fc.{period}),
  acc AS (SELECT {key}, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, count(e) AS n_forecasts
          FROM errs GROUP BY {key})
SELECT best.{key}, {rounded_list(["rmse", "mae"])}, coalesce(n_forecasts, 0) AS n_forecasts, ord,
  CASE WHEN intercept IS NOT NULL AND coalesce(n_forecasts, 0) = 0 THEN 'no_forecast'
       ELSE status END AS status,
  {rounded_list([c for c in extra.split(", ") if c != "ord"], 4)}
FROM best LEFT JOIN acc ON acc.{key} = best.{key}"""


@query("arimax_holdout", step=8, sql=f"""
WITH RECURSIVE {SME_SQL}, train AS (SELECT * FROM sme WHERE p <= {TRAIN_END}),
  test AS (SELECT *, 'actual' AS scenario FROM sme WHERE p IN ({TEST_SQL})),
  {arx_ctes("train", ["k"], "p", "y", EXOG, ORDERS_LAGS)}, {best_ctes("fits", ["k"])},
  {forecast_ctes("train", "best", "test", ["k"], "p", "y", EXOG, Z95)}, {_errors_sql("k", "y", "p")}
""")
def q_arimax_holdout(spark, d):
    """M12 with M6/M7: choose the lag order on the training months by AIC,
    forecast the test months with known drivers, score RMSE / MAE."""
    s = _with_event(segment_month(spark, d))
    train = s.filter(F.col("p") <= TRAIN_END)
    best = select_order(fit_orders(train, ["k"], "p", "y", EXOG, ORDERS_LAGS), ["k"])
    test = s.filter(F.col("p").isin(TEST)).select("k", "p", *EXOG, F.lit("actual").alias("scenario"))
    fc = scenario_forecasts(train, best, test, ["k"], "p", "y", EXOG).drop("status")
    actual = s.filter(F.col("p").isin(TEST)).select("k", "p", F.col("y").alias("actual"))
    err = fc.join(actual, ["k", "p"]).withColumn("error", F.col("actual") - F.col("predicted"))
    return places(with_accuracy(best, rmse_mae(err, ["k"]), ["k"], ["ord", "status", "aic"]))


# ---------------------------------------------------------------- the full recipe

def _v3_spec():
    from .catalog_features import MONTH_SPEC
    from .models import ForecastSpec
    e1 = MONTH_SPEC.events[0][0]
    return ForecastSpec(
        key="industry", period="month", drivers=(e1, "us_export_share", "infra_invest_log",
                                                 "boc_policy_rate_avg"),
        pulse_name="pulse", pulse_periods=tuple(range(month_index(1999, 1), month_index(2000, 12) + 1)),
        order=(1, 0, 0), origins=tuple(ORIGINS), min_total=8, min_train=6,
        train_end=TRAIN_END, test_periods=tuple(TEST),
        scenarios={"baseline": [],
                   "high_tariffs": [(e1, "set", 1.0)],
                   "high_infrastructure": [("infra_invest_log", "add", math.log1p(0.20))],
                   "high_tariffs_high_infrastructure": [(e1, "set", 1.0),
                                                        ("infra_invest_log", "add", math.log1p(0.20))]})


def _v3_rows(spark, d):
    from .catalog_features import MONTH_CFG, MONTH_SPEC, features_df
    from .models import prepared
    return materialize(prepared(features_df(spark, d, MONTH_CFG, MONTH_SPEC), _v3_spec()))


def _raw_drivers_sql():
    from .catalog_features import MONTH_FEATURES_SQL
    spec = _v3_spec()
    lo, hi = spec.pulse_periods[0], spec.pulse_periods[-1]
    cols = {c: f"CAST({c} AS DOUBLE)" for c in spec.drivers}
    cols[spec.pulse_name] = f"CAST(CAST(month BETWEEN {lo} AND {hi} AS INTEGER) AS DOUBLE)"
    return MONTH_FEATURES_SQL, cols


def _recipe_missing_sql():
    f, cols = _raw_drivers_sql()
    parts = [f"SELECT '{c}' AS col, count(CASE WHEN x IS NULL OR isnan(x) THEN 1 END) AS n_nan, "
             f"count(CASE WHEN isinf(x) THEN 1 END) AS n_inf FROM (SELECT {e} AS x FROM f)"
             for c, e in cols.items()]
    return f"WITH f AS ({f})\n" + "\nUNION ALL\n".join(parts)


@query("forecast_recipe_missing", step=8, sql=_recipe_missing_sql())
def q_forecast_recipe_missing(spark, d):
    """Missing / infinite counts of the recipe's raw drivers (before cleaning)."""
    from .catalog_features import MONTH_CFG, MONTH_SPEC, features_df
    from .models import driver_report
    return driver_report(features_df(spark, d, MONTH_CFG, MONTH_SPEC), _v3_spec())


def _recipe_rows_sql():
    """CTEs ending in ``rows``: the recipe's cleaned model rows."""
    f, cols = _raw_drivers_sql()
    spec = _v3_spec()
    fin = ", ".join(f"CASE WHEN isfinite({e}) THEN {e} END AS {c}" for c, e in cols.items())
    w = "PARTITION BY industry ORDER BY month ROWS BETWEEN"
    fill = ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in cols)
    med = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in cols)
    return f"""f AS ({f}),
  fin AS (SELECT industry, month, CAST({spec.y} AS DOUBLE) AS {spec.y}, {fin} FROM f),
  fil AS (SELECT industry, month, {spec.y}, {fill} FROM fin),
  rows AS (SELECT industry, month, {spec.y}, {med} FROM fil
           QUALIFY count(*) OVER (PARTITION BY industry) >= {spec.min_total})"""


def _recipe(tail):
    return f"WITH RECURSIVE {_recipe_rows_sql()}, {tail}"


_S = _v3_spec()


@query("forecast_recipe_backtest", step=8, sql=_recipe(backtest_sql(
    "rows", _S.key, _S.period, _S.y, _S.exog, _S.origins, _S.min_train)))
def q_forecast_recipe_backtest(spark, d):
    """The recommended recipe on the monthly feature table: clean drivers,
    history gates, rolling origins, train-only standardising, one lag with
    drivers, one-step forecasts and errors per (industry, origin)."""
    from .models import recipe_backtest
    return places(recipe_backtest(_v3_rows(spark, d), _v3_spec()))


def _recipe_scenarios_sql():
    e1 = _S.drivers[0]
    up = repr(math.log1p(0.20))
    both = _scaled(_S.exog, _S.key, "is_train", "both0")
    cols = ", ".join(_S.exog)
    edit = (f"SELECT {_S.key}, {_S.period}, scenario, coalesce(ev, {e1}) AS {e1}, us_export_share, "
            f"infra_invest_log + dx AS infra_invest_log, boc_policy_rate_avg, {_S.pulse_name}")
    return _recipe(f"""
  fut0 AS ({edit} FROM rows CROSS JOIN (VALUES ('baseline', NULL, 0), ('high_tariffs', 1.0, 0),
      ('high_infrastructure', NULL, {up}), ('high_tariffs_high_infrastructure', 1.0, {up}))
      AS v(scenario, ev, dx) WHERE {_S.period} IN ({TEST_SQL})),
  both0 AS (SELECT {_S.key}, {_S.period}, {_S.y}, NULL AS scenario, TRUE AS is_train, {cols}
            FROM rows WHERE {_S.period} <= {_S.train_end}
            UNION ALL BY NAME SELECT {_S.key}, {_S.period}, scenario, FALSE AS is_train, {cols}
            FROM fut0),
  both1 AS ({both}),
  train AS (SELECT * FROM both1 WHERE is_train), fut AS (SELECT * FROM both1 WHERE NOT is_train),
  {arx_ctes("train", [_S.key], _S.period, _S.y, _S.exog, [_S.order])},
  {forecast_ctes("train", "fits", "fut", [_S.key], _S.period, _S.y, _S.exog, Z95)}
SELECT {_S.key}, scenario, {_S.period}, status,
  {rounded_list(["predicted", "ci_lower", "ci_upper"])} FROM fc""")


@query("forecast_recipe_scenarios", step=8, sql=_recipe_scenarios_sql())
def q_forecast_recipe_scenarios(spark, d):
    """The recipe's refit on the training window and the four driver
    scenarios over the test window (tariff step already on, so
    'high_tariffs' equals the baseline)."""
    from .models import scenarios
    return places(scenarios(_v3_rows(spark, d), _v3_spec()))


@query("forecast_recipe_params", step=8, sql=_recipe(f"""
  train AS ({_scaled(_S.exog, _S.key, "TRUE", f"(SELECT * FROM rows WHERE {_S.period} <= {_S.train_end})")}),
  {arx_ctes("train", [_S.key], _S.period, _S.y, _S.exog, [_S.order])}
{_params_sql(_S.exog, _S.key, _S.train_end)}"""))
def q_forecast_recipe_params(spark, d):
    """The recipe's final model parameters, long form, standardised drivers."""
    from .models import final_params
    return _params(final_params(_v3_rows(spark, d), _v3_spec()))


def _recipe_holdout_sql(orders):
    return _recipe(f"""
  train AS (SELECT * FROM rows WHERE {_S.period} <= {_S.train_end}),
  test AS (SELECT *, 'test' AS scenario FROM rows WHERE {_S.period} IN ({TEST_SQL})),
  {arx_ctes("train", [_S.key], _S.period, _S.y, _S.exog, orders)}, {best_ctes("fits", [_S.key])},
  {forecast_ctes("train", "best", "test", [_S.key], _S.period, _S.y, _S.exog, Z95)},
  {_errors_sql(_S.key, _S.y, _S.period, "ord, aic, bic")}""")


@query("forecast_holdout_grid", step=8, sql=_recipe_holdout_sql(ORDERS_LAGS))
def q_forecast_holdout_grid(spark, d):
    """First design on the monthly feature table: candidate lag orders (no
    differencing), best AIC per industry on the training window, RMSE and
    MAE over the test months."""
    from .models import holdout
    return places(holdout(_v3_rows(spark, d), _v3_spec(), ORDERS_LAGS))


@query("forecast_holdout_differenced", step=8, sql=_recipe_holdout_sql(ORDERS_DIFF))
def q_forecast_holdout_differenced(spark, d):
    """Second design: candidate lag orders on first differences."""
    from .models import holdout
    return places(holdout(_v3_rows(spark, d), _v3_spec(), ORDERS_DIFF))


@query("forecast_holdout_arma", step=8, sql=_recipe_holdout_sql(ORDERS_ARMA))
def q_forecast_holdout_arma(spark, d):
    """First design with its whole grid: seven orders with moving averages."""
    from .models import holdout
    return places(holdout(_v3_rows(spark, d), _v3_spec(), ORDERS_ARMA))


@query("forecast_holdout_arima", step=8, sql=_recipe_holdout_sql(ORDERS_ARIMA))
def q_forecast_holdout_arima(spark, d):
    """Second design with its whole grid: three orders on first differences."""
    from .models import holdout
    return places(holdout(_v3_rows(spark, d), _v3_spec(), ORDERS_ARIMA))
