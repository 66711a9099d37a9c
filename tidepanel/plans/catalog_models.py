"""Queries for folds, splits and the native AR(1) models (build steps 5-6)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalars import step_dummy
from ..operators.aggregate import rmse_mae
from ..operators.folds import (expand_origins, fold_train_stats, min_history, order_grid,
                               standardize_by_fold, train_test_split)
from ..operators.forecast import Z95, ar1_fit, ar1_forecast, forecast_errors, rolling_backtest
from ..operators.scenario import apply_scenarios
from .catalog_features import FEATURES_SQL, features_df
from .registry import materialize, query, rounded
from .series import (NATION_SEGMENT_MONTH_SQL, SEGMENT_MONTH_SQL, month_index,
                     nation_segment_month, segment_month)

TRAIN_END = month_index(2000, 12)
TEST = [month_index(2001, m) for m in range(1, 8)]
ORIGINS = [month_index(2000, m) for m in (3, 6, 9, 12)]
ORIGINS_SQL = ", ".join(f"({t})" for t in ORIGINS)
W = "WINDOW w AS (PARTITION BY k ORDER BY p)"

# The candidate (p, d, q) orders of the first forecasting version.
ORDERS_V1 = [(1, 0, 0), (0, 0, 1), (1, 0, 1), (2, 0, 0), (0, 0, 2), (2, 0, 1), (1, 0, 2)]

REG_COLS = ["year", "industry", "unemployment_rate", "unemployment_rate_lag1", "event_1998",
            "event_1998_x_us_share", "event_1998_x_infra_age", "infra_invest_log",
            "us_export_share", "inflation_proxy", "boc_policy_rate_avg"]


INEXACT = ("infra_invest_log", "inflation_proxy")

# ------------------------------------------------------------------ step 5

@query("complete_cases", step=5, sql=f"""
WITH f AS ({FEATURES_SQL})
SELECT {", ".join(f"round({c}, 6) AS {c}" if c in INEXACT else c for c in REG_COLS)} FROM f
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in REG_COLS)}
""")
def q_complete_cases(spark, d):
    """F8: complete cases over the regression columns (null and NaN dropped)."""
    out = features_df(spark, d).select(*REG_COLS).dropna()
    return rounded(out, 6, **{c: None for c in REG_COLS if c not in INEXACT})


@query("train_test_split", step=5, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, CASE WHEN p <= {TRAIN_END} THEN 'train' ELSE 'test' END AS split
FROM sm WHERE p <= {TRAIN_END} OR p IN ({", ".join(map(str, TEST))})
""")
def q_train_test_split(spark, d):
    """train through 2000-12, test 2001-01..07, other periods dropped."""
    return train_test_split(segment_month(spark, d), "p", TRAIN_END, TEST).select("k", "p", "split")


@query("min_history", step=5, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL},
  s AS (SELECT k, p, y AS v, CASE WHEN p <= {TRAIN_END} THEN 'train' ELSE 'test' END AS split
        FROM sm WHERE p <= {TRAIN_END} OR p IN ({", ".join(map(str, TEST))})),
  ok AS (SELECT k FROM s GROUP BY k
         HAVING count(CASE WHEN split = 'train' THEN 1 END) >= 6
            AND count(CASE WHEN split = 'test' THEN 1 END) >= 1)
SELECT s.* FROM s WHERE k IN (SELECT k FROM ok)
""")
def q_min_history(spark, d):
    """keep series with >= 6 training and >= 1 test rows (semi join)."""
    sp = nation_segment_month(spark, d).withColumnRenamed("y", "v")
    sp = train_test_split(sp, "p", TRAIN_END, TEST)
    return min_history(sp, "k", 6, 1).select("k", "p", "v", "split")


@query("rolling_folds", step=5, sql=f"""
WITH {SEGMENT_MONTH_SQL},
  o AS (SELECT * FROM (VALUES {ORIGINS_SQL}) AS t(te)),
  usable AS (SELECT a.k, o.te FROM o JOIN sm a ON a.p = o.te
             JOIN sm b ON b.k = a.k AND b.p = o.te + 1)
SELECT u.k, u.te, count(*) AS n_train, round(avg(y), 6) AS mean_y, round(stddev_pop(y), 6) AS sd_y
FROM usable u JOIN sm ON sm.k = u.k AND sm.p <= u.te
GROUP BY u.k, u.te
""")
def q_rolling_folds(spark, d):
    """F11 + J7: per (series, origin) training count, mean, SD; origin usable
    only if te and te+1 exist.  Running sums, one window pass."""
    return rounded(fold_train_stats(segment_month(spark, d), "k", "p", "y", ORIGINS), 6)


@query("standardize_train_only", step=5, sql=f"""
WITH {SEGMENT_MONTH_SQL},
  o AS (SELECT * FROM (VALUES {ORIGINS_SQL}) AS t(te)),
  x AS (SELECT sm.k, o.te, sm.p, sm.x1 FROM sm JOIN o ON sm.p <= o.te + 1),
  st AS (SELECT k, te, avg(x1) AS m, stddev_pop(x1) AS s FROM x WHERE p <= te GROUP BY k, te)
SELECT x.k, x.te, x.p, round((x.x1 - st.m) / CASE WHEN st.s = 0 THEN 1 ELSE st.s END, 6) AS x1_z
FROM x JOIN st ON x.k = st.k AND x.te = st.te
""")
def q_standardize_train_only(spark, d):
    """Scale with the mean/SD of each fold's training rows only; the
    test row (te + 1) is scaled with the training statistics."""
    sm = segment_month(spark, d).withColumn("__p1", F.col("p") - 1)
    ex = expand_origins(sm, "__p1", ORIGINS).withColumn("is_train", F.col("p") <= F.col("te"))
    out = standardize_by_fold(ex, "k", "te", ["x1"])
    return rounded(out.select("k", "te", "p", "x1_z"), 6)


@query("order_grid", step=5, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, g.pos, g.ar, g.diff, g.ma
FROM (SELECT DISTINCT k FROM sm) JOIN (VALUES {", ".join(
    f"({i}, {p}, {dd}, {q})" for i, (p, dd, q) in enumerate(ORDERS_V1))}) AS g(pos, ar, diff, ma)
  ON TRUE
""")
def q_order_grid(spark, d):
    """Every series x candidate order, with grid position."""
    keys = segment_month(spark, d).select("k").distinct()
    return order_grid(keys, ORDERS_V1)


SCENARIOS = {
    "baseline": [],
    "high_event": [("ev_2000", "set", 1.0)],
    "high_x1": [("x1", "add", math.log1p(0.20))],
    "high_event_high_x1": [("ev_2000", "set", 1.0), ("x1", "add", math.log1p(0.20))],
}


@query("scenario_drivers", step=5, sql=f"""
WITH {SEGMENT_MONTH_SQL},
  t AS (SELECT k, p, CAST(CAST(p >= {month_index(2000, 1)} AS INTEGER) AS DOUBLE) AS ev_2000, x1
        FROM sm WHERE p IN ({", ".join(map(str, TEST))})),
  s AS (SELECT * FROM (VALUES ('baseline'), ('high_event'), ('high_x1'),
                              ('high_event_high_x1')) AS v(scenario))
SELECT k, p, scenario,
  CASE WHEN scenario IN ('high_event', 'high_event_high_x1') THEN 1.0 ELSE ev_2000 END AS ev_2000,
  round(CASE WHEN scenario IN ('high_x1', 'high_event_high_x1') THEN x1 + ln(1.2) ELSE x1 END, 6) AS x1
FROM t JOIN s ON TRUE
""")
def q_scenario_drivers(spark, d):
    """P23 + J8: test rows x scenarios with set/add edits.  The event dummy
    is already 1 in the test window, so 'high_event' equals the baseline."""
    t = segment_month(spark, d).filter(F.col("p").isin(TEST)).select(
        "k", "p", step_dummy("p", month_index(2000, 1)).cast("double").alias("ev_2000"), "x1")
    return rounded(apply_scenarios(t, SCENARIOS), 6)


# ------------------------------------------------------------------ step 6

_AR1_SQL = """regr_slope(y, ylag) AS phi, regr_intercept(y, ylag) AS c,
  CAST(regr_count(y, ylag) AS BIGINT) AS n_obs,
  (regr_syy(y, ylag) - regr_sxy(y, ylag) * regr_sxy(y, ylag) / nullif(regr_sxx(y, ylag), 0))
    / nullif(regr_count(y, ylag), 0) AS sigma2"""

_FIT_SQL = f"""fit AS (
  SELECT k, {_AR1_SQL}, max(p) AS last_period, arg_max(y, p) AS last_y
  FROM (SELECT k, p, y, lag(y) OVER w AS ylag FROM src {W}) GROUP BY k)"""


@query("ar1_fit", step=6, sql=f"""
WITH {SEGMENT_MONTH_SQL}, src AS (SELECT * FROM sm), {_FIT_SQL}
SELECT k, round(phi, 6) AS phi, round(c, 6) AS c, n_obs, round(sigma2, 6) AS sigma2,
       last_period, last_y FROM fit
""")
def q_ar1_fit(spark, d):
    """M9 (0,0,0)/(1,0,0) native: conditional least squares per series."""
    return rounded(ar1_fit(segment_month(spark, d), "k", "p", "y"), 6, last_y=None)


def _forecast_sql(h_max, src_filter="", horizon_filter=""):
    return f"""
WITH {SEGMENT_MONTH_SQL}, src AS (SELECT * FROM sm {src_filter}), {_FIT_SQL},
  hs AS (SELECT * FROM range(1, {h_max + 1}) AS t(h)),
  fc AS (SELECT k, h, last_period + h AS period,
           c * CASE WHEN phi = 1 THEN h ELSE (1 - pow(phi, h)) / (1 - phi) END
             + pow(phi, h) * last_y AS yhat,
           {Z95} * sqrt(sigma2 * CASE WHEN phi * phi = 1 THEN h
             ELSE (1 - pow(phi * phi, h)) / (1 - phi * phi) END) AS half
         FROM fit JOIN hs ON TRUE)"""


@query("ar1_forecast", step=6, sql=_forecast_sql(3) + """
SELECT k, CAST(h AS INTEGER) AS h, CAST(period AS INTEGER) AS period, round(yhat, 6) AS predicted,
       round(yhat - half, 6) AS ci_lower, round(yhat + half, 6) AS ci_upper FROM fc
""")
def q_ar1_forecast(spark, d):
    """3-step forecasts with 95 % intervals from the series end."""
    fit = ar1_fit(segment_month(spark, d), "k", "p", "y")
    return rounded(ar1_forecast(fit, 3, "k"), 6)


def _holdout(spark, d, series):
    tr = series.filter(F.col("p") <= TRAIN_END)
    fc = ar1_forecast(ar1_fit(tr, "k", "p", "y"), len(TEST), "k")
    actual = series.filter(F.col("p").isin(TEST)).select("k", F.col("p").alias("period"),
                                                         F.col("y").alias("actual"))
    return forecast_errors(fc, actual, "k")


_ERR_SQL = f"""
  errs AS (SELECT fc.k, CAST(fc.period AS INTEGER) AS period, a.y AS actual, fc.yhat AS predicted,
             a.y - fc.yhat AS error, abs(a.y - fc.yhat) AS abs_error
           FROM fc JOIN sm a ON a.k = fc.k AND a.p = fc.period
           WHERE a.p IN ({", ".join(map(str, TEST))}))"""


@query("forecast_errors", step=6, sql=_forecast_sql(len(TEST), f"WHERE p <= {TRAIN_END}")
       + "," + _ERR_SQL + """
SELECT k, period, actual, round(predicted, 6) AS predicted, round(error, 6) AS error,
       round(abs_error, 6) AS abs_error FROM errs
""")
def q_forecast_errors(spark, d):
    """P26 + J9: hold-out forecasts joined to actuals on (series, period)."""
    e = _holdout(spark, d, materialize(segment_month(spark, d)))
    return rounded(e.select("k", "period", "actual", "predicted", "error", "abs_error"), 6,
                   actual=None)


@query("forecast_accuracy", step=6, sql=_forecast_sql(len(TEST), f"WHERE p <= {TRAIN_END}")
       + "," + _ERR_SQL + """
SELECT k, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae,
       count(error) AS n_forecasts FROM errs GROUP BY k
""")
def q_forecast_accuracy(spark, d):
    """A10: RMSE and MAE per series."""
    return rounded(rmse_mae(_holdout(spark, d, materialize(segment_month(spark, d))), ["k"]), 6)


@query("holdout_accuracy", step=6, sql=(
    _forecast_sql(len(TEST), f"WHERE p <= {TRAIN_END} AND k IN (SELECT k FROM okk)")
    .replace(f"WITH {SEGMENT_MONTH_SQL},", f"""WITH {NATION_SEGMENT_MONTH_SQL},
  okk AS (SELECT k FROM sm GROUP BY k
          HAVING count(CASE WHEN p <= {TRAIN_END} THEN 1 END) >= 6
             AND count(CASE WHEN p IN ({", ".join(map(str, TEST))}) THEN 1 END) >= 1),""")
    + "," + _ERR_SQL + """
SELECT k, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae,
       count(error) AS n_forecasts FROM errs GROUP BY k
"""))
def q_holdout_accuracy(spark, d):
    """Split, history gate, fit on train, multi-step forecast of the
    test window, accuracy per series; 125 nation x segment series."""
    s = train_test_split(nation_segment_month(spark, d), "p", TRAIN_END, TEST)
    s = materialize(min_history(s, "k", 6, 1))
    return rounded(rmse_mae(_holdout(spark, d, s), ["k"]), 6)


@query("rolling_backtest", step=6, sql=f"""
WITH {SEGMENT_MONTH_SQL},
  o AS (SELECT * FROM (VALUES {ORIGINS_SQL}) AS t(te)),
  b AS (SELECT k, p, y, lag(y) OVER w AS ylag FROM sm {W}),
  fit AS (SELECT b.k, o.te, {_AR1_SQL.replace("y, ylag", "b.y, b.ylag")}, count(*) AS n_train,
            max(CASE WHEN b.p = o.te THEN b.y END) AS y_te
          FROM b JOIN o ON b.p <= o.te GROUP BY b.k, o.te),
  f2 AS (SELECT fit.*, a.y AS actual, c + phi * y_te AS pred, {Z95} * sqrt(sigma2) AS half
         FROM fit JOIN sm a ON a.k = fit.k AND a.p = fit.te + 1
         WHERE n_train >= 6 AND y_te IS NOT NULL)
SELECT k, te AS train_end, te + 1 AS test_period, n_train, round(phi, 6) AS phi, round(c, 6) AS c,
  actual, round(pred, 6) AS predicted, round(actual - pred, 6) AS error,
  round(abs(actual - pred), 6) AS abs_error, round(pred - half, 6) AS ci_lower,
  round(pred + half, 6) AS ci_upper
FROM f2
""")
def q_rolling_backtest(spark, d):
    """Rolling-origin one-step backtest, origins 2000-03/06/09/12."""
    out = rolling_backtest(segment_month(spark, d), "k", "p", "y", ORIGINS, min_train=6)
    return rounded(out, 6, actual=None)


@query("fold_status", step=5, sql=f"""
WITH {NATION_SEGMENT_MONTH_SQL},
  o AS (SELECT * FROM (VALUES {ORIGINS_SQL}) AS t(te)),
  a AS (SELECT sm.k, o.te, count(CASE WHEN sm.p <= o.te THEN 1 END) AS n_train,
          count(CASE WHEN sm.p = o.te THEN 1 END) AS has_te,
          count(CASE WHEN sm.p = o.te + 1 THEN 1 END) AS has_next
        FROM sm JOIN o ON TRUE GROUP BY sm.k, o.te)
SELECT k, te, n_train,
  CASE WHEN has_te = 0 OR has_next = 0 THEN 'missing_period'
       WHEN n_train < 6 THEN 'too_short' ELSE 'ok' END AS status
FROM a
""")
def q_fold_status(spark, d):
    """q10/F10/F11: why each (series, origin) fold would or would not run,
    over the 125 nation x segment series (sparse: months go missing)."""
    from ..operators.folds import fold_status
    return fold_status(nation_segment_month(spark, d), "k", "p", ORIGINS, 6)
