"""Queries for design, Gram matrix and fixed-effects regression (step 7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.absorb import fit_absorbed
from ..operators.design import cross_products, design_matrix
from ..operators.regression import (FE_ASSUMPTIONS, FE_PURPOSE, fit_ols, predict,
                                    regression_metadata, within_slope)
from ..operators.within import alternating_demean
from .catalog_features import (FEATURES_SQL, MONTH_CFG, MONTH_FEATURES_SQL, MONTH_SPEC,
                               features_df)
from .catalog_models import REG_COLS
from .registry import materialize, query, rounded
from .series import (CUSTOMER_MONTH_SQL, NATION_SEGMENT_MONTH_SQL, SEGMENT_MONTH_SQL,
                     customer_month, nation_segment_month, segment_month)
from .sql_ols import sweep_ctes
from .sql_parts import two_sided_p

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("design_matrix", step=7, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, p, y, 1 AS const, {", ".join(
    f"CAST(k = '{s}' AS INTEGER) AS k_{s.lower()}" for s in SEGMENTS[1:])}
FROM sm
""")
def q_design_matrix(spark, d):
    """P20: treatment coding, first level (sorted) dropped, plus intercept."""
    sm = segment_month(spark, d).select("k", "p", "y")
    out, names = design_matrix(sm, [], ["k"])
    return out.select("k", "p", "y", *names)


GRAM_COLS = ["const", "x1", "y", "n_orders", "n_f"]


def _gram_sql():
    terms = [f"printf('%.9e', sum({a} * {b}))::DOUBLE AS {a}__{b}"
             for i, a in enumerate(GRAM_COLS) for b in GRAM_COLS[i:]]
    return f"""
WITH {CUSTOMER_MONTH_SQL}
SELECT count(*) AS n, {", ".join(terms)} FROM (
  SELECT 1.0::DOUBLE AS const, x1, y, n_orders::DOUBLE AS n_orders, n_f::DOUBLE AS n_f FROM cm)
"""


@query("gram_matrix", step=7, sql=_gram_sql())
def q_gram_matrix(spark, d):
    """Normal-equation sums of the series' own values in one aggregate;
    only the sums are rounded, to ten significant digits."""
    cm = customer_month(spark, d).withColumn("const", F.lit(1.0))
    sums = cross_products(cm.select(*[F.col(c).cast("double").alias(c) for c in GRAM_COLS]),
                          GRAM_COLS)
    return sums.select("n", *[F.format_string("%.9e", F.col(c)).cast("double").alias(c)
                              for c in sums.columns if c != "n"])


@query("simple_ols", step=7, sql=f"""
WITH {SEGMENT_MONTH_SQL}
SELECT k, round(regr_slope(y, x1), 6) AS slope, round(regr_intercept(y, x1), 6) AS intercept,
       round(regr_r2(y, x1), 6) AS r2, CAST(regr_count(y, x1) AS BIGINT) AS n FROM sm GROUP BY k
""")
def q_simple_ols(spark, d):
    """M4 single-regressor form: slope, intercept, R^2 per series."""
    sm = segment_month(spark, d)
    return rounded(sm.groupBy("k").agg(
        F.regr_slope("y", "x1").alias("slope"), F.regr_intercept("y", "x1").alias("intercept"),
        F.regr_r2("y", "x1").alias("r2"), F.regr_count("y", "x1").alias("n")), 6)


SEG_DUMMIES = [f"k_{x.lower()}" for x in SEGMENTS[1:]]


def _absorbed(src, absorb, cols):
    """``src`` with every column of ``cols`` demeaned by ``absorb``."""
    return (f"SELECT * REPLACE ({', '.join(f'{c} - avg({c}) OVER w AS {c}' for c in cols)}), "
            f"count(*) OVER w AS n_abs FROM {src} WINDOW w AS (PARTITION BY {absorb})")


# the two-way transform on an unbalanced panel: by Frisch-Waugh-Lovell the
# residual after absorbing the months and regressing on segment dummies
_WITHIN_SQL = f"""
WITH {SEGMENT_MONTH_SQL},
  b AS (SELECT k, p, y, x1, {", ".join(f"CAST(k = '{x}' AS DOUBLE) AS {n}"
                                     for x, n in zip(SEGMENTS[1:], SEG_DUMMIES))} FROM sm),
  d AS ({_absorbed("b", "p", ["y", "x1", *SEG_DUMMIES])}),
  {sweep_ctes("o", "d", [], ["x1", *SEG_DUMMIES], "y")}"""


def _demeaned(spark, d):
    # the transform reads its input once per round: aggregate the series once
    sm = materialize(segment_month(spark, d).select("k", "p", "y", "x1"))
    return alternating_demean(sm, ["y", "x1"], "k", "p")[0]


@query("within_slope", step=7, sql=_WITHIN_SQL + """
SELECT round(s_0_5, 6) AS slope, CAST(n AS BIGINT) AS n FROM o_5
""")
def q_within_slope(spark, d):
    """W7 + M1 (one regressor, all months, unbalanced): two-way FE slope."""
    return rounded(within_slope(_demeaned(spark, d), "y", "x1"), 6)


@query("fe_residuals", step=7, sql=_WITHIN_SQL + f"""
SELECT k, p, round(y - s_0_5 * x1{"".join(f" - s_{i + 1}_5 * {c}"
                                         for i, c in enumerate(SEG_DUMMIES))}, 6) + 0.0 AS resid
FROM d, o_5
""")
def q_fe_residuals(spark, d):
    """P25: residuals of the two-way FE fit (slope broadcast as a literal)."""
    dm = _demeaned(spark, d)
    slope = within_slope(dm, "y", "x1").first()["slope"]
    return dm.select("k", "p", (F.round(F.col("y") - predict(["x1"], [slope]), 6) + F.lit(0.0))
                     .alias("resid"))


# ---------------------------------------------------------------- M1-M5

COEF_COLS = ["coefficient", "std_error", "t_stat", "p_value"]


def _hc_sql(pre, src, xs, y, absorb_levels, hc, names=None, unknown=None):
    """Coefficient table of OLS on ``src`` (columns demeaned by one factor
    with ``absorb_levels`` levels, group size n_abs), robust errors of type
    ``hc``, from the swept co-moments.  ``unknown``: SQL of the names of
    unidentified variables."""
    k = len(xs)
    names = names or {}
    inv = lambda i, j: f"(-s_{min(i, j)}_{max(i, j)})"
    e = f"{y}" + "".join(f" - s_{i}_{k} * {x}" for i, x in enumerate(xs))
    lev = "1.0 / n_abs + " + " + ".join(f"{inv(i, j)} * {a} * {b}" for i, a in enumerate(xs)
                                        for j, b in enumerate(xs))
    w = f"pow({e}, 2) / pow(1 - ({lev}), 2)" if hc == "HC3" else f"pow({e}, 2)"
    meat = ", ".join(f"sum(w * {xs[i]} * {xs[j]}) AS t_{i}_{j}" for i in range(k)
                     for j in range(i, k))
    t = lambda i, j: f"t_{min(i, j)}_{max(i, j)}"
    scale = f"n * 1.0 / (n - rank - {absorb_levels})" if hc == "HC1" else "1.0"
    var = [" + ".join(f"{inv(i, a)} * {t(a, b)} * {inv(b, i)}" for a in range(k)
                      for b in range(k)) for i in range(k)]
    rows = " UNION ALL ".join(
        f"SELECT '{names.get(x, x)}' AS variable, CASE WHEN s_{i}_{i} <> 0 THEN s_{i}_{k} END AS b, "
        f"CASE WHEN s_{i}_{i} <> 0 THEN sqrt({scale} * ({var[i]})) END AS se FROM mt"
        for i, x in enumerate(xs))
    more = f" UNION ALL SELECT variable, NULL, NULL FROM ({unknown})" if unknown else ""
    z = "(b / se)"
    return f"""{pre}
  wt AS (SELECT {", ".join(xs)}, {w} AS w FROM {src}, o_{k}),
  mt AS (SELECT * FROM (SELECT {meat} FROM wt), o_{k}),
  res AS ({rows}{more})
SELECT variable, round(b, 6) + 0.0 AS coefficient, round(se, 6) + 0.0 AS std_error,
  round({z}, 4) + 0.0 AS t_stat, round({two_sided_p(z)}, 5) + 0.0 AS p_value,
  b IS NOT NULL AS identified
FROM res"""


def _coefficients(spark, res, only=None):  # an OLSResult or an Absorbed fit
    """The table of a fit, rounded; a variable that the data do not identify
    has no value (the fit's own minimum-norm value is arbitrary)."""
    c = res.coefficients(spark)
    if only is not None:
        c = c.filter(F.col("variable").isin(list(only)))
    places = {"coefficient": 6, "std_error": 6, "t_stat": 4, "p_value": 5}
    return c.select("variable", *[
        F.when(F.col("identified"), F.round(n, places[n]) + F.lit(0.0)).alias(n)
        for n in COEF_COLS], "identified")


FE_Y = "unemployment_rate"
FE_X = ["unemployment_rate_lag1", "event_1998_x_us_share", "infra_invest_log",
        "inflation_proxy", "boc_policy_rate_avg"]
FE_FORMULA = f"{FE_Y} ~ {' + '.join(FE_X)} + C(industry) + C(year)"
# lag and industry vary within a year; the other drivers are series of the
# year alone, which the year effects contain
FE_OWN = ["unemployment_rate_lag1", "industry_building", "industry_machinery"]

_FE_PRE = f"""
WITH f AS ({FEATURES_SQL}),
  r AS (SELECT {", ".join(REG_COLS)} FROM f
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in REG_COLS)}),
  q AS (SELECT year, CAST({FE_Y} AS DOUBLE) AS {FE_Y}, unemployment_rate_lag1,
          CAST(industry = 'building' AS DOUBLE) AS industry_building,
          CAST(industry = 'machinery' AS DOUBLE) AS industry_machinery FROM r),
  d AS ({_absorbed("q", "year", [FE_Y, *FE_OWN])}),
  {sweep_ctes("o", "d", [], FE_OWN, FE_Y)}"""


def fe_fit(spark, d):
    # the fit reads its rows several times: write them once
    rows = materialize(features_df(spark, d).select(*REG_COLS).dropna())
    return fit_absorbed(rows, FE_Y, FE_X, "year", cov_type="HC3", factors=["industry"])


@query("fe_ols_coefficients", step=7, sql=_hc_sql(
    _FE_PRE + ",", "d", FE_OWN, FE_Y, "0", "HC3",
    unknown="SELECT unnest(['const', " + ", ".join(f"'{c}'" for c in FE_X[1:]) + "]) AS variable "
            "UNION ALL SELECT DISTINCT 'year_' || year FROM r WHERE year > (SELECT min(year) FROM r)"))
def q_fe_ols_coefficients(spark, d):
    """M1-M3: industry + year fixed effects OLS with HC3 errors; variables
    that the year effects contain come back as not identified."""
    return _coefficients(spark, fe_fit(spark, d))


_FE_METRICS_SQL = _FE_PRE + """,
  s AS (SELECT n, rank + (SELECT count(DISTINCT year) FROM q) AS rk, s_3_3 AS ssr,
          (SELECT covar_pop({y}, {y}) * count(*) FROM q) AS sst FROM o_3),
  l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM s)""".replace("{y}", FE_Y)


@query("fe_fit_metrics", step=7, sql=_FE_METRICS_SQL + f"""
SELECT round(1 - ssr / sst, 6) AS r_squared,
  round(1 - (n - 1.0) / (n - rk) * (ssr / sst), 6) AS adj_r_squared,
  round(-2 * ll + 2 * rk, 4) AS aic, round(-2 * ll + ln(n) * rk, 4) AS bic,
  CAST(n AS BIGINT) AS n_obs, CAST(rk AS INTEGER) AS rank, '{FE_FORMULA}' AS model_formula,
  'HC3' AS covariance_type FROM l
""")
def q_fe_fit_metrics(spark, d):
    """M4: R^2, adjusted R^2, AIC, BIC, n, rank."""
    return rounded(fe_fit(spark, d).result.metrics(spark, FE_FORMULA), 6, aic=4, bic=4)


@query("model_metadata", step=7, sql=_FE_METRICS_SQL + f"""
SELECT 'panel_fixed_effects' AS model_name, '{FE_Y}' AS dependent_variable,
  'industry and year' AS fixed_effects, 'HC3' AS robust_se, 'features' AS feature_table,
  CAST(n AS BIGINT) AS n_obs, CAST(rk AS INTEGER) AS rank,
  CAST({1 + len(FE_X)} + 2 + (SELECT count(DISTINCT year) FROM q) - 1 AS INTEGER) AS n_params,
  '{FE_FORMULA}' AS formula, '{FE_ASSUMPTIONS}' AS assumptions, '{FE_PURPOSE}' AS purpose FROM l
""")
def q_model_metadata(spark, d):
    """M5: one metadata row describing the fitted model."""
    fit = fe_fit(spark, d)
    return regression_metadata(spark, fit.result, FE_Y, FE_FORMULA,
                               n_params=fit.coefficients(spark).count())


def _rounds_sql(n_rounds):
    """Alternating projections as a recursive query over all rows."""
    return f"""
WITH RECURSIVE {NATION_SEGMENT_MONTH_SQL},
  it AS (SELECT 0 AS r, k, p, y, x1, CAST(n_f AS DOUBLE) AS n_f FROM sm
    UNION ALL
    SELECT r + 1, k, p, y - avg(y) OVER wp, x1 - avg(x1) OVER wp, n_f - avg(n_f) OVER wp FROM (
      SELECT r, k, p, y - avg(y) OVER wk AS y, x1 - avg(x1) OVER wk AS x1,
        n_f - avg(n_f) OVER wk AS n_f FROM it WHERE r < {n_rounds}
      WINDOW wk AS (PARTITION BY k)) WINDOW wp AS (PARTITION BY p)),
  d AS (SELECT k, p, y, x1, n_f, 1 AS n_abs FROM it WHERE r = {n_rounds}),
  {sweep_ctes("o", "d", [], ["x1", "n_f"], "y")},"""


@query("fe_within_coefficients", step=7, sql=_hc_sql(
    _rounds_sql(60), "d", ["x1", "n_f"], "y",
    "((SELECT count(DISTINCT k) + count(DISTINCT p) - 1 FROM sm))", "HC1"))
def q_fe_within_coefficients(spark, d):
    """M1 at scale: two-way FE (125 nation x segment series and
    their months) by alternating-projection demeaning; HC1 errors with the
    absorbed effects in the degrees of freedom.  Equal to the dummy
    regression by Frisch-Waugh-Lovell (tested)."""
    from ..operators.within import fe_within_ols
    s = materialize(nation_segment_month(spark, d).select("k", "p", "y", "x1", "n_f"))
    res, _ = fe_within_ols(s, "y", ["x1", "n_f"], "k", "p")
    return _coefficients(spark, res)


def _monthly_x():
    e1 = MONTH_SPEC.events[0][0]
    return ["unemployment_rate_lag1", f"{e1}_x_us_share", "infra_invest_log", "inflation_proxy",
            "boc_policy_rate_avg"]


@query("fe_within_features_monthly", step=7, sql=_hc_sql(f"""
WITH f AS ({MONTH_FEATURES_SQL}),
  r AS (SELECT industry, month, {FE_Y}, {", ".join(_monthly_x())} FROM f
        WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [FE_Y, *_monthly_x()])}),
  q AS (SELECT month, CAST({FE_Y} AS DOUBLE) AS {FE_Y}, unemployment_rate_lag1,
          CAST(industry = 'building' AS DOUBLE) AS industry_building,
          CAST(industry = 'machinery' AS DOUBLE) AS industry_machinery FROM r),
  d AS ({_absorbed("q", "month", [FE_Y, *FE_OWN])}),
  {sweep_ctes("o", "d", [], FE_OWN, FE_Y)},""", "d", FE_OWN, FE_Y,
    "(SELECT count(DISTINCT month) FROM q)", "HC1",
    unknown="SELECT unnest([" + ", ".join(f"'{c}'" for c in _monthly_x()[1:]) + "]) AS variable")
    + " WHERE variable NOT LIKE 'industry_%'")
def q_fe_within_features_monthly(spark, d):
    """M1-M3 on the monthly feature table: industry and month effects as
    factors, HC1 errors.  The regressors that vary by month only are contained
    in the month effects and come back as not identified."""
    xs = _monthly_x()
    rows = materialize(features_df(spark, d, MONTH_CFG, MONTH_SPEC)
                       .select("industry", "month", FE_Y, *xs).dropna())
    res = fit_ols(rows, FE_Y, ["const", *xs], cov_type="HC1", factors=["industry", "month"])
    return _coefficients(spark, res, only=xs)
