"""Native AR(1) models (M9-M13, A10, P26, J9): fit, forecast, interval,
hold-out and rolling-origin evaluation as grouped aggregates.

The AR(1) with intercept, ``y_t = c + phi * y_{t-1} + e_t``, is fitted by
conditional least squares with ``regr_*`` aggregates, so a fit is a
partial + final aggregate per group whatever the series length, and
thousands of series fit in one job.  ``sigma2`` is SSR / n with
SSR = Syy - Sxy^2 / Sxx.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import with_next
from .windows import lag, spec

Z95 = 1.959963984540054  # two-sided 95 % normal quantile


def ar1_aggs(y: str, ylag: str, over=None) -> list[Column]:
    """Slope, intercept, count and residual variance, as aggregates or (with
    ``over``) as window functions."""
    Y, X = F.col(y), F.col(ylag)
    of = (lambda c: c) if over is None else (lambda c: c.over(over))
    sxx, syy, sxy = of(F.regr_sxx(Y, X)), of(F.regr_syy(Y, X)), of(F.regr_sxy(Y, X))
    n = of(F.regr_count(Y, X))
    return [
        of(F.regr_slope(Y, X)).alias("phi"),
        of(F.regr_intercept(Y, X)).alias("c"),
        n.alias("n_obs"),
        F.try_divide(syy - F.try_divide(sxy * sxy, sxx), n.cast("double")).alias("sigma2"),
    ]


def ar1_fit(df: DataFrame, key, period: str, y: str) -> DataFrame:
    """Per key: phi, c, n_obs, sigma2, and the last period and value (the
    forecast origin)."""
    keys = [key] if isinstance(key, str) else list(key)
    lagged = df.withColumn("__ylag", lag(y, keys, period))
    return lagged.groupBy(*keys).agg(
        *ar1_aggs(y, "__ylag"),
        F.max(period).alias("last_period"),
        F.max_by(F.col(y), F.col(period)).alias("last_y"),
    )


def psi_sum(phi: Column, h: Column, power: int) -> Column:
    """sum_{j<h} phi^(power*j): h when phi^power == 1, else closed form."""
    r = F.pow(phi, F.lit(float(power)))
    return F.when(r == 1.0, h.cast("double")).otherwise((1 - F.pow(r, h)) / (1 - r))


def ar1_forecast(fit: DataFrame, horizons: int, key, z: float = Z95) -> DataFrame:
    """h-step forecasts 1..horizons from each key's last value:
    yhat_h = c * sum_{j<h} phi^j + phi^h * y_T, interval
    yhat_h +/- z * sigma * sqrt(sum_{j<h} phi^(2j))."""
    keys = [key] if isinstance(key, str) else list(key)
    out = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    phi, h = F.col("phi"), F.col("h")
    yhat = F.col("c") * psi_sum(phi, h, 1) + F.pow(phi, h) * F.col("last_y")
    half = z * F.sqrt(F.col("sigma2") * psi_sum(phi, h, 2))
    return out.select(*keys, "h", (F.col("last_period") + h).alias("period"),
                      yhat.alias("predicted"), (yhat - half).alias("ci_lower"),
                      (yhat + half).alias("ci_upper"))


def forecast_errors(forecasts: DataFrame, actuals: DataFrame, key, period: str = "period",
                    actual: str = "actual") -> DataFrame:
    """Forecasts joined to actuals on (key, period), never by position (J9),
    with error and absolute error (P26)."""
    keys = [key] if isinstance(key, str) else list(key)
    out = forecasts.join(actuals.select(*keys, period, actual), on=keys + [period])
    err = F.col(actual) - F.col("predicted")
    return out.withColumn("error", err).withColumn("abs_error", F.abs(err))


def rolling_backtest(df: DataFrame, key, period: str, y: str, origins: Sequence[int],
                     min_train: int = 6, z: float = Z95) -> DataFrame:
    """Rolling-origin one-step backtest (M13): for each key and origin te,
    fit on rows with period <= te, forecast te + 1 and compare.

    No row is copied per origin: the fit at an origin is the running aggregate
    of the series up to it, read at the origin's own row, so two hundred
    origins cost what four cost.  A fold runs only when te and te + 1 both
    exist (F11) and the training window has ``min_train`` rows (F10)."""
    keys = [key] if isinstance(key, str) else list(key)
    base = with_next(df.withColumn("__ylag", lag(y, keys, period)), keys, period, [y])
    run = spec(keys, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = base.select(*keys, period, f"{period}_next", F.col(f"{y}_next").alias("actual"),
                     F.col(y).alias("y_te"), F.count(F.lit(1)).over(run).alias("n_train"),
                     *ar1_aggs(y, "__ylag", run))
    fit = at.filter(F.col(period).isin([int(t) for t in origins])
                    & (F.col(f"{period}_next") == F.col(period) + 1)
                    & F.col("actual").isNotNull() & (F.col("n_train") >= min_train))
    pred = F.col("c") + F.col("phi") * F.col("y_te")
    half = z * F.sqrt(F.col("sigma2"))
    err = F.col("actual") - pred
    te = F.col(period)
    return fit.select(*keys, te.alias("train_end"),
                      (te + 1).alias("test_period"), "n_train", "phi", "c",
                      F.col("actual"), pred.alias("predicted"), err.alias("error"),
                      F.abs(err).alias("abs_error"), (pred - half).alias("ci_lower"),
                      (pred + half).alias("ci_upper"))
