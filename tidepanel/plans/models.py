"""The recommended forecasting recipe as one composition (M6, M10-M16 with
P14, P22-P24, W5, A7, F9-F12, J7-J8).

Per entity of a feature table: add a pulse dummy, clean the drivers
(inf -> null, forward/back fill per entity, global median), check that
they are finite, keep entities with enough history, then

* backtest: for each rolling origin te with te and te + 1 present and at
  least ``min_train`` training rows, standardise the drivers with the
  training rows' statistics, fit an autoregression with drivers and forecast
  te + 1;
* scenarios: fit once on the training window and forecast the test window
  under each driver scenario.

Every step is a DataFrame operation; the fits come from grouped moments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite_or_null, pulse_dummy
from ..operators.arx import (backtest, fit_orders, fit_params, scenario_forecasts, select_order,
                             with_accuracy)
from ..operators.clean import clean_drivers, flag_non_finite, missing_report
from ..operators.folds import standardize_by_fold
from ..operators.scenario import apply_scenarios


@dataclass(frozen=True)
class ForecastSpec:
    key: str = "industry"
    period: str = "year"
    y: str = "unemployment_rate"
    drivers: tuple[str, ...] = ("tariff_2018", "us_export_share", "infra_invest_log",
                                "boc_policy_rate_avg")
    pulse_name: str = "covid"
    pulse_periods: tuple[int, ...] = (2020, 2021)
    order: tuple[int, int, int] = (1, 0, 0)
    origins: tuple[int, ...] = (2020, 2021, 2022, 2023)
    min_total: int = 8
    min_train: int = 6
    train_end: int = 2023
    test_periods: tuple[int, ...] = (2024, 2025)
    scenarios: Mapping[str, Sequence[tuple[str, str, float]]] = field(default_factory=dict)

    @property
    def exog(self) -> list[str]:
        return [*self.drivers, self.pulse_name]


def prepared(features: DataFrame, spec: ForecastSpec) -> DataFrame:
    """Model rows: target, drivers and pulse; drivers cleaned and checked (a
    row with a non-finite driver left raises when it is read); entities with
    fewer than ``min_total`` rows dropped.  A plan only: callers that read it
    several times write it first."""
    k, p = spec.key, spec.period
    df = features.select(k, p, F.col(spec.y).cast("double").alias(spec.y),
                         *[F.col(c).cast("double").alias(c) for c in spec.drivers],
                         pulse_dummy(p, spec.pulse_periods).cast("double").alias(spec.pulse_name))
    df = clean_drivers(df, spec.exog, k, p)
    df = df.filter(flag_non_finite(df, spec.exog))
    counts = df.groupBy(k).agg(F.count(F.lit(1)).alias("__n"))
    ok = counts.filter(F.col("__n") >= spec.min_total).select(k)
    return df.join(ok, k, "left_semi")


def driver_report(features: DataFrame, spec: ForecastSpec) -> DataFrame:
    """Missing and infinite counts of the raw drivers (before cleaning)."""
    df = features.select(*[F.col(c).cast("double").alias(c) for c in spec.drivers],
                         pulse_dummy(spec.period, spec.pulse_periods).cast("double")
                         .alias(spec.pulse_name))
    return missing_report(df, spec.exog)


def scenario_fill(fut: DataFrame, key: str, cols: Sequence[str],
                  scenario_col: str = "scenario") -> DataFrame:
    """Edited drivers: +/-inf -> null, then the median of the same series'
    rows under the same scenario (A9).  A window per (series, scenario)
    holds at most the test periods."""
    w = Window.partitionBy(key, scenario_col)
    out = fut.withColumns({c: finite_or_null(c) for c in cols})
    return out.withColumns({c: F.coalesce(F.col(c), F.median(c).over(w)) for c in cols})


def recipe_backtest(rows: DataFrame, spec: ForecastSpec) -> DataFrame:
    return backtest(rows, [spec.key], spec.period, spec.y, spec.exog, spec.origins, spec.order,
                    min_train=spec.min_train)


def final_params(rows: DataFrame, spec: ForecastSpec) -> DataFrame:
    k, p = spec.key, spec.period
    tr = rows.filter(F.col(p) <= spec.train_end).withColumn("__f", F.lit(0)) \
             .withColumn("is_train", F.lit(True))
    tr = standardize_by_fold(tr, k, "__f", spec.exog, suffix="")
    fits = fit_orders(tr, [k], p, spec.y, spec.exog, [spec.order])
    return fit_params(fits, [k], spec.exog, spec.train_end, standardized=True)


def scenarios(rows: DataFrame, spec: ForecastSpec) -> DataFrame:
    """Fit on the training window (drivers standardised with its
    statistics) and forecast the test window under every scenario; the
    scenario edits apply to the raw drivers, before scaling."""
    k, p = spec.key, spec.period
    train = rows.filter(F.col(p) <= spec.train_end)
    test = rows.filter(F.col(p).isin(list(spec.test_periods))).select(k, p, *spec.exog)
    fut = scenario_fill(apply_scenarios(test, spec.scenarios), k, spec.exog)
    both = (train.select(k, p, spec.y, *spec.exog, F.lit(None).cast("string").alias("scenario"),
                         F.lit(True).alias("is_train"))
            .unionByName(fut.select(k, p, F.lit(None).cast("double").alias(spec.y), *spec.exog,
                                    "scenario", F.lit(False).alias("is_train")))
            .withColumn("__f", F.lit(0)))
    both = standardize_by_fold(both, k, "__f", spec.exog, suffix="")
    tr = both.filter("is_train").drop("scenario")
    fu = both.filter(~F.col("is_train")).select(k, p, *spec.exog, "scenario")
    fits = fit_orders(tr, [k], p, spec.y, spec.exog, [spec.order])
    return scenario_forecasts(tr, fits, fu, [k], p, spec.y, spec.exog)


def holdout(rows: DataFrame, spec: ForecastSpec, orders: Sequence[tuple[int, int, int]],
            standardize: bool = False) -> DataFrame:
    """Hold-out evaluation with a per-entity order choice (M7/M8, M12,
    A10, A13): all candidate orders are fitted on the training window, the
    smallest AIC wins, the winner forecasts the test window from the known
    drivers, and the errors give RMSE and MAE per entity, next to the chosen
    order, its status, AIC and BIC.  Every entity with training rows has a row."""
    from ..operators.aggregate import rmse_mae
    k, p = spec.key, spec.period
    data = rows
    if standardize:
        data = standardize_by_fold(rows.withColumn("__f", F.lit(0))
                                   .withColumn("is_train", F.col(p) <= spec.train_end),
                                   k, "__f", spec.exog, suffix="")
    train = data.filter(F.col(p) <= spec.train_end)
    test = data.filter(F.col(p).isin(list(spec.test_periods)))
    best = select_order(fit_orders(train, [k], p, spec.y, spec.exog, orders), [k])
    fc = scenario_forecasts(train, best, test.select(k, p, *spec.exog,
                                                     F.lit("test").alias("scenario")),
                            [k], p, spec.y, spec.exog).drop("status")
    err = (fc.join(test.select(k, p, F.col(spec.y).alias("actual")), [k, p])
             .withColumn("error", F.col("actual") - F.col("predicted")))
    return with_accuracy(best, rmse_mae(err, [k]), [k], ["ord", "status", "aic", "bic"])
