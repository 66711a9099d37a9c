"""ARMA models with drivers, one per series.

    y_t = c + phi_1 y_{t-1} + ... + phi_p y_{t-p} + x_t' beta
            + e_t + theta_1 e_{t-1} + ... + theta_q e_{t-q}

(or the same in differences of any degree), by conditional least squares.  Per
series Spark aggregates the means and co-moments of lags, drivers and target
in one pass (partial aggregates, whatever the series' length).  All orders of
one degree are fitted from that one matrix, on the rows that have every
column, so their AIC values compare.  The only Python is :func:`sweep`, which
solves the small systems of a batch of series at once.

Moving-average terms are fitted by the two regressions of Hannan and Rissanen
(1982): a long autoregression with the drivers gives the innovations as its
residuals (:func:`with_innovations`), and their lags are columns of the second
regression like any other.  No likelihood is maximised.  A series too short for
the long autoregression still has its fits without moving-average terms.

Forecasts run the recursion as a higher-order function over a series' future
drivers, for any p, d and q.  Every series gets a row; ``status`` says what
became of it: ``ok``, ``perfect_fit`` (no residual variance; forecasts exist,
information criteria do not), ``too_short``, and for forecasts
``missing_driver``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import materialize
from .aggregate import best_by
from .forecast import Z95
from .windows import lag, spec

PIVOT_TOL = 1e-10     # a column with less own variation than this share is redundant
PERFECT_FIT = 1e-12   # residual share of the target's variation
LONG_AR = 4           # lags of the autoregression that gives the innovations
HISTORY = 8           # last values of a series that a forecast can look back on

Order = tuple[int, int, int]


def order_name(order: Order) -> str:
    return "({}, {}, {})".format(*order)


def sweep(s: np.ndarray, k: int, tol: float = PIVOT_TOL) -> np.ndarray:
    """Sweep the first ``k`` columns of a stack of co-moment matrices in
    place: afterwards the last column holds the slopes, the last diagonal
    element the residual sum of squares, and the block of the swept columns
    minus its inverse.  A column that depends on the ones before it is left
    out (slope 0).  Returns the rank per matrix."""
    own = np.einsum("gii->gi", s).copy()
    rank = np.zeros(len(s), int)
    for t in range(k):
        pivot = s[:, t, t]
        ok = pivot > tol * own[:, t]
        rank += ok
        p = np.where(ok, pivot, 1.0)
        col = np.where(ok[:, None], s[:, :, t], 0.0)
        s -= col[:, :, None] * col[:, None, :] / p[:, None, None]
        col /= p[:, None]
        col[:, t] = np.where(ok, -1.0 / p, 0.0)
        s[:, t, :] = s[:, :, t] = col
    return rank


def _lag_name(n: int) -> str:
    return f"__lag{n}"


def _shock_name(n: int) -> str:
    return f"__shock{n}"


def model_rows(df: DataFrame, keys: Sequence[str], period: str, y: str, exog: Sequence[str],
               lags: int, diff: int) -> DataFrame:
    """Rows with target, its lags and drivers (all differenced ``diff``
    times)."""
    base = df.select(*keys, period, F.col(y).cast("double").alias(y),
                     *[F.col(c).cast("double").alias(c) for c in exog])
    w = spec(keys, period)
    for _ in range(diff):
        base = base.withColumns({f"__d_{c}": F.col(c) - F.lag(c).over(w) for c in [y, *exog]})
        base = base.select(*keys, period, *[F.col(f"__d_{c}").alias(c) for c in [y, *exog]])
    return base.withColumns({_lag_name(n): lag(y, keys, period, n) for n in range(1, lags + 1)})


def _moment_columns(cols: Sequence[str], over=None) -> list[Column]:
    """n, means and the upper triangle of the centred co-moments of the rows
    without a gap in any column, as aggregates or (``over``) as window
    functions."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    v = {c: F.when(ok, F.col(c)) for c in cols}
    of = (lambda c: c) if over is None else (lambda c: c.over(over))
    n = of(F.count_if(ok))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return [n.cast("int").alias("n_obs"),
            F.array(*[of(F.avg(v[c])) for c in cols]).alias("means"),
            F.array(*[of(F.covar_pop(v[a], v[b])) * n for a, b in pairs]).alias("moments")]


def _moments(rows: DataFrame, keys: Sequence[str], cols: Sequence[str],
             *more: Column) -> DataFrame:
    """:func:`_moment_columns` per series, and the aggregates ``more``; a
    series of gaps only still has its row."""
    return rows.groupBy(*keys).agg(*_moment_columns(cols), *more)


FIT_COLUMNS = ("pos int, ar int, diff int, ma int, ord string, status string, n_obs int, "
               "loglik double, aic double, bic double, sigma2 double, intercept double, "
               "phi array<double>, beta array<double>, theta array<double>, "
               "shocks array<double>")


def _keys_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _solve(orders: list[tuple[int, Order]], lags: int, n_exog: int, keys: list[str],
           shocks: int = 0):
    """Fits of ``orders`` from moments of the columns: ``lags`` lags of the
    target, ``shocks`` lags of the innovations, the drivers, the target."""
    size = lags + shocks + n_exog + 1
    upper = np.triu_indices(size)

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = pdf["n_obs"].to_numpy()
            use = n > 0
            full = np.zeros((len(pdf), size, size))
            mean = np.zeros((len(pdf), size))
            if use.any():
                block = np.stack(pdf.loc[use, "moments"].to_list()).astype(float)
                for (i, j), col in zip(zip(*upper), block.T):
                    full[use, i, j] = full[use, j, i] = col
                mean[use] = np.stack(pdf.loc[use, "means"].to_list()).astype(float)
            for pos, (p, d, q) in orders:
                pick = [*range(p), *range(lags, lags + q), *range(lags + shocks, size)]
                s = full[np.ix_(range(len(pdf)), pick, pick)].copy()
                k = len(pick) - 1
                total = s[:, k, k].copy()
                rank = sweep(s, k)
                slope = s[:, :k, k]
                ssr = np.maximum(s[:, k, k], 0.0)
                icpt = mean[:, -1] - (slope * mean[:, pick[:-1]]).sum(axis=1)
                short = n < rank + 3
                if q:
                    short |= pdf["unshocked"].to_numpy(bool)
                exact = ~short & (ssr <= PERFECT_FIT * total)
                good = ~short & ~exact
                sigma2 = ssr / np.maximum(n, 1)
                ll = np.full(len(pdf), np.nan)
                ll[good] = -0.5 * n[good] * (math.log(2 * math.pi) + np.log(sigma2[good]) + 1)
                par = rank + 2
                out = pdf[keys].copy()
                out["pos"], out["ar"], out["diff"], out["ma"] = pos, p, d, q
                out["ord"] = order_name((p, d, q))
                out["status"] = np.where(short, "too_short", np.where(exact, "perfect_fit", "ok"))
                out["n_obs"] = n
                nan_to_none = lambda a, m: [float(x) if u else None
                                            for x, u in zip(a, m)]
                out["loglik"] = nan_to_none(ll, good)
                out["aic"] = nan_to_none(-2 * ll + 2 * par, good)
                out["bic"] = nan_to_none(-2 * ll + np.log(np.maximum(n, 1)) * par, good)
                out["sigma2"] = nan_to_none(sigma2, ~short)
                out["intercept"] = nan_to_none(icpt, ~short)
                out["phi"] = [x[:p].tolist() if u else None for x, u in zip(slope, ~short)]
                out["beta"] = [x[p + q:].tolist() if u else None for x, u in zip(slope, ~short)]
                out["theta"] = [x[p:p + q].tolist() if u else None for x, u in zip(slope, ~short)]
                out["shocks"] = pdf["shocks"] if shocks else [[]] * len(pdf)
                yield out
    return body


def with_innovations(rows: DataFrame, keys: Sequence[str], period: str, y: str,
                     exog: Sequence[str], long_ar: int, q: int) -> DataFrame:
    """Rows of :func:`model_rows` (with ``long_ar`` lags at least) plus the
    residual ``__shock0`` of the long autoregression and its lags 1 to ``q``.
    Where it has no residual variance the innovations are zero; where a series
    is too short for it they are zero as well and ``__unshocked`` is true."""
    keys, exog = list(keys), list(exog)
    lags = [_lag_name(n) for n in range(1, long_ar + 1)]
    first = _moments(rows, keys, [*lags, *exog, y]).mapInPandas(
        _solve([(0, (long_ar, 0, 0))], long_ar, len(exog), keys),
        f"{_keys_ddl(rows, keys)}, {FIT_COLUMNS}").select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("status").alias("__first"),
        F.col("intercept").alias("__c"), F.concat("phi", "beta").alias("__b"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    fitted = F.col("__first") == "ok"
    value = F.col(y) - F.col("__c")
    for i, c in enumerate([*lags, *exog]):
        value = value - F.get("__b", F.lit(i)) * F.col(c)
    out = rows.join(first, same).withColumn(
        _shock_name(0), F.when(fitted, value).otherwise(F.lit(0.0)))
    w = spec(keys, period)
    out = out.withColumns({
        _shock_name(n): F.when(fitted, F.lag(_shock_name(0), n).over(w)).otherwise(F.lit(0.0))
        for n in range(1, q + 1)})
    return out.withColumn("__unshocked", F.col("__first") == "too_short").drop(
        "__first", "__c", "__b", *[f"__k_{k}" for k in keys])


def fit_orders(df: DataFrame, keys: Sequence[str], period: str, y: str, exog: Sequence[str],
               orders: Sequence[Order], long_ar: int = LONG_AR) -> DataFrame:
    """One row per (series, order): coefficients and information criteria.
    Orders of one differencing degree share their rows and one aggregate; with
    moving-average terms among them, the innovations of a long autoregression
    of ``long_ar`` lags come first, in an aggregate of their own."""
    keys, exog = list(keys), list(exog)
    out = None
    for d in sorted({d for _, d, _ in orders}):
        own = [(i, o) for i, o in enumerate(orders) if o[1] == d]
        lags, q = max(o[0] for _, o in own), max(o[2] for _, o in own)
        cols = [_lag_name(n) for n in range(1, lags + 1)] + exog + [y]
        rows = model_rows(df, keys, period, y, exog, max(lags, long_ar if q else 0), d)
        more = []
        if q:
            rows = with_innovations(rows, keys, period, y, exog, long_ar, q)
            cols[lags:lags] = [_shock_name(n) for n in range(1, q + 1)]
            # the last innovations, the latest first, for the forecasts
            more = [F.max("__unshocked").alias("unshocked"),
                    F.max_by(F.array(*[_shock_name(n) for n in range(q)]), period)
                    .alias("shocks")]
        fits = _moments(rows, keys, cols, *more).mapInPandas(
            _solve(own, lags, len(exog), keys, q), f"{_keys_ddl(df, keys)}, {FIT_COLUMNS}")
        out = fits if out is None else out.unionByName(fits)
    return out


def select_order(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best order per series: smallest AIC, ties to the first grid position
    (A13, M7, M8).  An order without an AIC is only chosen where no order has
    one, so every series keeps a row with its status."""
    return best_by(fits.withColumn("__none", F.col("aic").isNull()), keys, "__none",
                   ["aic", "pos"], [c.split()[0] for c in FIT_COLUMNS.split(", ")])


def fit_params(fits: DataFrame, keys: Sequence[str], exog: Sequence[str], train_end: int,
               standardized: bool = False) -> DataFrame:
    """Fitted parameters in long form, one row per parameter (M15, M16); a
    series without a fit has one row with its status and no parameter."""
    fitted = F.col("intercept").isNotNull()
    names = [F.struct(F.lit("intercept").alias("n"), F.col("intercept").alias("v"))]
    names += [F.struct(F.lit(c).alias("n"), F.get("beta", F.lit(i)).alias("v"))
              for i, c in enumerate(exog)]
    lags = F.transform("phi", lambda v, i: F.struct(
        F.concat(F.lit("ar.L"), (i + 1).cast("string")).alias("n"), v.alias("v")))
    shocks = F.transform("theta", lambda v, i: F.struct(
        F.concat(F.lit("ma.L"), (i + 1).cast("string")).alias("n"), v.alias("v")))
    last = F.array(F.struct(F.lit("sigma2").alias("n"), F.col("sigma2").alias("v")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("n"),
                            F.lit(None).cast("double").alias("v")))
    return (fits.withColumn("__p", F.explode(F.when(
        fitted, F.concat(F.array(*names), lags, shocks, last)).otherwise(none)))
        .select(*keys, F.lit(int(train_end)).alias("train_end"), "ord", "status",
                F.col("__p.n").alias("param_name"), F.col("__p.v").alias("param_value"),
                "aic", "bic", F.lit(",".join(exog)).alias("exog_cols"),
                F.lit(bool(standardized)).alias("standardized_exog")))


def _of_level(coefficients: Column) -> Column:
    """Lag coefficients of a model in differences of degree ``diff`` as lag
    coefficients of the level: 1 - sum a_i B^i is multiplied by (1 - B) as
    often, which turns a_i into a_i - a_{i-1} with a_0 = -1 and one lag more."""
    once = lambda a: F.zip_with(
        F.concat(a, F.array(F.lit(0.0))), F.concat(F.array(F.lit(-1.0)), a),
        lambda x, before: x - before)
    times = F.when(F.col("diff") > 0, F.sequence(F.lit(1), F.col("diff"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(times, coefficients.cast("array<double>"), lambda a, _: once(a))


def _dot(coefficients: Column, values: Column, start: Column) -> Column:
    """start + sum of products; a value counts only where its coefficient is
    not zero, so lags that a series does not have do no harm unless used."""
    terms = F.zip_with(coefficients, F.slice(values, F.lit(1), F.size(coefficients)),
                       lambda c, v: F.when(c == 0, F.lit(0.0)).otherwise(c * v))
    return F.aggregate(terms, start, lambda acc, t: acc + t)


def scenario_forecasts(train: DataFrame, fits: DataFrame, future: DataFrame,
                       keys: Sequence[str], period: str, y: str, exog: Sequence[str],
                       scenario_col: str = "scenario", z: float = Z95,
                       history: int = HISTORY) -> DataFrame:
    """Forecasts with 95 % intervals for every future row of every scenario
    (M10, M11, M14).  ``fits``: one row per series.  ``train`` gives each
    series its last ``history`` values; a model with more lags of the level
    (p + d) raises.  Innovations after the last training period are zero.
    Future drivers must follow the last training period without a gap, unless
    the model has no lags; rows after a gap (or a missing driver) get a null
    forecast and the status ``missing_driver``."""
    keys, exog = list(keys), list(exog)
    w = spec(keys, period)
    level, drivers = F.col(y).cast("double"), F.array(*[F.col(c).cast("double") for c in exog])
    back = range(history)
    tail = train.select(*keys, period,
                        F.array(*[F.lag(level, n).over(w) for n in back]).alias("__y"),
                        F.array(*[F.lag(drivers, n).over(w) for n in back]).alias("__x"))
    last = tail.groupBy(*keys).agg(F.max(period).alias("__last"),
                                   F.max_by(F.struct("__y", "__x"), period).alias("__t"))
    steps = future.groupBy(*keys, scenario_col).agg(F.sort_array(F.collect_list(F.struct(
        F.col(period).alias("p"), drivers.alias("x")))).alias("__s"))
    own = fits.select(
        *keys, "status", "sigma2", "intercept", "beta", "theta", "shocks",
        _of_level(F.col("phi")).alias("__a"),
        # the drivers of a model in differences, as a combination of their levels
        _of_level(F.array()).alias("__d"))
    known = F.coalesce(F.size("__a"), F.lit(0)) <= history
    own = own.withColumn("__a", F.when(known, F.col("__a")).otherwise(
        F.raise_error(F.lit("the model has more lags than history")).cast("array<double>")))
    rows = (steps.join(last, keys, "left").join(own, keys, "left")
            .withColumn("__s", F.filter("__s", lambda s: s["p"] > F.col("__last"))))
    # without lags a gap does not matter
    still = F.forall("__a", lambda a: a == 0) & F.forall("theta", lambda a: a == 0)

    def push(s, i):
        """What the drivers and the constant add in a step; null from the
        first gap on."""
        earlier = F.transform("__d", lambda c, j: F.struct(c.alias("c"), F.when(
            j < i, F.get(F.col("__s"), i - j - 1)["x"]).otherwise(
            F.get(F.col("__t.__x"), j - i)).alias("x")))
        moved = F.aggregate(earlier, s["x"], lambda x, e: F.zip_with(
            x, e["x"], lambda u, v: u - e["c"] * v))
        dot = F.aggregate(F.zip_with(moved, F.col("beta"), lambda a, b: a * b),
                          F.lit(0.0), lambda acc, v: acc + v)
        return F.struct(s["p"].alias("p"), F.when(
            still | (s["p"] == F.col("__last") + i + 1), F.col("intercept") + dot).alias("u"))
    rows = rows.withColumn("__u", F.transform("__s", push))
    point = "array<struct<p:int,mean:double,var:double>>"
    start = F.struct(
        F.col("__t.__y").alias("y"), F.array_repeat(F.lit(0.0), history).alias("g"),
        F.lit(0.0).alias("s2"), F.array().cast(point).alias("out"))
    pushed = lambda v, old: F.slice(F.concat(F.array(v), old), 1, history)

    def step(acc, s):
        done = F.size(acc["out"])
        # innovation h - j of step h = done + 1 is one of the known ones while j >= h
        shocks = F.transform("theta", lambda c, j: F.when(
            j >= done, c * F.get(F.col("shocks"), j - done)).otherwise(F.lit(0.0)))
        mean = F.aggregate(shocks, _dot(F.col("__a"), acc["y"], s["u"]), lambda a, t: a + t)
        # psi weights: 1 in the first step, then the recursion
        psi = F.when(done == 0, F.lit(1.0)).otherwise(
            _dot(F.col("__a"), acc["g"], F.lit(0.0))
            + F.coalesce(F.get(F.col("theta"), done - 1), F.lit(0.0)))
        s2 = acc["s2"] + psi * psi
        return F.struct(pushed(mean, acc["y"]).alias("y"), pushed(psi, acc["g"]).alias("g"),
                        s2.alias("s2"), F.concat(acc["out"], F.array(F.struct(
                            s["p"].cast("int").alias("p"), mean.alias("mean"),
                            (F.col("sigma2") * s2).alias("var")))).alias("out"))
    rows = rows.withColumn("__f", F.explode(F.aggregate("__u", start, step, lambda a: a["out"])))
    half = z * F.sqrt("__f.var")
    mean = F.col("__f.mean")
    return rows.select(
        *keys, scenario_col, F.col("__f.p").alias(period),
        F.when(F.col("intercept").isNull(), F.coalesce("status", F.lit("too_short")))
        .when(mean.isNull(), F.lit("missing_driver")).otherwise(F.col("status")).alias("status"),
        mean.alias("predicted"), F.when(mean.isNotNull(), mean - half).alias("ci_lower"),
        F.when(mean.isNotNull(), mean + half).alias("ci_upper"))


def with_accuracy(best: DataFrame, accuracy: DataFrame, keys: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Accuracy of a hold-out next to ``columns`` of the chosen fits, a row
    per fit: a model that could be fitted but had nothing to forecast has the
    status ``no_forecast`` (M12)."""
    out = best.select(*keys, "intercept", *columns).join(accuracy, list(keys), "left")
    count = F.coalesce("n_forecasts", F.lit(0)).cast("long")
    return (out.withColumn("n_forecasts", count)
            .withColumn("status", F.when(F.col("intercept").isNotNull() & (count == 0),
                                         "no_forecast").otherwise(F.col("status")))
            .select(*keys, *[c for c in accuracy.columns if c not in keys], *columns))


def backtest(df: DataFrame, keys: Sequence[str], period: str, y: str, exog: Sequence[str],
             origins: Sequence[int], order: Order = (1, 0, 0), min_train: int = 0,
             z: float = Z95) -> DataFrame:
    """Rolling-origin one-step backtest (M13): per (series, origin) the model
    is fitted on the rows up to the origin and forecasts the next period.  One
    row per (series, origin): ``missing_period`` when the origin or the period
    after it is absent (F11), ``too_short`` below ``min_train`` training
    rows (F10) or too few for the fit.

    No row is copied per origin: the co-moments of a training window are the
    running co-moments of the series, read at the origin's own row, so two
    hundred origins cost what four cost.  Scaling the drivers with the training
    rows' statistics (P24) changes neither the fit nor its forecasts, so it is
    left out."""
    keys, exog = list(keys), list(exog)
    p, d, q = order
    if d or q:
        raise ValueError("the one-step backtest takes undifferenced orders without "
                         "moving-average terms")
    rows = model_rows(df, keys, period, y, exog, p, 0)
    cols = [_lag_name(n) for n in range(1, p + 1)] + exog + [y]
    w = spec(keys, period)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    te = F.col(period)
    aggregates = _moment_columns(cols, run)
    at = rows.select(
        *keys, te.alias("te"), F.count(F.lit(1)).over(run).alias("__n"),
        (F.lead(period).over(w) == te + 1).alias("__next"),
        F.lead(F.array(*cols[:-1])).over(w).alias("__x"), F.lead(y).over(w).alias("actual"),
        *aggregates).filter(F.col("te").isin([int(t) for t in origins]))
    by = [*keys, "te"]
    at = materialize(at)
    fits = at.select(*by, "n_obs", "means", "moments").mapInPandas(
        _solve([(0, order)], p, len(exog), by), f"{_keys_ddl(at, by)}, {FIT_COLUMNS}")
    listed = F.array(*[F.lit(int(t)).cast(at.schema["te"].dataType) for t in sorted(set(origins))])
    every = df.select(*keys).distinct().withColumn("te", F.explode(listed))
    facts = at.select(*by, "__n", "__next", "__x", "actual")
    # the period after an origin that is itself absent still has its value
    after = (df.filter(te.isin([int(t) + 1 for t in origins]))
             .groupBy(*keys, (te - 1).cast(at.schema["te"].dataType).alias("te"))
             .agg(F.max(y).alias("__after")))
    out = _left_null_safe(_left_null_safe(every, facts, by), fits, by)
    out = _left_null_safe(out, after, by)
    here = F.coalesce("__next", F.lit(False))
    out = out.withColumn("__ok", here & (F.col("__n") >= min_train)
                         & F.col("intercept").isNotNull())
    mean = F.col("intercept") + F.aggregate(
        F.zip_with(F.col("__x"), F.concat("phi", "beta"), lambda a, b: a * b), F.lit(0.0),
        lambda acc, v: acc + v)
    out = out.withColumn("predicted", F.when(F.col("__ok"), mean)).withColumn(
        "actual", F.when(here, F.col("actual")).otherwise(F.col("__after")))
    err = F.col("actual") - F.col("predicted")
    half = z * F.sqrt("sigma2")
    shown = lambda c: F.when(F.col("__ok"), F.col(c)).alias(c)
    return out.select(
        *keys, F.col("te").alias("train_end"), (F.col("te") + 1).alias("test_period"),
        F.lit(order_name(order)).alias("ord"),
        F.when(~here, "missing_period").when(~F.col("__ok"), "too_short")
        .when(F.col("predicted").isNull(), "missing_driver")
        .otherwise(F.col("status")).alias("status"),
        "actual", "predicted", err.alias("error"), F.abs(err).alias("abs_error"),
        (F.col("predicted") - half).alias("ci_lower"),
        (F.col("predicted") + half).alias("ci_upper"), shown("aic"), shown("bic"))


def _left_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join that also joins null keys."""
    named = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return left.join(named, same, "left").drop(*[f"__r_{c}" for c in on])
