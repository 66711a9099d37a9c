"""Grouped aggregates.

All of these are ``groupBy(...).agg(...)`` so Spark plans a partial
(map-side) aggregate before the shuffle and a final one after it: the
shuffle carries one row per group per task, whatever the input size, and a
hot key is combined on the map side before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import safe_div

_HOW = {"avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def _agg_fn(how: str):
    try:
        return _HOW[how]
    except KeyError:
        raise ValueError(f"unknown aggregate {how!r}; use one of {sorted(_HOW)}") from None


def numeric(df: DataFrame, col: str) -> Column:
    """A value column as a number: decimals stay decimal (their sums are
    exact), anything else is cast to double."""
    dt = df.schema[col].dataType
    c = F.col(col)
    return c if isinstance(dt, T.DecimalType) else c.cast("double")


def lossless_decimal(col: str, scale: int = 2, precision: int = 18) -> Column:
    """The column as an exact ``decimal(precision, scale)``; a value with more
    digits raises instead of losing them (give the scale the data have)."""
    c = F.col(col)
    d = c.cast(f"decimal({precision},{scale})")
    same = c.isNull() | (d.cast("double") == c.cast("double"))
    return F.when(same, d).otherwise(F.raise_error(F.concat(
        F.lit(f"{col} has more than {scale} decimals: "), c.cast("string"))).cast(
            f"decimal({precision},{scale})"))


def as_cents(df: DataFrame, *cols: str, scale: int = 2) -> DataFrame:
    """Mark money or quantity columns of at most ``scale`` decimals as exact;
    every operator here then sums them exactly and converts to double once,
    so results do not depend on how rows are split over tasks."""
    return df.withColumns({c: lossless_decimal(c, scale) for c in cols})


def exact_sum(col: str, scale: int = 2) -> Column:
    return F.sum(lossless_decimal(col, scale)).cast("double")


def exact_mean(col: str, scale: int = 2) -> Column:
    return F.try_divide(exact_sum(col, scale), F.count(col).cast("double"))


def weighted(how: str, v: Column, w: Column | None) -> Column:
    """Aggregate of ``v``; with a weight column the rows are pre-aggregated
    (``v`` a sum over ``w`` source rows), so the mean is sum(v) / sum(w) -
    exactly the mean over the source rows.  Sums of decimals are exact and
    converted to double once, at the end."""
    if w is None:
        if how in ("avg", "mean"):      # sum / count: exact for decimals, = avg for doubles
            return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))
        return _agg_fn(how)(v).cast("double")
    if how in ("avg", "mean"):
        return F.try_divide(F.sum(v).cast("double"),
                            F.sum(F.when(v.isNotNull(), w)).cast("double"))
    if how == "sum":
        return F.sum(v).cast("double")
    raise ValueError(f"{how!r} cannot be computed from pre-aggregated rows")


def annualize(df: DataFrame, group_cols: Sequence[str], value_col: str = "value",
              how: str = "avg", out: str = "value", weight_col: str | None = None) -> DataFrame:
    """Collapse to one row per group: ``avg`` for levels and rates, ``sum``
    for flows (A1, A2).  Unknown ``how`` is an error."""
    _agg_fn(how)
    w = F.col(weight_col) if weight_col else None
    return df.groupBy(*group_cols).agg(weighted(how, numeric(df, value_col), w).alias(out))


def pivot_measures(df: DataFrame, group_cols: Sequence[str], measure_col: str,
                   value_col: str, mapping: Mapping[str, str] | Sequence[str],
                   how: str = "avg", weight_col: str | None = None) -> DataFrame:
    """Long -> wide with an explicit value list.

    ``mapping`` maps raw measure labels to output column names (several
    labels may share a name); a plain list keeps the labels as names.
    Unlisted labels are dropped, a listed label absent from the data gives
    a typed null column, and the aggregate is deterministic (no ``first``).
    Because the value list is given, Spark needs no extra job to discover
    it, the output schema does not depend on the data, and the pivot is a
    single conditional aggregate.  With ``weight_col`` the input is
    pre-aggregated (see :func:`weighted`).
    """
    if not isinstance(mapping, Mapping):
        mapping = {m: m for m in mapping}
    names = list(dict.fromkeys(mapping.values()))
    _agg_fn(how)
    if weight_col is not None and how not in ("avg", "mean", "sum"):
        raise ValueError(f"{how!r} cannot be computed from pre-aggregated rows")
    label = F.col(measure_col)
    labels_of = {n: [raw for raw, m in mapping.items() if m == n] for n in names}
    v = numeric(df, value_col)
    w = F.col(weight_col) if weight_col else None
    # one conditional aggregate per output column: a single partial +
    # final aggregation (one shuffle), where pivot() would aggregate twice
    hit_any = label.isin(list(mapping))
    aggs = []
    for n in names:
        hit = label.isin(labels_of[n])
        aggs.append(weighted(how, F.when(hit, v), None if w is None else F.when(hit, w)).alias(n))
    return df.filter(hit_any).groupBy(*group_cols).agg(*aggs)


def focal_share(df: DataFrame, period_col: str, partner_col: str, value_col: str,
                focal: str, exclude: Sequence[str] = (),
                focal_name: str = "exports_us", total_name: str = "exports_total",
                share_name: str = "us_export_share") -> DataFrame:
    """Focal partner, total and focal share per period in one pass.

    Equivalent to summing per (period, partner), splitting focal / the rest
    and full-outer-joining the two on period, but with one conditional
    aggregate instead of a self-join.  ``total = focal + rest`` and
    ``share = focal / total`` are null when either side is missing (or the
    total is 0).  Partners in ``exclude`` (e.g. an "all countries" total
    row) are left out of the rest; a null partner falls out of both.
    """
    p = F.col(partner_col)
    v = numeric(df, value_col)
    is_focal = p == F.lit(focal)
    is_rest = (p != F.lit(focal))
    if exclude:
        is_rest = is_rest & ~p.isin(list(exclude))
    out = (
        df.groupBy(period_col)
        .agg(
            F.sum(F.when(is_focal, v)).alias(focal_name),
            F.sum(F.when(is_rest, v)).alias("__rest"),
            F.count_if(is_focal).alias("__n_focal"),
            F.count_if(is_rest).alias("__n_rest"),
        )
        .filter((F.col("__n_focal") > 0) | (F.col("__n_rest") > 0))
    )
    total = F.col("__rest") + F.col(focal_name)      # exact when decimal
    focal_d, total_d = F.col(focal_name).cast("double"), total.cast("double")
    return out.select(
        period_col,
        focal_d.alias(focal_name),
        total_d.alias(total_name),
        safe_div(focal_d, total_d).alias(share_name),
    )


def focal_split_join(df: DataFrame, period_col: str, partner_col: str, value_col: str,
                     focal: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The join form of :func:`focal_share` (J1 as written in the source):
    focal sums full-outer-joined with the rest on period.  Kept as a second
    operator for callers that need both sides as separate tables."""
    v = numeric(df, value_col)
    per = df.groupBy(period_col, partner_col).agg(F.sum(v).cast("double").alias("value"))
    focal_df = per.filter(F.col(partner_col) == focal).select(
        period_col, F.col("value").alias("focal_value"))
    rest = per.filter(F.col(partner_col) != focal)
    if exclude:
        rest = rest.filter(~F.col(partner_col).isin(list(exclude)))
    rest = rest.groupBy(period_col).agg(F.sum("value").alias("rest_value"))
    return focal_df.join(rest, on=period_col, how="full")


def median_by(df: DataFrame, group_cols: Sequence[str], cols: Sequence[str],
              exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Median per group and column (A8, A9).  ``exact`` uses ``median``
    (sort inside each group: meant for groups of aggregated rows); on very
    large groups pass ``exact=False`` for ``percentile_approx`` whose memory
    per group is bounded by ``accuracy``.  Without groups the exact median
    is the distributed one."""
    if exact and not group_cols:
        from .clean import median_row
        return median_row(df, cols, accuracy)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        m = F.median(x) if exact else F.percentile_approx(x, 0.5, accuracy)
        aggs.append(m.alias(c))
    if group_cols:
        return df.groupBy(*group_cols).agg(*aggs)
    return df.agg(*aggs)


def rmse_mae(df: DataFrame, group_cols: Sequence[str], error_col: str = "error",
             rmse: str = "rmse", mae: str = "mae") -> DataFrame:
    """Root mean squared and mean absolute error per group (A10)."""
    e = F.col(error_col)
    return df.groupBy(*group_cols).agg(
        F.sqrt(F.avg(e * e)).alias(rmse),
        F.avg(F.abs(e)).alias(mae),
        F.count(e).alias("n_forecasts"),
    )


def best_by(df: DataFrame, group_cols: Sequence[str], score_col: str, order_cols: Sequence[str],
            keep: Sequence[str]) -> DataFrame:
    """Row with the smallest score per group; ties go to the smallest
    ``order_cols`` (grid position), null scores (failed fits) never win
    unless all are null, in which case the group has no winner (A13).

    ``min_by`` over a struct is a plain aggregate: partial aggregation on
    the map side, no window sort, one row per group."""
    ranked = F.struct(F.col(score_col).alias("s"), *[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in keep])
    best = (
        df.filter(F.col(score_col).isNotNull())
        .groupBy(*group_cols)
        .agg(F.min_by(payload, ranked).alias("__best"))
    )
    return best.select(*group_cols, *[F.col(f"__best.{c}").alias(c) for c in keep])
