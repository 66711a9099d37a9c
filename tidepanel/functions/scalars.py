"""Column expressions.

Everything here returns a ``Column`` built from built-in functions, so it
stays inside whole-stage codegen; nothing runs in Python per row.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAINS = ("year", "month", "day")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- periods

def _is_temporal(df: DataFrame, col: str) -> bool:
    dt = df.schema[col].dataType
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def period_expr(df: DataFrame, src: str, grain: str = "year") -> Column:
    """Integer period of ``src`` at ``grain``.

    year  -> calendar year (e.g. 1998)
    month -> month index ``year * 12 + month - 1`` (consecutive integers)
    day   -> days since 1970-01-01

    Timestamps and dates use calendar functions.  Strings are cut by the
    regex ``^(\\d{4})`` (and ``-(\\d{2})`` / ``-(\\d{2})`` for month and day)
    and ``try_cast``: text without a leading year gives null, never an error.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    c = F.col(src)
    if _is_temporal(df, src):
        if grain == "year":
            return F.year(c)
        if grain == "month":
            return F.year(c) * 12 + F.month(c) - 1
        return F.unix_date(F.to_date(c))
    s = c.cast("string")
    year = F.regexp_extract(s, r"^(\d{4})", 1).try_cast("int")
    if grain == "year":
        return year
    month = F.regexp_extract(s, r"^\d{4}-(\d{2})", 1).try_cast("int")
    if grain == "month":
        return F.when(month.between(1, 12), year * 12 + month - 1)
    return F.unix_date(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))


def add_period(df: DataFrame, src: str, grain: str = "year",
               out: str = "year") -> DataFrame:
    return df.withColumn(out, period_expr(df, src, grain))


def _period_start(period: int, grain: str) -> _dt.date:
    if grain == "year":
        return _dt.date(period, 1, 1)
    if grain == "month":
        return _dt.date(period // 12, period % 12 + 1, 1)
    return _dt.date(1970, 1, 1) + _dt.timedelta(days=period)


def _period_after(period: int, grain: str) -> _dt.date:
    return _period_start(period + 1, grain)


def raw_period_bounds(df: DataFrame, src: str, start: int | None, end: int | None,
                      grain: str = "year") -> Column | None:
    """A predicate on the *raw* column that keeps a superset of the rows
    whose period lies in [start, end].  Unlike a predicate on the derived
    period it reaches the parquet scan (PushedFilters, row-group skipping).
    For strings it compares text: every string whose first four characters
    are the year sorts between "start" and "end+1"."""
    if start is None and end is None:
        return None
    c = F.col(src)
    dt = df.schema[src].dataType
    conds = []
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        kind = {T.TimestampNTZType: "TIMESTAMP_NTZ", T.TimestampType: "TIMESTAMP",
                T.DateType: "DATE"}[type(dt)]
        if start is not None:
            conds.append(c >= F.expr(f"{kind} '{_period_start(start, grain)}'"))
        if end is not None:
            conds.append(c < F.expr(f"{kind} '{_period_after(end, grain)}'"))
    elif isinstance(dt, T.StringType) and grain == "year":
        if start is not None:
            conds.append(c >= F.lit(f"{start:04d}"))
        if end is not None:
            conds.append(c < F.lit(f"{end + 1:04d}"))
    else:
        return None
    return reduce(lambda a, b: a & b, conds)


def filter_period_range(df: DataFrame, period: str, start: int | None, end: int | None,
                        raw: str | None = None, grain: str = "year") -> DataFrame:
    """Inclusive period range (F2) plus, when the raw column is given, a
    pushable bound on it."""
    if raw is not None:
        bound = raw_period_bounds(df, raw, start, end, grain)
        if bound is not None:
            df = df.filter(bound)
    p = F.col(period)
    if start is not None:
        df = df.filter(p >= start)
    if end is not None:
        df = df.filter(p <= end)
    return df


# ---------------------------------------------------------------- values

def to_double(col: str | Column) -> Column:
    """Numeric text to double; suppressed cells ("..", "x", "") become null."""
    return _c(col).try_cast("double")


def finite_or_null(col: str | Column) -> Column:
    """NaN and +/-inf become null."""
    c = _c(col)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def is_finite(col: str | Column) -> Column:
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


# ---------------------------------------------------------------- categories

def canonical_category(col: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First rule whose keyword occurs in the lower-cased label wins; no hit
    gives null.  ``rules`` is an ordered list of (keyword, label)."""
    if not rules:
        return F.lit(None).cast("string")
    low = F.lower(_c(col))
    expr = None
    for kw, label in rules:
        cond = low.contains(kw.lower())
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def keyword_any(col: str | Column, keywords: Sequence[str], whole_word: bool = False) -> Column:
    """True when the lower-cased text contains any keyword.  Substring match
    by default (as loose as "port" in "transport"); ``whole_word`` matches
    on word boundaries instead."""
    if not keywords:
        return F.lit(False)
    low = F.lower(_c(col))
    if whole_word:
        import re
        pattern = r"\b(" + "|".join(re.escape(k.lower()) for k in keywords) + r")\b"
        return low.rlike(pattern)
    return reduce(or_, [low.contains(k.lower()) for k in keywords])


# ---------------------------------------------------------------- arithmetic

def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that gives null for a zero or null denominator (ANSI-safe)."""
    return F.try_divide(_c(num), _c(den))


def growth(x: str | Column, lagged: str | Column) -> Column:
    """x / lag - 1."""
    return safe_div(x, lagged) - F.lit(1.0)


def horizontal_sum(cols: Sequence[str | Column]) -> Column:
    """Row-wise sum with nulls counted as 0.0 (P11); no columns -> null."""
    if not cols:
        return F.lit(None).cast("double")
    return reduce(add, [F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols])


def step_dummy(period: str | Column, start: int) -> Column:
    """1 from ``start`` on, else 0."""
    return (_c(period) >= F.lit(start)).cast("int")


def pulse_dummy(period: str | Column, periods: Sequence[int]) -> Column:
    """1 inside the listed periods, else 0."""
    return _c(period).isin(list(periods)).cast("int")


def log1p(col: str | Column) -> Column:
    """log(1 + x); x <= -1 gives null."""
    return F.log1p(_c(col))
