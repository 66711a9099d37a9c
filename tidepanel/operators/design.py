"""Design columns and normal equations.

Categorical effects use treatment coding: levels sorted, the first one
dropped, one 0/1 column per other level.  The list of levels is the list
of output columns, so it is read to the driver (one ``distinct`` per factor)
or given by the caller.  A regression needs no such columns:
:func:`tidepanel.operators.regression.fit_ols` takes factors as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import sanitize_name
from .aggregate import lossless_decimal


def factor_levels(df: DataFrame, col: str) -> list:
    return sorted(r[0] for r in df.select(col).distinct().collect() if r[0] is not None)


def dummy_name(col: str, level) -> str:
    return f"{col}_{sanitize_name(str(level), 'gold')}"


def treatment_dummies(col: str, levels: Sequence, drop_first: bool = True) -> dict[str, Column]:
    use = list(levels)[1:] if drop_first else list(levels)
    return {dummy_name(col, lv): (F.col(col) == F.lit(lv)).cast("int") for lv in use}


def design_matrix(df: DataFrame, numeric: Sequence[str], factors: Sequence[str],
                  levels: dict | None = None, intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """Add dummy columns for ``factors`` (P20); return the frame and the
    ordered list of design column names (intercept first)."""
    levels = dict(levels or {})
    cols = {}
    for f in factors:
        if f not in levels:
            levels[f] = factor_levels(df, f)
        cols.update(treatment_dummies(f, levels[f]))
    out = df.withColumns(cols) if cols else df
    names = (["const"] if intercept else []) + list(numeric) + list(cols)
    if intercept:
        out = out.withColumn("const", F.lit(1))
    return out, names


def cross_products(df: DataFrame, cols: Sequence[str], decimal_scale: int | None = None,
                   group_cols: Sequence[str] = ()) -> DataFrame:
    """sum(x_i * x_j) for i <= j and the row count, in one aggregate.

    ``decimal_scale`` sums in exact decimal arithmetic (inputs as
    ``decimal(18, s)``; more digits raise): the result then does not depend
    on how rows are split across tasks, so reruns on a different cluster
    agree to the bit."""
    def v(c):
        return lossless_decimal(c, decimal_scale) if decimal_scale is not None else F.col(c)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            s = F.sum(v(a) * v(b))
            aggs.append((s.cast("double") if decimal_scale is not None else s).alias(f"{a}__{b}"))
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)
