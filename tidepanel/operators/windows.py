"""Per-entity time windows.

All expressions here use ``Window.partitionBy(key).orderBy(period)``.
Expressions that share a spec are evaluated by one Exchange + Sort, so
callers should put every lag of a layer into one ``select``.  Partitions
are entities: run these on data already aggregated to one row per
(entity, period), so a partition holds at most one row per period even
when an entity carries a third of the raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key):
    return [key] if isinstance(key, str) else list(key)


def spec(key: str | Sequence[str], period: str):
    return Window.partitionBy(*_keys(key)).orderBy(period)


def lag(x: str, key, period: str, n: int = 1, strict: bool = False) -> Column:
    """Value ``n`` rows back (W2).  Positional by default, so a missing
    period pairs with the one before it; ``strict=True`` gives null unless
    the earlier row is exactly ``n`` periods back."""
    w = spec(key, period)
    v = F.lag(F.col(x), n).over(w)
    if not strict:
        return v
    return F.when(F.col(period) - F.lag(F.col(period), n).over(w) == n, v)


def first_difference(x: str, key, period: str, strict: bool = False) -> Column:
    """x - lag(x)."""
    return F.col(x) - lag(x, key, period, 1, strict)


def forward_fill(x: str, key, period: str) -> Column:
    """Last non-null value up to this row."""
    w = spec(key, period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(F.col(x), ignorenulls=True).over(w)


def back_fill(x: str | Column, key, period: str) -> Column:
    """First non-null value from this row on."""
    w = spec(key, period).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    c = F.col(x) if isinstance(x, str) else x
    return F.first(c, ignorenulls=True).over(w)


def two_way_demean(df: DataFrame, cols: Sequence[str], key, period: str,
                   suffix: str = "_dm", period_bound: int | None = None) -> DataFrame:
    """x - mean over entity - mean over period + grand mean (W7), the exact
    fixed-effects transform for a balanced panel.

    Entity means are a window per entity (short partitions: one row per
    period).  Period means are a grouped aggregate joined back on the
    period, broadcast when the number of periods is bounded: a window per
    period would put every entity of a period into one task.  Grand means
    are scalar subqueries (partial sums per task)."""
    from .joins import broadcast_bounded
    wk = Window.partitionBy(*_keys(key))
    pm = df.groupBy(period).agg(*[F.avg(c).alias(f"__p_{c}") for c in cols])
    out = df.join(broadcast_bounded(pm, period_bound), on=period)
    return out.withColumns({
        f"{c}{suffix}": F.col(c) - F.avg(c).over(wk) - F.col(f"__p_{c}")
        + df.select(F.avg(c)).scalar()
        for c in cols
    }).drop(*[f"__p_{c}" for c in cols])
