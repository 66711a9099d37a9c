"""Joins (J2-J5) and the broadcast rule used everywhere.

A side is broadcast only when its row count has a bound known from how it
was built (a group-by on a period inside a fixed range, a literal table of
scenarios or orders, a fixed dimension).  Anything else is left to Catalyst
and AQE, which switch to a broadcast at run time only when the measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise keep a
shuffle join (with skew splitting when ``skewJoin`` is on).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast at most this many bytes, even when a bound is known.
MAX_BROADCAST_BYTES = 64 << 20
# What a value is taken to need: numbers and dates 8, text 64, the rest 256.
_WIDTHS = {"string": 64, "binary": 256}


def row_width(df: DataFrame) -> int:
    """Estimated bytes of a row, from its types."""
    return 16 + sum(_WIDTHS.get(t, 256 if "<" in t else 8) for _, t in df.dtypes)


def broadcast_bounded(df: DataFrame, bound_rows: int | None) -> DataFrame:
    """Mark ``df`` for broadcast when ``bound_rows`` (an upper bound on its
    row count that holds at any scale) rows of its width are small enough;
    else return it as is so the planner picks a shuffle join."""
    if bound_rows is not None and 0 <= bound_rows * row_width(df) <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    return df


def period_count(start: int, end: int) -> int:
    """Row bound of a table with one row per period in [start, end]."""
    return max(0, end - start + 1)


def full_outer_merge(dfs: Sequence[DataFrame], on: Sequence[str] | str) -> DataFrame:
    """Full outer join of several tables on shared key columns (J2, J3);
    the ``using`` form coalesces the key columns, so a key present on any
    side appears once."""
    on = [on] if isinstance(on, str) else list(on)
    return reduce(lambda a, b: a.join(b, on=on, how="full"), dfs)


def left_attach(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
                right_bound: int | None = None) -> DataFrame:
    """Left join; keys only on the right are lost."""
    return left.join(broadcast_bounded(right, right_bound), on=on, how="left")


def star_join(fact: DataFrame, dims: Sequence[DataFrame], on: Sequence[str] | str,
              dim_bound: int | None = None) -> DataFrame:
    """Left-join every dimension to the fact table on ``on`` (J5).  With a
    row bound on the dimensions (one row per period) each join is a
    broadcast hash join: the fact side is never shuffled for them."""
    out = fact
    for d in dims:
        out = out.join(broadcast_bounded(d, dim_bound), on=on, how="left")
    return out
