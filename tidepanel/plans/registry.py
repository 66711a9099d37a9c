"""Registry of named queries: a Spark builder and, where SQL can say the
same thing, an independent DuckDB oracle.

How checked outputs agree bit for bit across the two engines: sums and
means of cent-valued columns are exact (integer cents / decimals, then one
conversion to double) and are not rounded; values that are IEEE-exact
functions of exact inputs (ratios, differences, lags) are not rounded
either; only values the engines compute by different algorithms (double
sums of arbitrary values, regressions, logarithms, windowed moments) are
rounded, to 6-8 places (see :func:`rounded`)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stages import materialize, materialize_all  # noqa: F401 - used by the catalogs


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    step: int


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, step: int = 0):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, step)
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6, **per_column: int | None) -> DataFrame:
    """Round every double column to ``places`` (or its own entry; ``None``
    leaves a column exact - values computed in exact decimal arithmetic
    are identical in both engines and must not be rounded, since a value
    sitting exactly on a rounding tie is broken differently by each)."""
    cols = []
    for f in df.schema.fields:
        d = per_column.get(f.name, places)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and d is not None:
            cols.append(F.round(F.col(f.name), d).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
