"""Intermediate tables: results that several branches of a query read are
written once as Parquet to the session's shared folder."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from .session import shared_path


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches of a query read (a cube,
    an aggregated series) as Parquet to the session's shared folder: read
    back, it keeps column pruning and pushed filters, and a lost executor
    does not send Spark back to the fact tables."""
    return materialize_all([df])[0]


def materialize_all(dfs: Sequence[DataFrame]) -> list[DataFrame]:
    """Several intermediates at once: their jobs run side by side."""
    spark = dfs[0].sparkSession
    paths = [shared_path(spark, "stage") for _ in dfs]
    if len(dfs) == 1:
        dfs[0].write.parquet(paths[0])
    else:
        with ThreadPoolExecutor(len(dfs)) as pool:
            list(pool.map(lambda dp: dp[0].write.parquet(dp[1]), zip(dfs, paths)))
    return [spark.read.schema(df.schema).parquet(p) for df, p in zip(dfs, paths)]
