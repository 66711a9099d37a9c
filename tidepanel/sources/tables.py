"""Scans of the parquet tables.

Every reader returns a lazy DataFrame; Catalyst prunes the columns a query
does not use and pushes filters into the parquet scan, so readers never
select or filter on their own.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


def read_silver(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a long observation table written by the ingest step (K1)."""
    return spark.read.format(fmt).load(path)


def read_catalog(spark: SparkSession, name: str) -> DataFrame:
    """Scan a catalog table written by a sink (K2-K4)."""
    return spark.table(name)
