"""Entity-period series built from the test tables, used by the time-series
and model queries.

``segment_month``: orders ⋈ customer per (market segment, month index):
``y`` = order value in millions, ``n_orders``, ``n_f`` (fulfilled orders),
``x1`` = mean order value in thousands, ``x_p`` = mean value of partly
shipped orders in thousands (sparse: null in months without one, the
natural holes the cleaning step fills).

``nation_segment_month``: the same per (nation, segment, month), 125
series: the many-series axis for per-series models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import add_period
from ..operators.aggregate import lossless_decimal
from ..sources import standins
from ..sources.tables import read_table


def _measures():
    """Money is summed exactly and converted to double once, so every value
    is the same whatever the layout, and nothing is rounded here."""
    price = lossless_decimal("o_totalprice")
    partly = F.when(F.col("o_orderstatus") == "P", price)
    mean = lambda v: F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))
    return [
        (F.sum(price).cast("double") / 1e6).alias("y"),
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_f"),
        (mean(price) / 1e3).alias("x1"),
        (mean(partly) / 1e3).alias("x_p"),
    ]


def segment_month(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    oc = add_period(o.join(c, o.o_custkey == c.c_custkey), "o_orderdate", "month", "p")
    return oc.groupBy(F.col("c_mktsegment").alias("k"), "p").agg(*_measures())


def nation_segment_month(spark: SparkSession, d: str) -> DataFrame:
    oc = add_period(standins.orders_customer(spark, d), "o_orderdate", "month", "p")
    out = oc.groupBy(F.concat_ws("|", "n_name", "c_mktsegment").alias("k"), "p").agg(*_measures())
    return out


_PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
_PARTLY = f"CASE WHEN o_orderstatus = 'P' THEN {_PRICE} END"
_MEASURES_SQL = f"""CAST(sum({_PRICE}) AS DOUBLE) / 1e6 AS y, count(*) AS n_orders,
    count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_f,
    CAST(sum({_PRICE}) AS DOUBLE) / count(o_totalprice) / 1e3 AS x1,
    CAST(sum({_PARTLY}) AS DOUBLE) / count({_PARTLY}) / 1e3 AS x_p"""

SEGMENT_MONTH_SQL = f"""sm AS (
  SELECT c_mktsegment AS k,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS p,
    {_MEASURES_SQL}
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

NATION_SEGMENT_MONTH_SQL = f"""sm AS (
  SELECT n_name || '|' || c_mktsegment AS k,
    CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS p,
    {_MEASURES_SQL}
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def month_index(year: int, month: int) -> int:
    return year * 12 + month - 1


def customer_month(spark: SparkSession, d: str) -> DataFrame:
    """Per (customer, month with orders): many short series.  Adds
    ``x_ratio`` = orders per fulfilled order with IEEE semantics (+inf when
    a month has no fulfilled order), the kind of value pandas arithmetic
    hands to the cleaning step."""
    o = add_period(read_table(spark, d, "orders"), "o_orderdate", "month", "p")
    out = o.groupBy(F.col("o_custkey").alias("k"), "p").agg(*_measures())
    return out.withColumn("x_ratio", F.when(F.col("n_f") == 0, F.lit(float("inf")))
                          .otherwise(F.col("n_orders") / F.col("n_f")))


CUSTOMER_MONTH_SQL = f"""cm AS (
  SELECT *, CASE WHEN n_f = 0 THEN 'inf'::DOUBLE ELSE n_orders / n_f END AS x_ratio
  FROM (SELECT o_custkey AS k,
          CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS p,
          {_MEASURES_SQL}
        FROM orders GROUP BY 1, 2))"""
