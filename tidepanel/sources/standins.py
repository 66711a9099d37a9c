"""Long observation tables ("silver") derived from the test tables.

The gold builders read long tables shaped like the ingested archives:
``ref_date``, optional ``geo``, one or more label columns and ``value``.
These views build such tables from the TPC-H-like parquet files so every
builder runs over the whole of the given tables.  Which column stands for
what is listed in the README.

Joins: ``nation`` and ``region`` are fixed dimensions (25 and 5 rows by
definition of the schema) and are broadcast; ``customer`` and ``part`` grow
with the data and are joined by whatever Catalyst/AQE pick from measured
sizes (a shuffle join at scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import broadcast_bounded
from .tables import read_table

NATION_ROWS = 25
REGION_ROWS = 5


def orders_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region (every order has a customer)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    geo = broadcast_bounded(
        n.join(broadcast_bounded(r, REGION_ROWS), n.n_regionkey == r.r_regionkey)
         .select("n_nationkey", "n_name", "r_name"),
        NATION_ROWS,
    )
    cust = c.join(geo, c.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_mktsegment", "n_name", "r_name")
    return o.join(cust, o.o_custkey == cust.c_custkey)


def lineitem_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey)


# ---- one view per source table of the pipeline --------------------------------

def labour_long(spark, sf_dir):
    """Industry measures: segment = industry, order status = measure."""
    return orders_customer(spark, sf_dir).select(
        F.col("o_orderdate").alias("ref_date"),
        F.col("r_name").alias("geo"),
        F.col("c_mktsegment").alias("industry_label"),
        F.col("o_orderstatus").alias("measure"),
        F.col("o_totalprice").alias("value"),
    )


def trade_long(spark, sf_dir):
    """Flows by partner: priority = flow kind, region = partner."""
    return orders_customer(spark, sf_dir).select(
        F.col("o_orderdate").alias("ref_date"),
        F.col("o_orderpriority").alias("trade"),
        F.col("r_name").alias("partner"),
        F.col("o_totalprice").alias("value"),
    )


def asset_age_long(spark, sf_dir):
    """Asset estimates: part name = asset function, return flag = estimate."""
    return lineitem_part(spark, sf_dir).select(
        F.col("l_shipdate").alias("ref_date"),
        F.col("p_name").alias("asset_function"),
        F.col("l_returnflag").alias("estimate"),
        F.col("l_quantity").alias("value"),
    )


def asset_investment_long(spark, sf_dir):
    """Investment flows: part name filters the assets, part type is the
    asset class that becomes a column."""
    return lineitem_part(spark, sf_dir).select(
        F.col("l_shipdate").alias("ref_date"),
        F.col("p_name").alias("assets"),
        F.col("p_type").alias("asset_class"),
        F.col("l_extendedprice").alias("value"),
    )


def price_long(spark, sf_dir):
    """Unit prices by product class (one table feeds all three indices)."""
    return lineitem_part(spark, sf_dir).select(
        F.col("l_shipdate").alias("ref_date"),
        F.col("p_type").alias("product_class"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("value"),
    )


def rate_long(spark, sf_dir):
    """Policy-rate stand-in: discounts."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ref_date"),
        F.col("l_discount").alias("value"),
    )


def output_long(spark, sf_dir):
    """Output by industry: segment = industry, priority = price basis."""
    return orders_customer(spark, sf_dir).select(
        F.col("o_orderdate").alias("ref_date"),
        F.col("r_name").alias("geo"),
        F.col("c_mktsegment").alias("industry_label"),
        F.col("o_orderpriority").alias("prices"),
        F.col("o_totalprice").alias("value"),
    )


# ---- pre-aggregated long tables ------------------------------------------------
#
# Every gold table reads one of two joins, and every measure it needs is a
# sum or a mean.  So each join is aggregated once to a month-level cube
# (sum of each value and count of its non-null rows per month and label
# combination); the cube's size is bounded by the label domains and the
# number of months, not by the rows, and each view below is a projection of
# it with ``value`` = sum and ``n`` = count.  Means are then sum / n exactly.

def _month_keys(col: str):
    return [F.year(col).alias("__y"), F.month(col).alias("__m")]


def _month_start():
    """First day of the cube's month, as the ``ref_date`` of its rows."""
    return F.make_date("__y", "__m", F.lit(1)).alias("ref_date")


def _range_filter(df: DataFrame, col: str, cfg) -> DataFrame:
    if cfg is None:
        return df
    from ..functions.scalars import raw_period_bounds
    bound = raw_period_bounds(df, col, cfg.start, cfg.end, cfg.grain)
    return df if bound is None else df.filter(bound)


def units_sum(col: str, scale: int = 2):
    """Exact sum of a column of at most ``scale`` decimals, in units of
    10**-scale: whole units added as 64-bit integers (fast, and independent of
    how rows are split over tasks).  A value with more decimals raises, and
    so does an overflow of the sum (ANSI arithmetic, Spark's default)."""
    x, one = F.col(col), 10 ** scale
    units = F.rint(x * one)
    return F.sum(F.when(x.isNull() | (units / one == x), units.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} has more than {scale} decimals: "),
                               x.cast("string"))).cast("long")))


def units_to_decimal(col: str, scale: int = 2):
    """The cube's unit sums as exact ``decimal(20, scale)`` values."""
    return (F.col(col).cast("decimal(20,0)") / F.lit(10 ** scale)).cast(f"decimal(20,{scale})")


def orders_cube(spark: SparkSession, sf_dir: str, cfg=None) -> DataFrame:
    oc = _range_filter(orders_customer(spark, sf_dir), "o_orderdate", cfg)
    agg = oc.groupBy(*_month_keys("o_orderdate"), "r_name", "c_mktsegment", "o_orderstatus",
                     "o_orderpriority").agg(
        units_sum("o_totalprice").alias("__c"), F.count("o_totalprice").alias("n"))
    return agg.select(_month_start(), "r_name", "c_mktsegment", "o_orderstatus",
                      "o_orderpriority", units_to_decimal("__c").alias("value"), "n")


def _first_keyword(col: str, keywords) -> "F.Column":
    """The first keyword the lower-cased text contains, else null: a label
    that keeps exactly what a keyword filter needs, with at most
    len(keywords) values whatever the text's cardinality."""
    low = F.lower(F.col(col))
    expr = None
    for kw in keywords:
        hit = low.contains(kw.lower())
        expr = F.when(hit, F.lit(kw)) if expr is None else expr.when(hit, F.lit(kw))
    return expr if expr is not None else F.lit(None).cast("string")


def lineitem_cube(spark: SparkSession, sf_dir: str, cfg=None) -> DataFrame:
    """With a configuration, part names enter the cube only as the first
    age keyword and the first investment keyword they contain (a part name
    column has millions of values at scale; these labels have a handful),
    so the cube is bounded by configuration x types x flags x months."""
    lp = _range_filter(lineitem_part(spark, sf_dir), "l_shipdate", cfg)
    if cfg is not None:
        lp = lp.withColumns({"__age_label": _first_keyword("p_name", cfg.age_keywords),
                             "__asset_label": _first_keyword("p_name", cfg.investment_keywords)})
        name_keys = ["__age_label", "__asset_label"]
    else:
        lp = lp.withColumns({"__age_label": F.col("p_name"), "__asset_label": F.col("p_name")})
        name_keys = ["__age_label", "__asset_label"]
    unit = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    agg = lp.groupBy(*_month_keys("l_shipdate"), *name_keys, "p_type", "l_returnflag").agg(
        units_sum("l_quantity").alias("__q"), F.count("l_quantity").alias("n_qty"),
        units_sum("l_extendedprice").alias("__e"), F.count("l_extendedprice").alias("n_ext"),
        F.sum(unit).alias("unit"), F.count(unit).alias("n_unit"))
    return agg.select(_month_start(), "__age_label", "__asset_label", "p_type", "l_returnflag",
                      units_to_decimal("__q").alias("qty"), "n_qty",
                      units_to_decimal("__e").alias("ext"), "n_ext", "unit", "n_unit")


def rate_cube(spark: SparkSession, sf_dir: str, cfg=None) -> DataFrame:
    """The policy rate needs two columns of lineitem and no join."""
    li = _range_filter(read_table(spark, sf_dir, "lineitem").select("l_shipdate", "l_discount"),
                       "l_shipdate", cfg)
    agg = li.groupBy(*_month_keys("l_shipdate")).agg(
        units_sum("l_discount").alias("__d"), F.count("l_discount").alias("n"))
    return agg.select(_month_start(), units_to_decimal("__d").alias("value"), "n")


def labour_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("r_name").alias("geo"),
                       F.col("c_mktsegment").alias("industry_label"),
                       F.col("o_orderstatus").alias("measure"), "value", "n")


def trade_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("o_orderpriority").alias("trade"),
                       F.col("r_name").alias("partner"), "value", "n")


def output_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("r_name").alias("geo"),
                       F.col("c_mktsegment").alias("industry_label"),
                       F.col("o_orderpriority").alias("prices"), "value", "n")


def asset_age_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("__age_label").alias("asset_function"),
                       F.col("l_returnflag").alias("estimate"),
                       F.col("qty").alias("value"), F.col("n_qty").alias("n"))


def asset_investment_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("__asset_label").alias("assets"),
                       F.col("p_type").alias("asset_class"),
                       F.col("ext").alias("value"), F.col("n_ext").alias("n"))


def price_from_cube(cube: DataFrame) -> DataFrame:
    return cube.select("ref_date", F.col("p_type").alias("product_class"),
                       F.col("unit").alias("value"), F.col("n_unit").alias("n"))
